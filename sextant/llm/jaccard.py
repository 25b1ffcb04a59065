"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct word n-grams, as 64-bit hashes in one global order: rare ones (by a sketch that counts the
whole corpus) before frequent ones, then by hash. Two sets of Jaccard >= t that are cut to prefixes of
|S| - ceil(t|S|) + l n-grams must share at least l of them. Each document chooses its own l from LENGTHENED by the
estimated cost of its candidates: a longer prefix meets more lists, but asks for more shared n-grams before a pair is
verified; a pair needs the smaller l of its two.

Equal sets are one class with one representative. Prefix n-grams held by at most FEW representatives give pairs, which
are counted and verified. An n-gram held by more gives a group that is cut into blocks; the members of two blocks meet
in one task, which compares their sets in numpy and returns only the links of a spanning forest. So a group of g near
copies costs no g * g rows, nothing is capped, and every comparison that could be a link is made. Components follow
from all links.

Edge cases: a null or wordless text has an empty set and is linked with nothing (its own component); fewer words than n
make one n-gram; repeated rows each get a result row (rows of one id are taken to hold one text); null ids are kept, as a component of null; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, with_computed, word_hashes, written
from .graph import components

LENGTHENED = (1, 2, 4, 8, 16)
#: Cost of verifying a candidate against meeting it once in a list.
VERIFY = 30.0
FEW, BLOCK = 24, 2000
#: Characters of text that a worker hashes at once, and that a block holds.
CHARS, HELD = 1_000_000, 4_000_000
#: Rows of a few numbers that are broadcast to the texts they ask for, at most (some 10 MB).
MOST_SENT = 200_000
#: Bits of the filter of wanted ids for each of them, and its 64-bit words that are broadcast, at most (some 50 MB).
ID_BITS, MOST_WORDS = 12, 1_000_000
#: N-grams of this class of frequency or more (16 times the usual load) go to long lists without being counted: they may be too many for one task.
COMMON = 4
#: The counting sketch: counters, in segments, as a power of two that grows with the corpus to about LOAD n-grams a counter (some LETTERS letters of text
#: make one): in fewer, n-grams of a few lists look as rare as any. At 2**28 (134 MB) it stays, as every worker holds it.
SKETCH_BITS, MOST_BITS, SEGMENT = 22, 28, 1 << 16
LOAD, LETTERS = 16, 6
#: N-grams that a task counts before it sends them on.
COUNTED = 1 << 22


def ngram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the borders of the texts in them."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for i in range(n):
            grams = mix(grams + words[i : i + len(grams)] * np.uint64(2 * i + 1))
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = np.flatnonzero(owner[: len(grams)] == owner[n - 1 :]) if len(grams) else np.zeros(0, int)
        values, owners = grams[whole], owner[whole]
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            h = np.zeros(1, np.uint64)
            for w in words[at[i] : at[i + 1]]:
                h = mix(h * np.uint64(31) + w + np.uint64(1))
            values, owners = np.append(values, h ^ np.uint64(counts[i])), np.append(owners, i)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))


def packed(counts: np.ndarray) -> bytes:
    """Counters in the shortest of three forms, told by the first byte: all in their narrowest type (its size); those above zero after their places
    (128 and the size); or the gaps between places, one for each count, in bytes of which 255 carries on (64)."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    at = np.flatnonzero(counts)
    if int(counts.sum()) + len(counts) // 255 < min(len(counts), 3 * len(at)):
        gaps = np.diff(np.repeat(at, counts[at].astype(np.int64)), prepend=0)
        ends = np.cumsum(gaps // 255 + 1) - 1
        out = np.full(ends[-1] + 1 if len(ends) else 0, 255, np.uint8)
        out[ends] = gaps % 255
        return bytes([64]) + out.tobytes()
    if len(at) * (2 + kind.itemsize) < len(counts) * kind.itemsize and len(counts) <= 1 << 16:
        return bytes([kind.itemsize | 128]) + at.astype(np.uint16).tobytes() + counts[at].astype(kind).tobytes()
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    """Where the counters stand, and their values."""
    if raw[0] == 64:
        gaps = np.frombuffer(raw, np.uint8, offset=1)
        at, counts = np.unique(np.cumsum(gaps, dtype=np.int64)[gaps < 255], return_counts=True)
        return at, counts.astype(np.uint64)
    size = raw[0] & 127
    if not raw[0] & 128:
        return slice(None), np.frombuffer(raw, f"u{size}", offset=1).astype(np.uint64)
    n = (len(raw) - 1) // (2 + size)
    return np.frombuffer(raw, np.uint16, n, 1).astype(np.int64), np.frombuffer(raw, f"u{size}", n, 1 + 2 * n).astype(np.uint64)


def sketch_bits(docs: DataFrame) -> int:
    """Of how many bits of a hash the sketch's counters are the values."""
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(SKETCH_BITS, math.ceil(math.log2(max(letters / LETTERS / LOAD, 1)))), MOST_BITS)


def count_sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Classes of frequency (see `rarity`) of 2**bits counters over the whole corpus, by how many sets hold n-grams of each; two to a byte."""

    def sums(held: list[np.ndarray]) -> pd.DataFrame:
        at = np.sort(np.concatenate(held))
        cuts = np.flatnonzero(np.diff(at // SEGMENT, prepend=-1))
        parts = [(int(x[0]) // SEGMENT, packed(np.bincount(x % SEGMENT, minlength=SEGMENT))) for x in np.split(at, cuts[1:])]
        return pd.DataFrame(parts, columns=["segment", "counts"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            texts = list(batch["text"])
            for lo, hi in chunks(texts):
                held.append((ngram_sets(texts[lo:hi], n)[0] >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(held[-1])
                if size > COUNTED:
                    yield sums(held)
                    held, size = [], 0
        if size:
            yield sums(held)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch["segment"], batch["counts"]):
                at, counts = unpacked(raw)
                total.setdefault(s, np.zeros(SEGMENT, np.uint64))[at] += counts
        for s, counts in total.items():
            classes = np.minimum(rarity(counts), 15)
            yield pd.DataFrame({"segment": [s], "classes": [zlib.compress((classes[::2] | classes[1::2] << 4).tobytes(), 1)]})

    rows = docs.select("text").mapInPandas(count, "segment int, counts binary").repartition("segment").mapInPandas(add, "segment int, classes binary").collect()
    out = np.zeros((1 << bits) // 2, np.uint8)
    for r in rows:
        out[r["segment"] * SEGMENT // 2 : (r["segment"] + 1) * SEGMENT // 2] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Classes of frequency by counter: 0 up to about the usual load (of a segment, which is that of all), then one more for each doubling."""
    usual = max(float(np.median(counts)), 1.0)
    usual += 4 * math.sqrt(usual)
    return np.ceil(np.log2(np.maximum(counts / usual, 1.0))).astype(np.uint8)


def class_of(classes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The n-grams' classes in the sketch."""
    at = (grams >> np.uint64(64 - len(classes).bit_length())).astype(np.int64)
    return classes[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def needed(t: float, size: np.ndarray) -> np.ndarray:
    return np.ceil(np.round(t * size, 9)).astype(np.int64)


def choose(classes: np.ndarray, size: int, need: int) -> int:
    """The l whose prefix has the least estimated cost, from the frequency classes of the set in global order."""
    best, cost = 1, None
    load = np.cumsum(np.exp2(classes[: size - need + LENGTHENED[-1]].astype(float)))
    for length in LENGTHENED:
        p = size - need + length
        if p > size:
            break
        c = load[p - 1] * (1 + VERIFY / length**2)
        if cost is None or c < cost:
            best, cost = length, c
    return best


def prefixes(docs: DataFrame, n: int, t: float, classes: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, lo, hi (the set's fingerprint), ask (its l), prefix (its n-grams), common (those of them whose class is COMMON or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def compute():
        by_counter = shared.value

        def of(texts):
            values, at = ngram_sets(texts, n)
            level = class_of(by_counter, values)
            with np.errstate(over="ignore"):
                second = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            out = []
            for i in range(len(texts)):
                v, c = values[at[i] : at[i + 1]], level[at[i] : at[i + 1]]
                size = len(v)
                if not size:
                    out.append((0, 0, 0, 0, [], []))
                    continue
                order = np.argsort(c, kind="stable")
                need = int(needed(t, np.array([size]))[0])
                ask = choose(c[order], size, need)
                kept = order[: size - need + ask]
                often = c[kept] >= COMMON
                with np.errstate(over="ignore"):
                    lo, hi = v.sum(dtype=np.uint64), second[at[i] : at[i + 1]].sum(dtype=np.uint64)
                prefix = v[kept].astype(np.int64)
                out.append((size, int(lo.astype(np.int64)), int(hi.astype(np.int64)), ask, prefix[~often], prefix[often]))
            return [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))]

        return of

    added = "n_shingles bigint, lo bigint, hi bigint, ask int, prefix array<bigint>, common array<bigint>"
    return with_computed(docs.select("doc_id", "text"), "text", added, compute, CHARS).drop("text")


def meet(grams: DataFrame, t: float) -> DataFrame:
    """From (gram, rep, n, ask), dealt out and sorted by gram: pairs of short lists (a, b, ask) and members of long ones (gram, a)."""

    def emit(g: np.ndarray, rep: np.ndarray, size: np.ndarray, ask: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        length = np.diff(np.append(starts, len(g)))
        for m in np.unique(length):
            if m == 1:
                continue
            at = starts[length == m]
            if m > FEW:
                yield members((at[:, None] + np.arange(m)).ravel(), g, rep)
                continue
            i, j = np.array(list(combinations(range(m), 2))).T
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = np.minimum(size[x], size[y]) >= needed(t, np.maximum(size[x], size[y]))
            x, y = x[near], y[near]
            yield pd.DataFrame({"gram": g[x], "a": np.minimum(rep[x], rep[y]), "b": np.maximum(rep[x], rep[y]), "ask": np.minimum(ask[x], ask[y])})

    def members(rows, g, rep):
        return pd.DataFrame({"gram": g[rows], "a": rep[rows], "b": rep[rows], "ask": 0})

    def run(batches):
        held = long = None  # the last list may go on in the next batch; of a long one only the gram is kept
        for batch in batches:
            now = tuple(batch[c].to_numpy() for c in ("gram", "rep", "n", "ask"))
            if not len(now[0]):
                continue
            now = tuple(np.concatenate(x) for x in zip(held, now)) if held else now
            start = np.searchsorted(now[0], long, "right") if long is not None else 0
            if start:
                yield members(np.arange(start), now[0], now[1])
                now = tuple(x[start:] for x in now)
            if not len(now[0]):
                held = None
                continue
            last = np.searchsorted(now[0], now[0][-1])
            yield from emit(*(x[:last] for x in now)) if last else ()
            held, long = tuple(x[last:] for x in now), None
            if len(held[0]) > FEW:
                yield members(np.arange(len(held[0])), held[0], held[1])
                held, long = None, held[0][0]
        if held:
            yield from emit(*held)

    return grams.mapInPandas(run, "gram bigint, a bigint, b bigint, ask int")


def sent(rows: DataFrame) -> DataFrame:
    """rows (a few numbers each) as a broadcast where they are at most MOST_SENT; else Spark joins by shuffling, and splits skewed keys."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (doc_id, text) of each wanted id (distinct rows of doc_id).

    A Bloom filter of the ids (four bits of one 64-bit word each) is broadcast while it has at most MOST_WORDS words,
    so that few other texts reach the shuffle of the exact join; beyond that all texts are shuffled.
    """
    words = wanted.count() * ID_BITS // 64 + 1
    if words <= MOST_WORDS:
        word = F.pmod(F.xxhash64("doc_id"), F.lit(words)).alias("word")
        mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), {at}) & 63 as int))" for at in (40, 46, 52, 58)))
        bits = wanted.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
        docs = docs.select("doc_id", "text", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(mask) == mask)
    return docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, texts: DataFrame, n: int, t: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach t. The two texts of a pair come together, one row each."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    rows = texts.join(sent(ends), "doc_id").select("a", "b", "text").repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole, held = held.iloc[: len(held) // 2 * 2], held.iloc[len(held) // 2 * 2 :]
            ids, found = whole[["a", "b"]].iloc[::2], list(whole["text"])
            length = np.array([len(x) for x in found], np.int64).reshape(-1, 2).sum(1)
            cut = np.flatnonzero(np.diff(np.cumsum(length) // CHARS, prepend=-1)) if len(ids) else []
            for lo, hi in zip(cut, [*cut[1:], len(ids)]):
                values, at = ngram_sets(found[2 * lo : 2 * hi], n)
                keep = []
                for x in range(0, 2 * (hi - lo), 2):
                    p, q = values[at[x] : at[x + 1]], values[at[x + 1] : at[x + 2]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= needed(t, np.array([len(p) + len(q) - both]))[0])
                yield ids.iloc[lo:hi][np.array(keep, bool)]

    return rows.mapInPandas(run, "a bigint, b bigint")


def forest(values: np.ndarray, at: np.ndarray, t: float, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all sets (given by borders) of different labels with Jaccard >= t: each set against all later ones at once."""
    size, k = np.diff(at), len(at) - 1
    vocabulary, code = np.unique(values, return_inverse=True)
    label, links = label.copy(), []
    mark = np.zeros(len(vocabulary), np.int32)
    for x in range(k - 1):
        if (label[x + 1 :] == label[x]).all():
            continue
        own = code[at[x] : at[x + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[code[at[x + 1] :]], at[x + 1 : -1] - at[x + 1])
        mark[own] = 0
        near = np.flatnonzero(shared >= needed(t, size[x] + size[x + 1 :] - shared)) + x + 1
        for y in near:
            if label[y] != label[x]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def placed(members: DataFrame, texts: DataFrame, extra: list[str]) -> DataFrame:
    """gram, i, j, a, text and `extra` of the members (gram, a): lists in blocks of about BLOCK members and HELD characters at most, for each pair i <= j of blocks."""
    long = texts.select(F.col("doc_id").alias("a"), F.length("text").alias("chars")).join(sent(members), "a")
    sizes = long.groupBy("gram").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("chars") / HELD)).cast("int").alias("k"))
    rows = members.join(written(sizes, "jaccard-sizes"), "gram").withColumn("own", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("gram", "a", *extra, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return texts.select(F.col("doc_id").alias("a"), "text").join(sent(rows), "a").select("gram", "i", "j", "a", "text", *extra)


def compared(rows: DataFrame, n: int, t: float, rooted: bool) -> DataFrame:
    """Links (a, b) of a spanning forest of each pair of blocks; with `rooted`, only between members of different roots."""
    rows = rows.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "a")

    def links(ids: list, texts: list, roots: list):
        found = [ngram_sets(texts[lo:hi], n) for lo, hi in chunks(texts, CHARS)]
        values = np.concatenate([v for v, _ in found])
        size = np.concatenate([np.diff(at) for _, at in found])
        label = np.unique(roots, return_inverse=True)[1] if rooted else np.arange(len(ids))
        for x, y in forest(values, np.concatenate([[0], np.cumsum(size)]), t, label):
            yield ids[x], ids[y]

    def run(batches):
        key, ids, held, roots = None, [], [], []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row[:3] != key:
                    out += links(ids, held, roots) if len(ids) > 1 else []
                    key, ids, held, roots = row[:3], [], [], []
                ids.append(row[3])
                held.append(row[4])
                roots.append(row[5] if rooted else 0)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if len(ids) > 1:
            yield pd.DataFrame(list(links(ids, held, roots)), columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(run, "a bigint, b bigint")


def blocks(members: DataFrame, texts: DataFrame, near: DataFrame, n: int, t: float) -> DataFrame:
    """Links (a, b) that, with the links `near`, join all that the members (gram, a) of long lists should be joined to.

    First every text is compared in one of its lists only, the one of the least hash, which near copies mostly share.
    Then in each list whose members are not of one component already, those of different components are compared.
    Lists of the same members are compared once.
    """
    chosen = members.groupBy("a").agg(F.min_by("gram", F.xxhash64("gram")).alias("gram"))
    first = written(near.unionByName(compared(placed(chosen, texts, []), n, t, False)), "jaccard-links")
    roots = components(first).select(F.col("node").alias("a"), "root")
    rooted = members.join(roots, "a", "left").select("gram", "a", F.coalesce("root", "a").alias("root"))
    open_ = rooted.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("g"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("who"))
    open_ = open_.where("least < most").groupBy("g", "who").agg(F.min("gram").alias("gram")).select("gram")
    rest = written(rooted.join(open_, "gram").select("gram", "a", "root"), "jaccard-open")
    return first.unionByName(compared(placed(rest, texts, ["root"]), n, t, True))


def join(docs: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): see the module."""
    docs = docs.select("doc_id", "text")
    classes = count_sketch(docs, n, sketch_bits(docs))
    sigs = written(prefixes(docs, n, t, classes), "jaccard-prefixes")
    sets = sigs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = sets.groupBy("lo", "hi", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("ask", "prefix", "common"), "doc_id").alias("p"))
    reps = written(reps.select("lo", "hi", "n", "rep", "p.ask", "p.prefix", "p.common"), "jaccard-classes")
    grams = reps.select("rep", "n", "ask", F.explode("prefix").alias("gram")).repartition("gram").sortWithinPartitions("gram")
    met = written(meet(grams.select("gram", "rep", "n", "ask"), t), "jaccard-lists")
    pairs = met.where("ask > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("ask").alias("ask"))
    common = reps.select(F.col("rep").alias("a"), F.explode("common").alias("gram"))
    twice = common.groupBy("gram").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("gram")
    members = written(met.where("ask = 0").select("gram", "a").unionByName(common.join(twice, "gram").select("gram", "a")), "jaccard-members")
    # a pair that shares fewer n-grams in short lists than it must may share the others in long ones, where it is compared
    pairs = written(pairs.where("shared >= ask").select("a", "b"), "jaccard-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select(F.col("a").alias("doc_id"))).distinct()
    texts = written(among(docs, written(wanted, "jaccard-wanted")), "jaccard-texts")
    links = blocks(members, texts, verified(pairs, texts, n, t), n, t)
    roots = components(links)
    of_class = reps.select("lo", "hi", F.col("n").alias("n_shingles"), "rep").join(roots, reps["rep"] == roots["node"], "left")
    of_class = of_class.select("lo", "hi", "n_shingles", F.coalesce("root", "rep").alias("component"))
    found = sigs.select("doc_id", "n_shingles", "lo", "hi").join(of_class, ["lo", "hi", "n_shingles"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return found.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
