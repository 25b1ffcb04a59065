"""Phrase collocation mining with weighted acyclic automata.

Every shard of texts (SHARD characters of one language) sorts its n-grams and builds count transducers from them: states
are shared prefixes, equal subtrees are one state, an arc holds a word and how often the path up to it occurs. The
paths are cut into ranges by a hash of their first words, so that a range's transducers from all shards meet in one group,
are united and their weights summed. Single words come first, then pairs, then longer phrases: a phrase is only as
frequent as its rarest part, so pairs are taken where both words, and longer phrases where all pairs may be frequent by a
Bloom filter of FILTER_BITS bits of what the round before has found, which can let too much through but never too little. Parts of candidates are looked up by composing the sorted distinct parts of a
range with the range's transducer.

Ranges are as many as shuffle partitions; pairs are dealt by their first word, so one word brings at most its distinct successors to a
range, and paths of three and more words by their first three, so a frequent pair is spread. Group sizes are those of a range's distinct frequent paths and of its share of the shards' paths. Top
lists are taken from the tops of hashed slices.

Edge cases: null texts are empty; a null lang is `und`, and so is one of that name. Repeated rows count each. Words may be of any length;
a very long text makes a shard of its own (some 150 bytes of memory a byte). Empty tables give no rows. Ties go to the smaller cut and then to the smaller phrase
by bytes. Other columns, the id included, are not looked at.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, mix, written

#: Characters of a shard, bits of a filter of frequent words or pairs (1 MB; collected and broadcast as at most 131,072 numbers), slices of a language's top list.
SHARD, FILTER_BITS, SLICES = 12_000_000, 1 << 23, 64
LONGEST = 5
_TOKEN = re.compile(rb"[^ \t\n]+|\n")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: What ends a piece becomes a line end.
_PIECES = bytes(10 if chr(c) in ".,;:!?\n\v\f\r" else _LOWER[c] for c in range(256))
_CODEC = pa.Codec("zstd", 1)
AUTOMATON = "words binary, size binary, label binary, weight binary, target binary"


class Automaton:
    """An acyclic automaton over words: the arcs of state s are first[s] .. first[s + 1], sorted by label (a place in words, from 1).

    weight: how often the path that ends with the arc occurs (0: not a path of its own). The last state is the start.
    """

    def __init__(self, words: list[bytes], first, label, weight, target):
        self.words, self.first, self.label, self.weight, self.target = words, first, label, weight, target

    @classmethod
    def build(cls, words: list[bytes], paths: np.ndarray, weight: np.ndarray) -> Automaton:
        """From distinct paths (rows of labels, 0 behind the end) in order: each adds the arcs past what it shares with the path before, then equal states are merged from the ends up."""
        n, depth = paths.shape
        differs = np.ones((n, depth), bool)
        differs[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        fresh = differs & (paths > 0)
        last = np.append(paths[:, 1:] == 0, np.ones((n, 1), bool), axis=1)
        # state of every node of a level; leaves are state 0, which has no arcs
        firsts, labels, weights, targets, states = [np.zeros(1, np.int64)], [], [], [], 1
        arcs, below = 0, np.zeros(0, np.int32)
        for d in range(depth - 1, -1, -1):
            rows = np.flatnonzero(fresh[:, d])
            # nodes of level d + 1 are the arcs out of level d
            lab, own = paths[rows, d].astype(np.int32), np.where(last[rows, d], weight[rows], 0)
            to = np.zeros(len(rows), np.int32)
            if d + 1 < depth:
                parents = np.searchsorted(rows, np.flatnonzero(fresh[:, d + 1]), "right") - 1
                with_arcs, inverse = np.unique(parents, return_inverse=True)
                to[with_arcs] = below[np.flatnonzero(np.diff(inverse, prepend=-1))] if len(inverse) else 0
            # arcs of one parent form a state: which parents have equal arcs?
            above = np.flatnonzero(fresh[:, d - 1]) if d else np.zeros(1, np.int64)
            owner = np.searchsorted(above, rows, "right") - 1 if d else np.zeros(len(rows), np.int64)
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(start, len(rows)))
            if len(rows):
                place = np.arange(len(rows)) - np.repeat(start, size)
                with np.errstate(over="ignore"):
                    one = mix(lab.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(own.astype(np.uint64) + (to.astype(np.uint64) << np.uint64(20)) + (place.astype(np.uint64) << np.uint64(52))))
                    sums = np.add.reduceat(one, start)
                _, sample, which = np.unique(sums, return_index=True, return_inverse=True)
                same = np.flatnonzero(size == size[sample[which]])
                ok = np.zeros(len(start), bool)
                ok[same] = True
                # compare arc by arc with the sample, so that equal hashes never merge different states
                twin = np.repeat(start[sample[which]], size) + place
                twin = np.minimum(twin, len(rows) - 1)
                equal = np.logical_and.reduceat((lab == lab[twin]) & (own == own[twin]) & (to == to[twin]), start) & ok
                rep = np.where(equal, sample[which], np.arange(len(start)))
                kept = np.unique(rep)
                number = states + np.searchsorted(kept, rep)
                take = np.repeat(np.isin(np.arange(len(start)), kept), size)
                labels.append(lab[take]), weights.append(own[take]), targets.append(to[take])
                firsts.append(arcs + np.cumsum(np.append(0, size[kept][:-1])))
                arcs += int(size[kept].sum())
                states += len(kept)
                below = np.repeat(number, size).astype(np.int32)
            else:
                below = np.zeros(0, np.int32)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return cls(words, np.append(join(firsts, np.int64), arcs), join(labels, np.int32), join(weights, np.int64), join(targets, np.int32))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths with a weight, as rows of labels, and their weights."""
        state, seen, found, counted = np.array([len(self.first) - 2]), np.zeros((1, 0), np.int32), [], []
        for d in range(LONGEST):
            size = self.first[state + 1] - self.first[state]
            arc = np.repeat(self.first[state], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            seen = np.column_stack([np.repeat(seen, size, axis=0), self.label[arc]])
            state = self.target[arc]
            has = self.weight[arc] > 0
            found.append(np.pad(seen[has], ((0, 0), (0, LONGEST - d - 1))))
            counted.append(self.weight[arc][has])
        return np.concatenate(found), np.concatenate(counted)

    def compose(self, requests: np.ndarray) -> np.ndarray:
        """Weights of the requested paths (rows of labels, 0 behind the end, -1 for unknown words), 0 where there is none."""
        wide = np.int64(len(self.words) + 2)
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keys = owner * wide + self.label
        state, out, alive = np.full(len(requests), len(self.first) - 2, np.int64), np.zeros(len(requests), np.int64), np.ones(len(requests), bool)
        for d in range(requests.shape[1]):
            on = requests[:, d] != 0
            want = state * wide + requests[:, d]
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            met = on & alive & (len(keys) > 0)
            if len(keys):
                met &= keys[at] == want
                out[met], state[met] = self.weight[at[met]], self.target[at[met]]
            alive &= met | ~on
        return np.where(alive, out, 0)

    def columns(self) -> list:
        """For a row: numbers of arcs in place of where they begin, and every array in the narrowest type (its size goes first); all compressed, after their length."""
        arrays = [np.diff(self.first), self.label, self.weight, self.target]
        kinds = [np.min_scalar_type(int(a.max())) if len(a) else np.dtype("u1") for a in arrays]
        plain = [b"\n".join(self.words), *(bytes([k.itemsize]) + a.astype(k).tobytes() for a, k in zip(arrays, kinds))]
        return [len(x).to_bytes(8, "little") + _CODEC.compress(x, asbytes=True) for x in plain]

    @classmethod
    def read(cls, *columns: bytes) -> Automaton:
        words, *arrays = (_CODEC.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in columns)
        size, label, weight, target = (np.frombuffer(a, f"u{a[0]}", offset=1) for a in arrays)
        return cls(words.split(b"\n") if words else [], np.append(0, np.cumsum(size, dtype=np.int64)), label.astype(np.int32), weight.astype(np.int64), target.astype(np.int32))


def united(automata: list[Automaton], least: int = 1) -> Automaton:
    """The union with weights summed, of paths that occur at least so often."""
    words = sorted(set().union(*(a.words for a in automata)))
    place = {w: i + 1 for i, w in enumerate(words)}
    every = []
    for a in automata:
        rows, weight = a.paths()
        every.append((np.array([0, *(place[w] for w in a.words)], np.int32)[rows], weight))
    rows, weight = np.concatenate([r for r, _ in every]), np.concatenate([w for _, w in every])
    rows, weight = summed(rows, weight)
    rows, weight = rows[weight >= least], weight[weight >= least]
    return compact(words, rows, weight)


def summed(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and the sums of their weights."""
    if not len(rows):
        return rows, weight
    order = np.lexsort(rows.T[::-1])
    rows, weight = rows[order], weight[order]
    start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[start], np.add.reduceat(weight, start)


def compact(words: list[bytes], rows: np.ndarray, weight: np.ndarray) -> Automaton:
    """An automaton of the rows with only the words that they use (words in order, so rows stay in order)."""
    used = np.unique(rows)
    used = used[used > 0]
    place = np.zeros(len(words) + 1, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    return Automaton.build([words[i - 1] for i in used.tolist()], place[rows], weight)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of single words; entry 0 stands for none."""
    if not words:
        return np.zeros(1, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.append(np.uint64(0), SpanHash(data)(np.append(0, ends[:-1]), ends))


def prefix_hash(rows: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first so many words of each path."""
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, d]])
    return out


def range_of(rows: np.ndarray, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the hash that a path lies in: of the first word of pairs, of the first three of longer paths, each with ranges of their own behind those of single words."""
    level = (rows[:, 1] > 0).astype(np.int32) + (rows[:, 2] > 0)
    h = prefix_hash(rows, hashes, 1)
    h[level == 2] = prefix_hash(rows[level == 2], hashes, 3)
    return ((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int32) + ranges * level


def filter_bits(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Two places in a filter for each word or pair (rows of two labels)."""
    h = prefix_hash(rows, hashes, 2)
    return np.stack([h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS)], 1).astype(np.int64)


def may_hold(known: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = filter_bits(rows, hashes)
    return (known[bits >> 3] >> (bits & 7) & 1).all(axis=1)


def coded(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words in order, and the sequence of their places from 1, with 0 between pieces and LONGEST times at the end."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[b"\n"]
    raw = "\n".join(texts).encode("utf-8", "surrogatepass").translate(_PIECES)
    codes = np.fromiter(map(number.__getitem__, _TOKEN.findall(raw)), np.int32)
    words = sorted(w for w in number if w != b"\n")
    place = np.zeros(len(number), np.int32)
    place[[number[w] for w in words]] = np.arange(1, len(words) + 1)
    return words, np.append(place[codes], np.zeros(LONGEST, np.int32))


def counted(codes: np.ndarray, first: int, last: int, starts: Callable[[np.ndarray, int], np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of first .. last words, in order, and their counts; starts(at, n): which of the places begin one of n words.

    An n-gram is known by the number of its first n - 1 words among all such and its last word, so each size is one sort of numbers.
    """
    width = np.int64(codes.max(initial=0)) + 1
    found, times, ids = [np.zeros((0, LONGEST), np.int32)], [np.zeros(0, np.int64)], codes[at].astype(np.int64)
    for n in range(1, last + 1):
        keep = starts(at, n)
        at, ids = at[keep], ids[keep]
        if n > 1:
            ids = ids * width + codes[at + n - 1]
        distinct, where, ids, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        if n >= first:
            rows = np.zeros((len(distinct), LONGEST), np.int32)
            for d in range(n):
                rows[:, d] = codes[at[where] + d]
            found.append(rows), times.append(count.astype(np.int64))
    return summed(np.concatenate(found), np.concatenate(times)) if last > first else (found[-1], times[-1])


def shard_automata(texts: list[str], ranges: int, level: int, known: np.ndarray | None) -> Iterator[tuple[int, Automaton]]:
    """One shard's automata by range: of single words (level 1), of pairs (2) whose words the filter may hold, of longer phrases (3) whose pairs it may hold."""
    words, codes = coded(texts)
    hashes = word_hashes(words)
    at = np.flatnonzero(codes > 0)
    if level == 1:
        rows, count = counted(codes, 1, 1, lambda at, n: codes[at] > 0, at)
    elif level == 2:
        often = np.append(False, may_hold(known, np.stack([np.arange(1, len(words) + 1), np.zeros(len(words), np.int64)], 1), hashes)) if words else np.zeros(1, bool)
        often = often[codes]
        rows, count = counted(codes, 2, 2, lambda at, n: often[at + n - 1], at)
    else:
        two = at[codes[at + 1] > 0]
        often = np.zeros(len(codes), bool)
        often[two] = may_hold(known, np.stack([codes[two], codes[two + 1]], 1), hashes)
        at = np.flatnonzero(often[:-1] & often[1:])
        rows, count = counted(codes, 3, LONGEST, lambda at, n: often[at + max(n - 2, 0)], at)
    part = range_of(rows, hashes, ranges)
    order = np.argsort(part, kind="stable")
    border = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for a, b in zip(border[:-1], border[1:]):
        some = order[a:b]
        yield int(part[some[0]]), compact(words, rows[some], count[some])


def shards(docs: DataFrame, ranges: int, level: int, known=None) -> DataFrame:
    """lang, part and an automaton: one row for each shard and range. known: the broadcast filter of the level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def flush(lang: str) -> pa.RecordBatch | None:
            size[lang] = 0
            rows = [[lang, part, *a.columns()] for part, a in shard_automata(held.pop(lang), ranges, level, known.value if known else None)]
            return batch_of(rows, "lang string, part int") if rows else None

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] >= SHARD and (out := flush(lang)):
                    yield out
                elif sum(size.values()) >= 2 * SHARD and (out := flush(max(size, key=size.get))):
                    yield out
        for lang in list(held):
            if out := flush(lang):
                yield out

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"lang string, part int, {AUTOMATON}")


_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def batch_of(rows: list[list], head: str, automaton: bool = True) -> pa.RecordBatch:
    fields = [f.split() for f in (f"{head}, {AUTOMATON}" if automaton else head).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[kind]) for c, (_, kind) in zip(zip(*rows), fields)] if rows else [pa.array([], _TYPES[kind]) for _, kind in fields], [name for name, _ in fields])


def _automata(table: pa.Table) -> list[Automaton]:
    names = [f.split()[0] for f in AUTOMATON.split(", ")]
    return [Automaton.read(*row) for row in zip(*(table.column(c).to_pylist() for c in names))]


def unite(made: DataFrame, least: int) -> DataFrame:
    """lang, part, n_words (occurrences of single words in the range, rare ones too) and the automaton of paths that occur at least so often."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        every = _automata(table)
        n = sum(int(w[(rows[:, 1] == 0)].sum()) for rows, w in (a.paths() for a in every))
        out = united(every, least)
        return pa.Table.from_batches([batch_of([[key[0].as_py(), key[1].as_py(), n, *out.columns()]], "lang string, part int, n_words bigint")])

    return made.groupBy("lang", "part").applyInArrow(run, f"lang string, part int, n_words bigint, {AUTOMATON}")


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The filter of all paths (words or pairs) of the automata: at most FILTER_BITS / 64 numbers come to the driver, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in _automata(pa.Table.from_batches([batch])):
                bits = np.unique(filter_bits(a.paths()[0], word_hashes(a.words)))
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(np.int64(1), bits & 63))], ["cell", "bits"])

    cells = frequent.select(*[f.split()[0] for f in AUTOMATON.split(", ")]).mapInArrow(run, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    full = np.zeros(FILTER_BITS // 64, np.int64)
    for r in cells.collect():
        full[r["cell"]] = r["bits"]
    return full.view(np.uint8)


def listed(frequent: DataFrame) -> DataFrame:
    """lang, words, f: the paths of the automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, a in zip(batch.column(0).to_pylist(), _automata(pa.Table.from_batches([batch]))):
                rows, weight = a.paths()
                text = [b" ".join(a.words[i - 1] for i in row if i).decode("utf-8", "surrogatepass") for row in rows.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.string()), pa.array(weight, pa.int64())], ["lang", "phrase", "f"])

    return frequent.select("lang", *[f.split()[0] for f in AUTOMATON.split(", ")]).mapInArrow(run, "lang string, phrase string, f bigint")


def _coded_requests(phrases: list[str], words: list[bytes]) -> np.ndarray:
    place = {w: i + 1 for i, w in enumerate(words)}
    out = np.zeros((len(phrases), LONGEST), np.int32)
    for i, p in enumerate(phrases):
        row = [place.get(w, -1) for w in p.encode("utf-8", "surrogatepass").split(b" ")]
        out[i, : len(row)] = row
    return out


def look_up(parts: DataFrame, frequent: DataFrame, ranges: int) -> DataFrame:
    """lang, phrase, f: how often each of the distinct phrases (lang, phrase) occurs, by composition with its range's automaton."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(1).to_pylist()
            words = sorted({w for p in phrases for w in p.encode("utf-8", "surrogatepass").split(b" ")})
            part = range_of(_coded_requests(phrases, words), word_hashes(words), ranges)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32()), batch.column(1)], ["lang", "part", "phrase"])

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        phrases = asked.column("phrase").to_pylist()
        automata = _automata(held)
        count = automata[0].compose(_coded_requests(phrases, automata[0].words)) if automata else np.zeros(len(phrases), np.int64)
        return pa.Table.from_arrays([asked.column("lang"), asked.column("phrase"), pa.array(count, pa.int64())], ["lang", "phrase", "f"])

    requests = parts.select("lang", "phrase").distinct().mapInArrow(dealt, "lang string, part int, phrase string")
    return requests.groupBy("lang", "part").cogroup(frequent.groupBy("lang", "part")).applyInArrow(run, "lang string, phrase string, f bigint")


def mine(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by the score of their worst cut.

    Dropped are phrases that a longer candidate holds and that never occur without it (such a chain of ever longer
    phrases has equal counts all along, so the next longer one is enough to look at).
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, known = [], None
    for level in (1, 2, 3):
        levels.append(written(unite(shards(docs, ranges, level, known), least), f"colloc-{level}"))
        known = spark.sparkContext.broadcast(filter_of(levels[-1])) if level < 3 else None
    frequent = functools.reduce(DataFrame.unionByName, levels).drop("n_words")
    totals = levels[0].groupBy("lang").agg(F.sum("n_words").alias("n"))

    phrases = written(listed(frequent), "colloc-phrases").withColumn("w", F.split("phrase", " "))
    cuts = phrases.where(F.size("w") > 1).select("lang", "phrase", F.col("f").alias("a"), F.size("w").alias("m"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("w", 1, F.col("k")), " "), "right": F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ")}).drop("w")
    asked = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase"))
    found = written(look_up(asked, frequent, ranges), "colloc-parts")
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # languages are as few as the values of a column that names them; their totals are one row each
    cuts = cuts.join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    cuts = written(cuts.withColumn("score", score), "colloc-cuts")
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
    inside = cuts.where(((F.col("k") == F.col("m") - 1) & (F.col("m") > 2) & (F.col("l") == F.col("a")))).select("lang", F.col("left").alias("phrase")).unionByName(
        cuts.where((F.col("k") == 1) & (F.col("m") > 2) & (F.col("r") == F.col("a"))).select("lang", F.col("right").alias("phrase")))
    kept = worst.join(inside.distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "c.*")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_slice = F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best))
    tops = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).withColumn("rank", in_slice).where(F.col("rank") <= top)
    ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
