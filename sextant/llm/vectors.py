"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one class. Every class has a neighbour list: its LIST best neighbours, enlarged where they
are all links, so that it holds every link found, up to MOST. The first lists come from random hyperplane tables: the
bits of a label's codes follow its size, and the number of its tables the chance (at most MISS) that a pair at the
threshold meets in none; labels of up to WHOLE vectors are one bucket. NN-descent then refines the lists: a vector's
neighbours, in both directions, meet at it, and each is told of those it meets there that its list should hold; rounds
go on until none is told of anything new. Links are the list entries at or above the threshold.

A vector with more than MOST links is crowded. Its list stays short, and its links are found exactly: crowded vectors
are cut into blocks, each with a centre and a radius, and every vector of the label that can reach the block by the
triangle inequality is compared with all of it. So dense groups cost no list entry for each pair, and no link is lost.

An audit compares the stated query set (every class with an id divisible by 20) with all vectors of its label, in blocks, and
gives the share of their links that was found. While it is below 1, another set of tables is added; the last attempt
compares labels whole, in blocks.

Links only join vectors of equal, non-null labels and equal length; null, empty, zero and non-finite vectors link with
nothing and stand alone (null ids do not keep a vector from linking; a component of null ids only has a null id). Repeated ids each get a row and share the smallest id of their class; ties between neighbours
are broken by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .graph import components

#: Entries of a list, and the most links that it is enlarged for.
LIST, MOST = 16, 64
#: The chance at most that a link at the threshold meets in no table, the vectors of a bucket on average, and of a label that is one bucket.
MISS, BUCKET, WHOLE = 1e-6, 96, 64
#: Vectors of a block where a bucket, or those around a vector, are many; of a block of crowded vectors.
BLOCK, AROUND, CROWD = 1000, 512, 512
#: Centres of crowded blocks that are broadcast, at most.
MOST_CENTRES = 20_000
#: Above all ids that occur: numbers that stand for classes without ids begin here.
NO_ID = 1 << 61
ATTEMPTS = 3


def usable(vectors: DataFrame) -> DataFrame:
    """rep, first (its smallest vec_id), label, embedding, copies, asked (whether a vec_id is divisible by 20): one row per distinct usable vector of a label.

    Where all ids are null, rep is a number from NO_ID up that stands for the class.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", "label", v.cast("array<double>").alias("embedding"))
    asked = F.coalesce(F.max(F.col("vec_id") % 20 == 0), F.lit(False))
    found = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), asked.alias("asked"))
    stand_in = F.xxhash64("label", "embedding").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    return found.select(F.coalesce("first", stand_in).alias("rep"), "first", "label", "embedding", "copies", "asked")


def matrix(vecs) -> np.ndarray:
    """Unit vectors packed as doubles, as rows."""
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)


def plan(n: int, t: float, miss: float = MISS, bucket: int = BUCKET, whole: int = WHOLE) -> tuple[int, int]:
    """Bits of a code and number of tables for a label of n vectors; 0 bits: one bucket."""
    if n <= whole:
        return 0, 1
    bits = max(1, int(np.log2(n / bucket)))
    meet = (1 - np.arccos(min(t, 1.0)) / np.pi) ** bits
    return bits, 1 if meet >= 1 else int(np.ceil(np.log(miss) / np.log1p(-meet)))


def coded(every: DataFrame, t: float, attempt: int) -> DataFrame:
    """rep, space, vec (unit, packed), copies, codes (one for each table): written. space: label and length as a number."""
    spaced = every.withColumn("space", F.xxhash64("label", F.size("embedding")))
    sizes = spaced.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE)
    sized = spaced.join(sizes, "space", "left").select("rep", "space", "embedding", "copies", F.coalesce("n", F.lit(0)).alias("n"))

    settings = MISS, BUCKET, WHOLE

    def run(batches):
        for batch in batches:
            width = batch["embedding"].str.len()
            for (n, w), few in batch.groupby([batch["n"], width]):
                x = np.concatenate(few["embedding"].to_numpy()).reshape(len(few), w)
                x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                bits, number = (0, 1) if attempt + 1 == ATTEMPTS else plan(n, t, *settings)
                codes = np.zeros((len(few), number), np.int64)
                for k in range(number if bits else 0):
                    planes = np.random.default_rng([7, attempt * number + k]).normal(size=(w, bits))
                    codes[:, k] = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({"rep": few["rep"], "space": few["space"], "vec": [r.tobytes() for r in x], "copies": few["copies"], "codes": list(codes)})

    return written(sized.mapInPandas(run, "rep bigint, space bigint, vec binary, copies bigint, codes array<bigint>"), "vectors-coded")


def grouped(batches, keys: list[str]):
    """Arrays of the columns for each run of rows of equal keys (sorted rows, keys of integers)."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        columns = [batch[c].to_numpy() for c in batch.columns]
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in pairwise(cut):
            now = tuple(k[lo])
            if now != last and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            last = now
            held.append([c[lo:hi] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


EDGE = "a bigint, b bigint, sim double, copies bigint"


def edges_frame(a, b, sim, copies) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b, "sim": sim, "copies": copies})


def met(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, floor: float, t: float) -> pd.DataFrame:
    """What the lists of vectors that meet should hold of each other: the LIST best of at least `floor`, and all links up to MOST.

    Of a vector with more links come the LIST best, and an edge to itself that marks it as crowded.
    """
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    busy = np.flatnonzero((s >= floor).any(1))
    if not len(busy):
        return edges_frame(ids[:0], ids[:0], s[0, :0], copies[:0])
    s = s[busy]
    links = (s >= t).sum(1)
    keep = np.minimum(np.where(links > MOST, LIST, np.maximum(LIST, links)), s.shape[1])
    wide = int(keep.max())
    at = np.argpartition(-s, wide - 1, 1)[:, :wide] if wide < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    order = np.argsort(-np.take_along_axis(s, at, 1), 1, kind="stable")
    at = np.take_along_axis(at, order, 1)
    sims = np.take_along_axis(s, at, 1)
    chosen = (np.arange(at.shape[1]) < keep[:, None]) & (sims >= floor)
    full = ids[busy[links > MOST]]
    a, b = np.concatenate([np.repeat(ids[busy], chosen.sum(1)), full]), np.concatenate([ids[at[chosen]], full])
    return edges_frame(a, b, np.concatenate([sims[chosen], np.full(len(full), 2.0)]), np.concatenate([copies[at[chosen]], np.zeros(len(full), np.int64)]))


def tables(coded_: DataFrame, floor: float, t: float) -> DataFrame:
    """Edges a, b, sim, copies of vectors of one bucket; buckets of many are cut into blocks that meet in pairs."""
    key = ["space", "table", "code"]
    place = F.posexplode("codes").alias("table", "code")
    counts = coded_.select("space", place).groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("k")).where("k > 1")
    counts = written(counts, "vectors-large")  # its size is known to the join: none, or few
    rows = coded_.select("rep", "space", "vec", "copies", place).join(counts, key, "left").withColumn("k", F.coalesce(F.col("k") * 2, F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "vec", "copies")
    key += ["i", "j"]

    def run(batches):
        for *_, ids, vecs, copies in grouped(batches, key):
            if len(ids) > 1:
                yield met(ids, matrix(vecs), copies, floor, t)

    return rows.repartition(*key).sortWithinPartitions(*key, "rep").mapInPandas(run, EDGE)


def listed(edges: DataFrame, t: float) -> DataFrame:
    """rep, list (of b, sim, copies, best first), crowded: a class's distinct edges cut to its list."""
    entry = F.struct(F.col("sim"), (-F.col("b")).alias("_b"), F.col("b"), F.col("copies"))
    each = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("copies").alias("copies"))
    sorted_ = each.groupBy(F.col("a").alias("rep")).agg(F.sort_array(F.collect_list(entry), False).alias("l"))
    sorted_ = sorted_.select("rep", F.filter("l", lambda x: x["b"] != F.col("rep")).alias("l"), F.exists("l", lambda x: x["b"] == F.col("rep")).alias("marked"))
    links = F.size(F.filter("l", lambda x: x["sim"] >= t))
    crowded = F.col("marked") | (links > MOST)
    kept = F.slice("l", F.lit(1), F.when(crowded, F.lit(LIST)).otherwise(F.greatest(F.lit(LIST), links)))
    return sorted_.select("rep", F.transform(kept, lambda x: F.struct(x["b"].alias("b"), x["sim"].alias("sim"), x["copies"].alias("copies"))).alias("list"), crowded.alias("crowded"))


def told(nodes: DataFrame, floor: float, t: float) -> DataFrame:
    """A round of NN-descent: edges a, b, sim, copies that a's list should hold and does not.

    nodes: rep, vec, copies, list, crowded. Neighbours and reverse neighbours meet at a vector; where its reverse ones
    are many, they are dealt to several places, each with all its own neighbours. Crowded vectors are told nothing.
    """
    out = nodes.where(F.size("list") > 0).select(F.col("rep").alias("hub"), F.explode("list.b").alias("rep"), F.lit(0).alias("back"))
    into = out.select(F.col("rep").alias("hub"), F.col("hub").alias("rep"), F.lit(1).alias("back"))
    places = into.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / AROUND).cast("int").alias("k"))
    all_ = out.unionByName(into).groupBy("hub", "rep").agg(F.min("back").alias("back")).join(places, "hub", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    part = F.when(F.col("back") == 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")))
    all_ = all_.select("hub", F.explode(part).alias("part"), "rep")
    full = F.size("list") >= LIST
    least = F.when(F.col("crowded"), F.lit(2.0)).when(full, F.least(F.lit(t), F.element_at("list.sim", LIST))).otherwise(F.lit(floor))
    about = nodes.select("rep", "vec", "copies", F.col("list.b").alias("known"), least.alias("least"))
    rows = all_.join(about, "rep").select("hub", "part", "rep", "vec", "copies", "known", "least")

    def run(batches):
        for _, _, ids, vecs, copies, known, least_ in grouped(batches, ["hub", "part"]):
            if len(ids) < 2:
                continue
            x = matrix(vecs)
            s = x @ x.T
            np.fill_diagonal(s, -2.0)
            for i in np.flatnonzero((s >= least_[:, None]).any(1)):
                j = np.flatnonzero(s[i] >= least_[i])
                j = j[~np.isin(ids[j], known[i])]
                if len(j):
                    full = int((s[i] >= t).sum() > MOST)
                    j = np.append(j[np.argsort(-s[i, j], kind="stable")][: LIST if full else MOST], np.full(full, i))
                    yield edges_frame(np.full(len(j), ids[i]), ids[j], np.where(j == i, 2.0, s[i, j]), copies[j])

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "rep").mapInPandas(run, EDGE)


def with_lists(about: DataFrame, edges: DataFrame, t: float, was_crowded: DataFrame | None = None) -> DataFrame:
    """rep, space, vec, copies, list, crowded of every class, written; a class once crowded stays so."""
    found = about.select("rep", "space", "vec", "copies").join(listed(edges, t), "rep", "left")
    crowded = F.coalesce("crowded", F.lit(False))
    if was_crowded is not None:
        found = found.join(was_crowded.select("rep", F.col("crowded").alias("was")), "rep", "left")
        crowded |= F.coalesce("was", F.lit(False))
    empty = F.array().cast("array<struct<b:bigint,sim:double,copies:bigint>>")
    return written(found.select("rep", "space", "vec", "copies", F.coalesce("list", empty).alias("list"), crowded.alias("crowded")), "vectors-lists")


def as_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("rep").alias("a"), F.explode("list").alias("e")).select("a", "e.b", "e.sim", "e.copies")


def descend(nodes: DataFrame, floor: float, t: float) -> DataFrame:
    """Rounds until no list is told of anything new."""
    while True:
        news = written(told(nodes, floor, t), "vectors-news")
        if news.isEmpty():
            return nodes
        before, nodes = nodes, with_lists(nodes, as_edges(nodes).unionByName(news), t, nodes)
        discard(before, news)


def crowds(nodes: DataFrame, roots: DataFrame, t: float) -> DataFrame:
    """rep, others (links of each crowded class, by copies), a, b: and the roots a, b of components that these links join.

    Rows have either rep and others, or a and b.
    """
    rooted = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("rep", "space", "vec", "copies", "crowded", F.coalesce("root", "rep").alias("root"))
    rooted = written(rooted, "vectors-rooted")
    full = rooted.where("crowded")
    number = full.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("k"))
    members = full.join(number, "root").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    members = written(members.select("root", "part", "k", "space", "rep", "vec", "copies"), "vectors-crowded")
    angle = float(np.arccos(min(t, 1.0))) + 1e-7

    def centre(batches):
        for root, part, k, space, _, vecs, _ in grouped(batches, ["root", "part"]):
            x = matrix(vecs)
            c = x.mean(0)
            c /= max(np.sqrt(c @ c), 1e-300)
            reach = float(np.arccos(np.clip(x @ c, -1, 1)).max()) + angle
            yield pd.DataFrame({"space": space[:1], "root": root[:1], "part": part[:1], "k": k[:1], "centre": [c.tobytes()], "reach": [reach]})

    dealt = members.repartition("root", "part").sortWithinPartitions("root", "part")
    centres = written(dealt.mapInPandas(centre, "space bigint, root bigint, part int, k int, centre binary, reach double"), "vectors-centres")
    about = rooted.select("rep", "space", "vec", "copies", F.col("root").alias("own"))
    if centres.limit(MOST_CENTRES + 1).count() <= MOST_CENTRES:
        few = centres.toPandas()
        groups = {k: (g[["root", "part", "k"]].to_numpy(), matrix(g["centre"].to_numpy()), g["reach"].to_numpy()) for k, g in few.groupby("space")}
        shared = nodes.sparkSession.sparkContext.broadcast(groups)

        def near(batches):
            for batch in batches:
                for space, g in batch.groupby("space"):
                    if space in shared.value:
                        block, c, reach = shared.value[space]
                        i, j = np.nonzero(np.arccos(np.clip(matrix(g["vec"].to_numpy()) @ c.T, -1, 1)) <= reach)
                        yield pd.DataFrame(block[j], columns=["root", "part", "k"]).assign(**{k: g[k].to_numpy()[i] for k in ("rep", "vec", "copies", "own")})

        candidates = about.mapInPandas(near, "root bigint, part int, k int, rep bigint, vec binary, copies bigint, own bigint")
    else:
        candidates = about.join(centres.select("space", "root", "part", "k"), "space").select("root", "part", "k", "rep", "vec", "copies", "own")
    # a block meets its candidates in as many shares as its component has blocks
    side = lambda df, n, share: df.select("root", "part", share.alias("share"), F.lit(n).alias("side"), "rep", "vec", "copies", "own")
    rows = side(members.withColumn("own", F.col("root")), 0, F.explode(F.sequence(F.lit(0), F.col("k") - 1))).unionByName(
        side(candidates, 1, F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")))

    def compare(batches):
        now, ids, x, counts, first = None, None, None, None, []

        def done():
            return pd.DataFrame({"rep": ids, "others": counts, "a": None, "b": None})

        for batch in batches:
            if not len(batch):
                continue
            k = batch[["root", "part", "share", "side"]].to_numpy()
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for lo, hi in pairwise(cut):
                root, part, share, of = k[lo]
                g = batch.iloc[lo:hi]
                if (root, part, share) != now:
                    if ids is not None:
                        yield done()
                    now, ids, first = (root, part, share), None, []
                if not of:
                    first.append(g)
                    continue
                if ids is None:
                    all_ = pd.concat(first)
                    ids, x = all_["rep"].to_numpy(), matrix(all_["vec"].to_numpy())
                    counts = np.zeros(len(ids), np.int64)
                other, copies = g["rep"].to_numpy(), g["copies"].to_numpy()
                for at in range(0, len(g), BLOCK):
                    few = slice(at, at + BLOCK)
                    linked = (matrix(g["vec"].to_numpy()[few]) @ x.T >= t) & (other[few, None] != ids)
                    counts += copies[few] @ linked
                    strange = np.unique(g["own"].to_numpy()[few][linked.any(1)])
                    strange = strange[strange != root]
                    yield pd.DataFrame({"rep": None, "others": None, "a": strange, "b": root})
        if ids is not None:
            yield done()

    placed = rows.repartition("root", "part", "share").sortWithinPartitions("root", "part", "share", "side")
    return written(placed.mapInPandas(compare, "rep bigint, others bigint, a bigint, b bigint"), "vectors-crowds")


def audit(nodes: DataFrame, asked: DataFrame, counted: DataFrame, t: float) -> float:
    """Share of the links of the query set (asked: rep) that were found (counted: rep, others), by comparing each query with all vectors of its label.

    Queries are cut into blocks and the vectors into shares, so that no task holds more than a block or reads more than
    a share.
    """
    key = ["space", "block", "share"]
    queries = nodes.join(asked, "rep", "left_semi").select("rep", "space", "vec", "copies")
    of = queries.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    n = nodes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / (8 * BLOCK)).cast("int").alias("shares")).join(of, "space")
    deal = lambda c, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = queries.join(n, "space").select("space", deal("blocks", 1).alias("block"), all_of("shares").alias("share"), F.lit(0).alias("side"), "rep", "vec", "copies")
    two = nodes.select("rep", "space", "vec", "copies").join(n, "space").select("space", all_of("blocks").alias("block"), deal("shares", 2).alias("share"), F.lit(1).alias("side"), "rep", "vec", "copies")

    def compare(batches):
        now, ids, q = None, None, None
        for space, block, share, side, rep_, vecs, copies in grouped_sides(batches, key):
            if side == 0:
                now, ids, q = (space, block, share), rep_, matrix(vecs)
            elif now == (space, block, share):
                true = np.zeros(len(ids), np.int64)
                for at in range(0, len(rep_), BLOCK):
                    few = slice(at, at + BLOCK)
                    true += ((q @ matrix(vecs[few]).T >= t) & (ids[:, None] != rep_[few])) @ copies[few]
                yield pd.DataFrame({"rep": ids[true > 0], "true": true[true > 0]})

    placed = one.unionByName(two).repartition(*key).sortWithinPartitions(*key, "side")
    true = placed.mapInPandas(compare, "rep bigint, true bigint").groupBy("rep").agg(F.sum("true").alias("true"))
    r = true.join(counted, "rep", "left").agg(F.sum("true"), F.sum(F.least(F.coalesce("others", F.lit(0)), "true"))).first()
    return 1.0 if not r[0] else r[1] / r[0]


def grouped_sides(batches, key: list[str]):
    """key .., side, and arrays of rep, vec and copies: side 0 of a key as one, side 1 batch by batch."""
    first, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[[*key, "side"]].to_numpy()
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in pairwise(cut):
            part = [batch[c].to_numpy()[lo:hi] for c in ("rep", "vec", "copies")]
            *now, side = k[lo].tolist()
            if side == 0:
                first, last = [*first, part] if last == now else [part], now
                continue
            if first and last == now:
                yield *now, 0, *(np.concatenate(c) for c in zip(*first))
                first = []
            yield *now, 1, *part


def near_duplicates(vectors: DataFrame, t: float = 0.98, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label). report: gets recall, attempts, and the recall before and after the first descent."""
    vectors = vectors.select("vec_id", "embedding", "label")
    every = written(usable(vectors), "vectors-classes")
    asked = every.where("asked").select("rep")
    floor = 2 * t * t - 1  # two steps along links at the threshold lead no further away
    nodes = None
    for attempt in range(ATTEMPTS):
        about = coded(every, t, attempt)
        edges = tables(about, floor, t)
        if nodes is not None:
            edges = edges.unionByName(as_edges(nodes))
        lists = with_lists(about, edges, t, nodes)
        if report is not None and not attempt:
            early = as_edges(lists).where(F.col("sim") >= t).groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
            report["before"] = audit(lists, asked, early, t)
        nodes = descend(lists, floor, t)
        links = as_edges(nodes).where(F.col("sim") >= t)
        roots = written(components(links.select("a", "b")), "vectors-roots")
        counted = links.groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
        if not nodes.where("crowded").isEmpty():
            more = crowds(nodes, roots, t)
            exact = more.where(F.col("rep").isNotNull()).groupBy("rep").agg(F.sum("others").alias("others"))
            counted = counted.join(nodes.where("crowded").select("rep"), "rep", "left_anti").unionByName(exact)
            joined = components(more.where(F.col("a").isNotNull()).select("a", "b")).select(F.col("node").alias("old"), F.col("root").alias("new"))
            roots = roots.join(joined, roots["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
            lone = joined.join(roots.select("node"), joined["old"] == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
            roots = written(roots.unionByName(lone), "vectors-roots")
        counted = written(counted, "vectors-counts")
        recall = audit(nodes, asked, counted, t)
        if report is not None and not attempt:
            report["after"] = recall
        if recall >= 1.0:
            break
    if report is not None:
        report.update(recall=recall, attempts=attempt + 1)
    out = every.join(counted, "rep", "left").join(roots, every["rep"] == roots["node"], "left")
    names = every.select(F.col("rep").alias("named"), F.col("first").alias("component_id"))
    out = out.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("named"))
    of_class = out.join(names, "named").drop("named")
    keyed = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = keyed.join(of_class, ["label", "embedding"], "left")
    own = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
