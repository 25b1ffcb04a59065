"""Window helpers over the dense panel: full frames, tie-aware ranks, buckets, running compositions, quantiles by selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session")


def by_session() -> WindowSpec:
    return Window.partitionBy("session")


def trailing(n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end `lag` rows before the current one."""
    return by_symbol().rowsBetween(-(n - 1) - lag, -lag)


def gated(agg: Column, x: Column, n: int, frame: WindowSpec) -> Column:
    """agg over frame where the frame holds n values of x, else NULL."""
    return F.when(F.count(x).over(frame) >= n, agg.over(frame))


def rank_pct(x: Column, by: list[str]) -> Column:
    """Rank of x among non-null values by group, ties averaged, over their count."""
    w = Window.partitionBy(*by)
    first = F.rank().over(w.orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (first + (ties - 1) / 2) / F.count(x).over(w))


def quantile_bucket(position: Column, n: Column, q: int) -> Column:
    """Bucket 1 .. q of the position-th (from 1) of n ranked rows, as equal-width cuts of ranks give it."""
    return F.greatest(F.lit(1), F.ceil((position - 1) * q / (n - 1))).cast("int")


def finite(x: Column) -> Column:
    """x, or NULL where it is not a number or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def out(x: Column, digits: int = 6) -> Column:
    """Rounded for output; never -0.0."""
    return F.round(x, digits) + F.lit(0.0)


def spread(rows: DataFrame, by: list[str], each: int = 5_000) -> DataFrame:
    """rows dealt by their key into tasks of about `each` rows, at least as many as there are cores.

    For small rows of which each becomes many or costs much: a file of a few megabytes would be one task whatever it grows
    into. Groups and windows whose keys include `by` need no other shuffle.
    """
    tasks = max(-(-rows.count() // each), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *by)


#: Rows of a block whose maps are composed one after the other.
BLOCK = 1024


def composed(maps: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """by, pos, a, b: the composition x -> a x + b of each group's maps (by, pos from 0 without gaps, a, b) up to and including pos.

    Blocks of so many positions are composed side by side; their totals are maps again and are composed in the same
    way, and every block starts from what lies before it. A group of n rows takes log(n) / log(block) rounds.
    """
    most = maps.agg(F.max("pos")).first()[0] or 0
    kinds = dict(maps.dtypes)
    cut = maps.withColumn("_block", F.floor(F.col("pos") / block))
    key = [*by, "_block"]

    def run(batches):
        now, a, b = None, 1.0, 0.0
        for pdf in batches:
            out_a, out_b = [], []
            for *k, x, y in pdf[[*key, "a", "b"]].itertuples(index=False):
                if k != now:
                    now, a, b = k, 1.0, 0.0
                a, b = a * x, b * x + y
                out_a.append(a)
                out_b.append(b)
            yield pdf.assign(a=out_a, b=out_b)

    schema = f"{', '.join(f'`{c}` {kinds[c]}' for c in by)}, pos {kinds['pos']}, a double, b double, _block bigint"
    inside = cut.select(*by, "pos", "a", "b", "_block").repartition(*key).sortWithinPartitions(*key, "pos").mapInPandas(run, schema)
    if most < block:
        return inside.drop("_block")
    inside = written(inside, "composed")
    totals = inside.groupBy(*key).agg(F.max_by(F.struct("a", "b"), "pos").alias("t")).select(*by, F.col("_block").alias("pos"), "t.a", "t.b")
    before = composed(totals, by, block).select(*by, (F.col("pos") + 1).alias("_block"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    full = inside.join(before, key, "left")
    return full.select(*by, "pos", (F.col("a") * F.coalesce("_a", F.lit(1.0))).alias("a"), (F.col("a") * F.coalesce("_b", F.lit(0.0)) + F.col("b")).alias("b"))


def exact_quantiles(rows: DataFrame, by: list[str], x: str, qs: list[float], slices: int = 32) -> DataFrame:
    """by, n, q, value: quantiles (linear between neighbours) of each group's values, by selection.

    Sketched quantiles, of bounded size for each group, cut its values into slices; slices are counted, and only those
    that hold a wanted rank are sorted. No aggregate keeps a group's distinct values. A group's slices are as good as the sketch, but the
    result is exact whatever they are. A sketch depends on the order in which its parts meet, so cuts are written once: counts and
    values must be sliced alike.
    """
    have = rows.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, F.col(x).cast("double").alias("_x"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = have.groupBy(*by).agg(F.percentile_approx("_x", shares, 1000).alias("_cuts"), F.count(F.lit(1)).alias("n"))
    cuts = written(cuts, "cuts")
    # equal values share a slice; a slice's number is how many cuts lie below the value
    sliced = have.join(cuts, by).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).select(*by, "n", "_slice", "_x")
    counts = sliced.groupBy(*by, "n", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.withColumn("_end", F.sum("_size").over(w)).withColumn("_start", F.col("_end") - F.col("_size"))
    place = (F.col("n") - 1) * F.col("q")
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    wanted = ranges.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("_rank", F.explode(ranks)).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
    few = sliced.join(wanted.select(*by, "_slice", "_start").distinct(), [*by, "_slice"])
    ranked = few.withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_x")) - 1).select(*by, "_rank", "_x")
    met = ranked.join(wanted.select(*by, "n", "q", "_rank"), [*by, "_rank"])
    low, high = F.min("_x"), F.max("_x")
    return met.groupBy(*by, "n", "q").agg((low + (F.first(place) - F.floor(F.first(place))) * (high - low)).alias("value"))
