"""Resampling tests: draws are rows, picked positions come from hashes, and means are joins and aggregates.

A series is numbered within its group (a symbol, a strategy), and any number of groups runs at once. What a draw picks
follows from the hash of seed, draw and position alone, so results depend neither on partitions nor on lost executors.
Sums are combined before they are shuffled; nothing is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that make a uniform number.
DIGITS = 12


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def numbered(rows: DataFrame, by: list[str], order: list[str], *columns: str) -> DataFrame:
    """by, the columns, pos (from 0) and n of each group's rows where the first column has a value."""
    clean = rows.where(F.col(columns[0]).isNotNull())
    w = Window.partitionBy(*by)
    return clean.select(*by, *columns, (F.row_number().over(w.orderBy(*order)) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))


def each_draw(rows: DataFrame, draws: int) -> DataFrame:
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def permutation_p(stats: DataFrame, drawn: DataFrame, by: list[str], draws: int) -> DataFrame:
    """by, n, stat, p: the share of draws (by, m) that reach the statistic (by, n, stat), with one added to both."""
    met = drawn.join(stats, by).groupBy(*by, "n", "stat").agg(((1 + F.count(F.when(F.col("m") >= F.col("stat"), 1))) / (draws + 1)).alias("p"))
    return met.select(*by, "n", "stat", "p")


def sign_flip_test(rows: DataFrame, by: list[str], order: list[str], x: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """by, n, stat, p of the mean against random signs."""
    s = numbered(rows, by, order, x)
    sign = F.when(uniform(F.lit(seed), F.col("draw"), F.col("pos")) < 0.5, -1.0).otherwise(1.0)
    drawn = each_draw(s, draws).groupBy(*by, "draw").agg(F.avg(F.abs(x) * sign).alias("m"))
    return permutation_p(s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("stat")), drawn, by, draws)


def bootstrap_ci(rows: DataFrame, by: list[str], order: list[str], x: str, draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 5) -> DataFrame:
    """by, n, mean, lo, hi, p_le_zero of the mean's stationary bootstrap (blocks of n^(1/3) rows on average, wrapping around).

    A draw's blocks begin at positions chosen by hash, and a block's sum is a difference of running sums, so the rows
    that meet the running sums are blocks, not draws times rows. Groups below `least` rows have no result.
    """
    s = numbered(rows, by, order, x).where(F.col("n") >= least)
    so_far = F.sum(x).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    sums = s.select(*by, (F.col("pos") + 1).alias("k"), so_far.alias("c")).unionByName(s.where("pos = 0").select(*by, F.col("pos").alias("k"), F.lit(0.0).alias("c")))
    fresh = (F.col("pos") == 0) | (uniform(F.lit(seed), F.col("draw"), F.col("pos"), F.lit("cut")) < F.pow("n", F.lit(-1 / 3)))
    b = each_draw(s.select(*by, "pos", "n"), draws).where(fresh)
    start = F.floor(uniform(F.lit(seed), F.col("draw"), F.col("pos"), F.lit("start")) * F.col("n")).cast("int")
    after = F.coalesce(F.lead("pos").over(Window.partitionBy(*by, "draw").orderBy("pos")), F.col("n").cast("int"))
    b = b.select(*by, "draw", "n", start.alias("k0"), (start + after - F.col("pos")).alias("stop"))
    b = b.select(*by, "draw", "n", "k0", F.least("stop", F.col("n").cast("int")).alias("k1"), F.greatest(F.col("stop") - F.col("n").cast("int"), F.lit(0)).alias("k2"))
    for i in ("0", "1", "2"):
        b = b.join(sums.select(*by, F.col("k").alias(f"k{i}"), F.col("c").alias(f"c{i}")), [*by, f"k{i}"])
    m = b.groupBy(*by, "draw", "n").agg((F.sum(F.col("c1") - F.col("c0") + F.col("c2")) / F.col("n")).alias("m"))
    a = (1 - level) / 2
    spread = m.groupBy(*by).agg(F.expr(f"percentile(m, {a})").alias("lo"), F.expr(f"percentile(m, {1 - a})").alias("hi"), F.avg((F.col("m") <= 0).cast("double")).alias("p_le_zero"))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean")).join(spread, by)


def blocks(sizes: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """by, draw, n, a, len: the blocks of each draw of a stationary bootstrap over n positions, from sizes (by, n).

    Lengths are geometric with mean n^(1/3), by inversion of a hash, so that rows are blocks from the start. More are drawn than n positions
    take all but surely (six deviations); should they not do, the last one runs on to the end.
    """
    p = F.pow("n", F.lit(-1 / 3))
    most = F.ceil(F.col("n") * p + 6 * F.sqrt(F.col("n") * p) + 12).cast("int")
    drawn = each_draw(sizes.select(*by, "n", most.alias("_m")), draws).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    gap = 1 + F.floor(F.log(uniform(F.lit(seed), F.col("draw"), F.col("_i"), F.lit("len"))) / F.log(1 - p))
    start = F.floor(uniform(F.lit(seed), F.col("draw"), F.col("_i"), F.lit("start")) * F.col("n"))
    w = Window.partitionBy(*by, "draw").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.withColumns({"_g": gap, "a": start}).withColumn("_s", F.sum("_g").over(w) - F.col("_g")).where(F.col("_s") < F.col("n"))
    left = F.col("n") - F.col("_s")
    return placed.select(*by, "draw", "n", "a", F.when(F.col("_i") == F.col("_m") - 1, left).otherwise(F.least("_g", left)).alias("len"))


def _interval(drawn: DataFrame, by: list[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    return drawn.groupBy(*by).agg(F.expr(f"percentile(m, {a})").alias("lo"), F.expr(f"percentile(m, {1 - a})").alias("hi"), F.avg((F.col("m") <= 0).cast("double")).alias("p_le_zero"))


def bootstrap(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], statistic: Callable[[dict[str, Column]], Column], draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 5) -> DataFrame:
    """by, n, estimate, lo, hi, p_le_zero of any statistic that follows from sums over rows, by the stationary bootstrap.

    sums: what is summed, by name (rows where one of them is NULL are left out); statistic: from the sums' columns and `n` to its own. A block's sums are
    differences of running sums at three places, met in one join; draws times rows never arise.
    """
    names = list(sums)
    s = numbered(rows.withColumns(sums).na.drop(subset=names), by, order, *names).where(F.col("n") >= least)
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = s.select(*by, (F.col("pos") + 1).cast("long").alias("k"), *[F.sum(c).over(w).alias(c) for c in names])
    running = running.unionByName(s.where("pos = 0").select(*by, F.lit(0).cast("long").alias("k"), *[F.lit(0.0).alias(c) for c in names]))
    sizes = s.where("pos = 0").select(*by, "n")
    stop, n = F.col("a") + F.col("len"), F.col("n")
    ends = [F.struct(k.cast("long").alias("k"), F.lit(float(sign)).alias("sign")) for k, sign in ((F.col("a"), -1), (F.least(stop, n), 1), (F.greatest(stop - n, F.lit(0)), 1))]
    met = blocks(sizes, by, draws, seed).select(*by, "draw", "n", F.explode(F.array(*ends)).alias("e")).select(*by, "draw", "n", "e.*").join(running, [*by, "k"])
    drawn = met.groupBy(*by, "draw", "n").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in names])
    of = lambda: statistic({c: F.col(c) for c in [*names, "n"]})
    whole = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).select(*by, "n", of().alias("estimate"))
    return whole.join(_interval(drawn.select(*by, of().alias("m")), by, level), by)


def sharpe_sums(x: str, periods: int = 252) -> tuple[dict[str, Column], Callable[[dict[str, Column]], Column]]:
    """For `bootstrap`: the yearly Sharpe ratio of x."""
    return {"_x": F.col(x), "_xx": F.col(x) * F.col(x)}, lambda s: s["_x"] / s["n"] / F.sqrt(F.nullif((s["_xx"] - s["_x"] * s["_x"] / s["n"]) / (s["n"] - 1), F.lit(0.0))) * math.sqrt(periods)


def ratio_sums(above: Column, below: Column) -> tuple[dict[str, Column], Callable[[dict[str, Column]], Column]]:
    """For `bootstrap`: the sum of one column over that of another."""
    return {"_above": above, "_below": below}, lambda s: s["_above"] / F.nullif(s["_below"], F.lit(0.0))


def bootstrap_quantile(rows: DataFrame, by: list[str], order: list[str], x: str, q: float = 0.5, draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 5) -> DataFrame:
    """by, n, estimate, lo, hi, p_le_zero of a quantile (linear between neighbours): draws are weights on the distinct values, and a quantile is where running weights pass its place."""
    s = numbered(rows, by, order, x).where(F.col("n") >= least)
    at = F.floor((F.col("n") - 1) * F.lit(q)), F.ceil((F.col("n") - 1) * F.lit(q))

    def placed(weights: DataFrame, keys: list[str]) -> DataFrame:
        passed = F.sum("weight").over(Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0))
        v = weights.withColumn("_c", passed).groupBy(*keys, "n").agg(F.min(F.when(F.col("_c") > at[0], F.col(x))).alias("_lo"), F.min(F.when(F.col("_c") > at[1], F.col(x))).alias("_hi"))
        part = (F.col("n") - 1) * F.lit(q) - at[0]
        return v.select(*keys, "n", (F.col("_lo") + part * (F.col("_hi") - F.col("_lo"))).alias("m"))

    b = blocks(s.where("pos = 0").select(*by, "n"), by, draws, seed)
    picks = b.select(*by, "draw", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("len") - 1)).alias("_p"), "n").withColumn("pos", (F.col("_p") % F.col("n")).cast("int"))
    weights = picks.groupBy(*by, "draw", "pos").agg(F.count(F.lit(1)).alias("weight")).join(s.select(*by, "pos", "n", x), [*by, "pos"])
    estimate = placed(s.groupBy(*by, "n", x).agg(F.count(F.lit(1)).alias("weight")), by).withColumnRenamed("m", "estimate")
    return estimate.join(_interval(placed(weights, [*by, "draw"]), by, level), by)


def random_entry_test(trades: DataFrame, pool: DataFrame, by: list[str], order: list[str], ret: str, direction: str, pool_order: list[str], label: str, draws: int = 2000, seed: int = 0, least: int = 5, least_pool: int = 20) -> DataFrame:
    """by, n, stat, p of the mean trade against means of as many random entries from the group's pool of forward returns."""
    t = numbered(trades, by, order, ret, direction).where(F.col("n") >= least)
    p = numbered(pool, by, pool_order, label).select(*by, F.col("pos").alias("k"), F.col("n").alias("size"), label).where(F.col("size") >= least_pool)
    sizes = p.where("k = 0").select(*by, "size")
    k = F.floor(uniform(F.lit(seed), F.col("draw"), F.col("pos")) * F.col("size")).cast("int")
    picked = each_draw(t.join(sizes, by), draws).select(*by, "draw", direction, k.alias("k")).join(p.select(*by, "k", label), [*by, "k"])
    drawn = picked.groupBy(*by, "draw").agg(F.avg(F.col(label) * F.col(direction)).alias("m"))
    return permutation_p(t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("stat")), drawn, by, draws)


def circular_shift_test(rows: DataFrame, by: list[str], order: list[str], a: str, b: str, draws: int = 2000, seed: int = 0, min_shift: int = 21) -> DataFrame:
    """by, n, stat, p of |Spearman| of two series against circular shifts of the second by at least min_shift."""
    from ..functions.windows import rank_pct

    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": rank_pct(F.col(a), by), "_b": rank_pct(F.col(b), by)})
    w = Window.partitionBy(*by)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)
    s = numbered(both.withColumns({"_a": z("_a"), "_b": z("_b")}), by, order, "_a", "_b").where(F.col("n") > 2 * min_shift)
    shift = min_shift + F.floor(uniform(F.lit(seed), F.col("draw")) * (F.col("n") - 2 * min_shift))
    moved = each_draw(s.select(*by, "_a", "pos", "n"), draws).withColumn("k", F.pmod(F.col("pos") - shift, F.col("n")).cast("int"))
    met = moved.join(s.select(*by, F.col("pos").alias("k"), "_b"), [*by, "k"])
    drawn = met.groupBy(*by, "draw").agg(F.abs(F.avg(F.col("_a") * F.col("_b"))).alias("m"))
    return permutation_p(s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(F.col("_a") * F.col("_b"))).alias("stat")), drawn, by, draws)


def compare_with_history(forward: DataFrame, history: DataFrame, by: list[str], order: list[str], x: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """by, n, forward_mean, percentile: where the forward mean lies among means of as many draws from the group's history."""
    f, h = numbered(forward, by, order, x), numbered(history, by, order, x)
    pool = h.select(*by, F.col("pos").alias("k"), F.col("n").alias("size"), F.col(x).alias("_h"))
    k = F.floor(uniform(F.lit(seed), F.col("draw"), F.col("pos")) * F.col("size")).cast("int")
    picked = each_draw(f.select(*by, "pos").join(pool.where("k = 0").select(*by, "size"), by), draws).select(*by, "draw", k.alias("k")).join(pool.select(*by, "k", "_h"), [*by, "k"])
    drawn = picked.groupBy(*by, "draw").agg(F.avg("_h").alias("m"))
    stat = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("forward_mean"))
    return drawn.join(stat, by).groupBy(*by, "n", "forward_mean").agg(F.avg((F.col("m") <= F.col("forward_mean")).cast("double")).alias("percentile"))


def walk_forward_folds(sessions: DataFrame, train: int = 756, test: int = 252, purge: int = 21, expanding: bool = True) -> DataFrame:
    """fold, train_from, train_to, test_from, test_to: full test windows after a purge, by session position."""
    p = sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("p"))
    n = p.agg(F.max("p").alias("n"))
    k = n.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train - purge) / test).cast("int") - 1)).alias("fold")).where("fold >= 0")
    last = train + F.col("fold") * test
    f = k.select("fold", F.when(F.lit(expanding), 1).otherwise(F.col("fold") * test + 1).alias("a"), last.alias("b"), (last + purge + 1).alias("c"), (last + purge + test).alias("d"))
    for new, col in (("train_from", "a"), ("train_to", "b"), ("test_from", "c"), ("test_to", "d")):
        f = f.join(p.select(F.col("session").alias(new), F.col("p").alias(col)), col)
    return f.select("fold", "train_from", "train_to", "test_from", "test_to")
