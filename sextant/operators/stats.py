"""Statistical inference as grouped and windowed aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_quantile, t_pvalue
from ..functions.windows import exact_quantiles, rank_pct, ratio

EULER = 0.5772156649015329


def hac_test(rows: DataFrame, by: list[str], order: str, x: str, lags: int | None = None, alternative: str = "greater") -> DataFrame:
    """by, n, mean, se, t, p of the mean with Newey-West errors (Bartlett weights).

    Autocovariances come from a self join on positions with the lags exploded (a few rows each), so any number of
    groups runs at once. Default lags: floor(4 (n / 100)^(2/9)).
    """
    clean = rows.where(F.col(x).isNotNull())
    w = Window.partitionBy(*by)
    u = clean.select(*by, F.row_number().over(w.orderBy(order)).alias("_i"), (F.col(x) - F.avg(x).over(w)).alias("_u"), F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("mean"))
    most = F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("n") / 100.0, 2 / 9)).cast("int")
    u = u.withColumn("_L", F.least(most, (F.col("n") - 1).cast("int")))
    lagged = u.select(*by, "n", "mean", "_L", "_u", F.explode(F.sequence(F.lit(0), F.col("_L"))).alias("_k"), F.col("_i")).withColumn("_j", F.col("_i") - F.col("_k"))
    other = u.select(*by, F.col("_i").alias("_j"), F.col("_u").alias("_v"))
    g = lagged.join(other, [*by, "_j"]).groupBy(*by, "n", "mean", "_L", "_k").agg(F.sum(F.col("_u") * F.col("_v")).alias("_g"))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2 * (1 - F.col("_k") / (F.col("_L") + 1)))
    s = g.groupBy(*by, "n", "mean").agg((F.sqrt(F.greatest(F.sum(weight * F.col("_g") / F.col("n")), F.lit(0.0)) / F.col("n"))).alias("se"))
    s = s.withColumn("t", F.when(F.col("n") >= 3, ratio(F.col("mean"), F.col("se"))))
    return s.withColumn("p", t_pvalue(F.col("t"), F.col("n") - 1, alternative))


def harmonic_number(m: Column) -> Column:
    """1 + 1/2 + .. + 1/m; beyond 50 terms by its expansion, which is then exact to the last digits of a double and costs the same for every m."""
    summed = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(50)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = 1 / (m * m)
    return F.when(m <= 50, summed).otherwise(F.log(m) + EULER + 1 / (2 * m) - x * (1 / 12 - x * (1 / 120 - x / 252)))


def adjust(rows: DataFrame, p: str, tie: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds bonferroni, holm, bh, by of p-values within families; a missing p counts as 1 and in the family's size."""
    keys = by or []
    q = F.coalesce(p, F.lit(1.0))
    r = rows.withColumn("_q", q)
    w = Window.partitionBy(*keys)
    up = w.orderBy("_q", *tie)
    r = r.withColumns({"_m": F.count(F.lit(1)).over(w).cast("double"), "_k": F.row_number().over(up)})
    before = up.rowsBetween(Window.unboundedPreceding, 0)
    after = w.orderBy(F.desc("_q"), *[F.desc(t) for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1.0)
    bh = F.min(F.least(F.col("_q") * F.col("_m") / F.col("_k"), one)).over(after)
    harmonic = harmonic_number(F.col("_m"))
    r = r.withColumns({"bonferroni": F.least(F.col("_q") * F.col("_m"), one), "holm": F.max(F.least((F.col("_m") - F.col("_k") + 1) * F.col("_q"), one)).over(before), "bh": bh})
    raw = F.min(F.col("_q") * F.col("_m") / F.col("_k")).over(after)
    return r.withColumn("by", F.least(raw * harmonic, one)).drop("_q", "_m", "_k")


def cross_sectional_ic(rows: DataFrame, signal: str, label: str, session: str = "session", min_names: int = 5) -> DataFrame:
    """session, ic, n: Spearman per session over complete pairs, average ranks, NULL below min_names."""
    r = rows.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    r = r.withColumns({"_a": rank_pct(F.col(signal), [session]), "_b": rank_pct(F.col(label), [session])})
    n = F.count(F.lit(1))
    return r.groupBy(session).agg(F.when(n >= min_names, F.corr("_a", "_b")).alias("ic"), n.alias("n"))


def cusum(rows: DataFrame, by: list[str], order: list[str], x: str, mean: float, sd: float, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Adds cusum and alarm: max(0, s - z - k) in closed form, the running sum less its running minimum."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = -(F.col(x) - mean) / sd - k
    r = rows.withColumn("_p", F.sum(step).over(w))
    low = F.least(F.lit(0.0), F.min("_p").over(w))
    return r.withColumn("cusum", F.col("_p") - low).withColumn("alarm", F.col("cusum") > h).drop("_p")


def psr(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: Column | None = None) -> Column:
    """Probabilistic Sharpe ratio of a per-period Sharpe; kurt is not in excess."""
    b = benchmark if benchmark is not None else F.lit(0.0)
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return normal_cdf(F.when(spread > 0, (sr - b) * F.sqrt(n - 1) / F.sqrt(spread)))


def expected_max_sharpe(trials: Column, sd: Column) -> Column:
    n = F.greatest(trials.cast("double"), F.lit(1.0))
    z = (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e))
    return F.when(n <= 1, 0.0).otherwise(sd * z)


def deflated_sharpe(sr: Column, n: Column, trials: Column, skew: Column, kurt: Column, sd: Column | None = None) -> Column:
    return psr(sr, n, skew, kurt, expected_max_sharpe(trials, sd if sd is not None else 1 / F.sqrt(n - 1)))


def min_track_record(sr: Column, skew: Column, kurt: Column, benchmark: float = 0.0, prob: float = 0.95) -> Column:
    from statistics import NormalDist

    z = NormalDist().inv_cdf(prob)
    return F.when(sr > benchmark, 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * F.pow(F.lit(z) / (sr - benchmark), 2))


def shrinkage_posterior(mean: Column, se: Column, prior_mean: float = 0.0, prior_sd: Column | None = None) -> tuple[Column, Column, Column]:
    """Posterior mean and sd of a normal mean under a normal prior, and P(> 0)."""
    sd0 = prior_sd if prior_sd is not None else se
    w = (sd0 * sd0) / (sd0 * sd0 + se * se)
    post, sd = w * mean + (1 - w) * prior_mean, F.sqrt(w) * se
    return post, sd, normal_cdf(post / sd)


def half_life(rows: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """by, n, slope, half_life of an AR(1): -ln 2 / b where the change falls with the level; NULL below 50 rows."""
    w = Window.partitionBy(*by).orderBy(order)
    clean = rows.where(F.col(x).isNotNull()).withColumn("_l", F.lag(x).over(w)).withColumn("_d", F.col(x) - F.col("_l"))
    g = clean.where("_l IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_d", "_l").alias("slope"))
    return g.withColumn("half_life", F.when((F.col("n") >= 50) & (F.col("slope") < 0), -math.log(2) / F.col("slope")))


def covariance(rows: DataFrame, a: str = "symbol", session: str = "session", x: str = "ret") -> DataFrame:
    """sym_a <= sym_b, cov, n: pairwise-complete covariances, by a self join on the session (symbols squared per session)."""
    r = rows.where(F.col(x).isNotNull())
    left, right = r.select(session, F.col(a).alias("sym_a"), F.col(x).alias("xa")), r.select(session, F.col(a).alias("sym_b"), F.col(x).alias("xb"))
    return left.join(right, session).where("sym_a <= sym_b").groupBy("sym_a", "sym_b").agg(F.covar_samp("xa", "xb").alias("cov"), F.count(F.lit(1)).alias("n"))


def shrunk_covariance(cov: DataFrame, shrink: float | None = None) -> DataFrame:
    """Constant-correlation shrinkage of `covariance`: adds rho and shrunk; the weight is min(1, 10 / n) unless given."""
    var = cov.where("sym_a = sym_b").select(F.col("sym_a").alias("s"), F.sqrt("cov").alias("sd"))
    j = cov.join(var.select(F.col("s").alias("sym_a"), F.col("sd").alias("sd_a")), "sym_a").join(var.select(F.col("s").alias("sym_b"), F.col("sd").alias("sd_b")), "sym_b")
    j = j.withColumn("rho", ratio(F.col("cov"), F.col("sd_a") * F.col("sd_b")))
    off = j.where("sym_a <> sym_b").agg(F.avg("rho").alias("mean_rho"))
    j = j.join(F.broadcast(off))
    lam = F.lit(shrink) if shrink is not None else F.least(F.lit(1.0), 10.0 / F.col("n"))
    flat = F.when(F.col("sym_a") == F.col("sym_b"), F.col("cov")).otherwise(F.col("mean_rho") * F.col("sd_a") * F.col("sd_b"))
    return j.withColumn("shrunk", (1 - lam) * F.col("cov") + lam * flat).drop("mean_rho", "sd_a", "sd_b")


def var_es(rows: DataFrame, by: list[str], x: str, level: float = 0.95, least: int = 20) -> DataFrame:
    """by, n, var, es: the linear quantile of losses, by selection, and the mean beyond it."""
    clean = rows.where(F.col(x).isNotNull())
    cut = exact_quantiles(clean, by, x, [round(1 - level, 12)]).select(*by, F.col("value").alias("_q"))
    n = F.count(F.lit(1))
    return clean.join(cut, by).groupBy(*by).agg(n.alias("n"), F.when(n >= least, -F.first("_q")).alias("var"), F.when(n >= least, -F.avg(F.when(F.col(x) <= F.col("_q"), F.col(x)))).alias("es"))
