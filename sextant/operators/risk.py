"""Sizing, risk limits and combinations of signals as column expressions and small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_cdf
from ..functions.windows import ratio
from .stats import shrinkage_posterior


def kelly_gaussian(mu: Column, sigma: Column) -> Column:
    return ratio(mu, sigma * sigma)


def growth_rate(rows: DataFrame, by: list[str], x: str, f: Column) -> DataFrame:
    """by, growth: mean log growth at fraction f; minus infinity as NULL where any step is ruin."""
    step = 1 + f * F.col(x)
    return rows.groupBy(*by).agg(F.when(F.min(step) > 0, F.avg(F.log(F.greatest(step, F.lit(1e-300))))).alias("growth"))


def kelly_empirical(rows: DataFrame, by: list[str], x: str, most: float = 10.0, grid: int = 200) -> DataFrame:
    """by, kelly: the fraction with the highest mean log growth, on a grid over (0, min(most, 0.999 / -worst)] and a finer one around its best.

    Equal returns count once with their number, so a grid meets distinct values only; 0 below ten rows or for a mean of at most 0.
    """
    clean = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_w"))
    s = clean.groupBy(*by).agg(F.sum("_w").alias("n"), (F.sum(F.col(x) * F.col("_w")) / F.sum("_w")).alias("mean"), F.min(x).alias("worst"))
    s = s.withColumn("hi", F.when(F.col("worst") < 0, F.least(F.lit(most), 0.999 / -F.col("worst"))).otherwise(most)).withColumn("lo", F.lit(0.0))
    for _ in range(2):
        near = clean.join(s, by).select(*by, x, "_w", "n", "mean", "worst", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(grid))).alias("_k"))
        near = near.withColumn("_f", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_k") / grid)
        g = near.groupBy(*by, "n", "mean", "worst", "lo", "hi", "_f").agg((F.sum(F.col("_w") * F.log1p(F.greatest(F.col("_f") * F.col(x), F.lit(-0.999999)))) / F.sum("_w")).alias("_g"))
        best = g.groupBy(*by, "n", "mean", "worst", "lo", "hi").agg(F.max_by("_f", F.struct("_g", -F.col("_f"))).alias("best"))
        wide = (F.col("hi") - F.col("lo")) / grid
        s = best.select(*by, "n", "mean", "worst", F.greatest(F.col("best") - wide, F.lit(0.0)).alias("lo2"), F.least(F.col("best") + wide, F.col("hi")).alias("hi2"), "best").withColumnsRenamed({"lo2": "lo", "hi2": "hi"})
    return s.select(*by, F.when((F.col("n") < 10) | (F.col("mean") <= 0), 0.0).otherwise(F.col("best")).alias("kelly"))


def ruin_probability(mu: Column, sigma: Column, f: Column, level: float = 0.5, horizon: float | None = None) -> Column:
    """Chance that log wealth at fraction f ever (or within the horizon) falls to the level."""
    m, s, b = f * mu - f * f * sigma * sigma / 2, f * sigma, F.lit(math.log(level))
    if horizon is None:
        return F.when(m <= 0, 1.0).otherwise(F.exp(2 * m * b / (s * s)))
    root = s * math.sqrt(horizon)
    return normal_cdf((b - m * horizon) / root) + F.exp(2 * m * b / (s * s)) * normal_cdf((b + m * horizon) / root)


def parametric_var_es(mu: Column, sigma: Column, level: float = 0.95) -> tuple[Column, Column]:
    from statistics import NormalDist

    z = NormalDist().inv_cdf(level)
    return z * sigma - mu, sigma * NormalDist().pdf(z) / (1 - level) - mu


def cornish_fisher_var(mu: Column, sigma: Column, skew: Column, kurt: Column, level: float = 0.95) -> Column:
    """VaR at a quantile corrected for skewness and excess kurtosis."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - level)
    q = z + (z * z - 1) * skew / 6 + (z**3 - 3 * z) * kurt / 24 - (2 * z**3 - 5 * z) * skew * skew / 36
    return -(mu + q * sigma)


def portfolio_vol(cov: DataFrame, weights: DataFrame, annual: bool = True) -> DataFrame:
    """vol: sqrt(w' C w) from `covariance` (sym_a <= sym_b) and weights (symbol, weight)."""
    a, b = weights.select(F.col("symbol").alias("sym_a"), F.col("weight").alias("wa")), weights.select(F.col("symbol").alias("sym_b"), F.col("weight").alias("wb"))
    twice = F.when(F.col("sym_a") == F.col("sym_b"), 1.0).otherwise(2.0)
    total = F.sum(twice * F.col("wa") * F.col("wb") * F.col("cov"))
    return cov.join(a, "sym_a").join(b, "sym_b").agg(F.sqrt(total * (252 if annual else 1)).alias("vol"))


def effective_number(rho: DataFrame) -> DataFrame:
    """n, effective: n^2 over the sum of squared correlations, from pairs sym_a <= sym_b."""
    square = F.col("rho") * F.col("rho") * F.when(F.col("sym_a") == F.col("sym_b"), 1.0).otherwise(2.0)
    n = F.count(F.when(F.col("sym_a") == F.col("sym_b"), 1))
    return rho.agg(n.alias("n"), (n * n / F.sum(square)).alias("effective"))


def exposures(positions: DataFrame, by: list[str]) -> DataFrame:
    """by, gross, net, beta_exposure, largest from symbol, quantity, price, beta."""
    v = F.col("quantity") * F.col("price")
    return positions.groupBy(*by).agg(F.sum(F.abs(v)).alias("gross"), F.sum(v).alias("net"), F.sum(v * F.coalesce("beta", F.lit(1.0))).alias("beta_exposure"), F.max(F.abs(v)).alias("largest"))


#: Default limits as shares of equity, of daily dollar volume, or of drawdown.
LIMITS = {"position": 0.20, "gross_leverage": 1.0, "sector": 0.40, "beta": 1.2, "drawdown_halt": 0.20, "event_risk": 0.10, "liquidity": 0.01, "option_premium": 0.05, "var95": 0.03, "vega": 0.002, "cash_buffer": 0.02}


def gate(trades: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Adds allowed, verdict and binding: the notional that all limits leave a purchase, and the tightest limit.

    trades: notional (negative: a sale), equity, cash, held, gross, sector_value, beta, beta_exposure, adv, drawdown,
    var95, event_risk (boolean), event_value, loss_share (largest loss over notional of an option trade, else NULL) and
    vega_share (dollar vega over notional, else NULL). No equity, a drawdown or a VaR beyond its limit stops purchases
    whatever their size; sales are always allowed. Where trades have a column `refused` (see `refusals`), it stops them.
    """
    e, none = F.col("equity"), F.lit(float("inf"))
    buys = F.col("notional") > 0
    caps = {
        "position": limits["position"] * e - F.abs("held"), "gross_leverage": limits["gross_leverage"] * e - F.col("gross"), "sector": limits["sector"] * e - F.abs("sector_value"),
        "beta": (limits["beta"] * e - F.col("beta_exposure")) / F.greatest(F.abs("beta"), F.lit(1e-12)), "cash": F.col("cash") - limits["cash_buffer"] * e, "liquidity": limits["liquidity"] * F.col("adv"),
        "event_risk": F.when(F.col("event_risk"), limits["event_risk"] * e - F.col("event_value")), "option_premium_at_risk": limits["option_premium"] * e / F.abs("loss_share"), "vega": limits["vega"] * e * 100 / F.abs("vega_share")}
    entries = F.array(*[F.struct(F.coalesce(c, none).alias("cap"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(caps.items())])
    refused = F.coalesce(F.col("refused"), F.lit(False)) if "refused" in trades.columns else F.lit(False)
    hard = (e <= 0) | refused | (buys & (F.col("drawdown") <= -limits["drawdown_halt"])) | (buys & F.coalesce(F.col("var95") > limits["var95"], F.lit(False)))
    t = trades.withColumn("_t", F.array_min(entries))
    free = F.when(buys, F.greatest(F.lit(0.0), F.least(F.abs("notional"), "_t.cap"))).otherwise(F.abs("notional"))
    t = t.withColumn("allowed", F.when(hard, 0.0).otherwise(free))
    less = F.col("allowed") + 1e-9 < F.abs("notional")
    verdict = F.when(hard | (F.col("allowed") <= 0), "REJECT").when(less, "REDUCE").otherwise("APPROVE")
    return t.withColumns({"verdict": verdict, "binding": F.when(hard, "hard").when(less, F.col("_t.name"))}).drop("_t")


#: How much of an edge counts by its stability; anything else counts half.
DECAY = {"STRENGTHENED": 1.0, "STABLE": 1.0, "WEAKENED": 0.5, "DISAPPEARED": 0.0, "NO_EDGE_IN_EITHER_HALF": 0.0, "INSUFFICIENT_DATA": 0.5}


def adjusted_edges(signals: DataFrame) -> DataFrame:
    """Adds shrunk and edge: the mean's posterior under a zero prior with its own error as sd (half the mean), times decay and regime factor; 0 if inactive.

    signals: mean, se, stability, regime_factor, active.
    """
    decay = F.coalesce(F.create_map(*[F.lit(x) for kv in DECAY.items() for x in kv])[F.col("stability")], F.lit(0.5))
    s = signals.withColumn("shrunk", shrinkage_posterior(F.col("mean"), F.col("se"))[0])
    return s.withColumn("edge", F.when(F.col("active"), F.coalesce("shrunk", F.lit(0.0)) * decay * F.coalesce("regime_factor", F.lit(1.0))).otherwise(0.0))


def recommended_fraction(kelly: Column, n: Column, fraction: float = 0.25, cap: float = 0.2, least: int = 30) -> Column:
    return F.when(n < least, 0.0).otherwise(F.greatest(F.least(kelly * fraction, F.lit(cap)), F.lit(0.0)))


def evaluate_predictions(pred: DataFrame, by: list[str], cost: float, threshold: float = 0.55) -> DataFrame:
    """by, n, taken, net_mean, always_mean, hit_rate, base_rate, brier from prob, label (0/1) and ret."""
    on = F.col("prob") >= threshold
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(on, 1)).alias("taken"), F.avg(F.when(on, F.col("ret") - cost)).alias("net_mean"), F.avg(F.col("ret") - cost).alias("always_mean"),
        F.avg(F.when(on, F.col("label"))).alias("hit_rate"), F.avg("label").alias("base_rate"), F.avg((F.col("prob") - F.col("label")) ** 2).alias("brier"))


def refusals(trades: DataFrame, allow_short: bool = False, allow_naked: bool = False) -> DataFrame:
    """Adds refused and why: what no size mends. A short stock position, an option sold with undefined risk, an option bought without a known largest loss.

    trades: kind (option or other), quantity, existing, short_option, defined_risk, max_loss.
    """
    option = F.col("kind") == "option"
    reasons = [
        F.when(~option & (F.col("existing") + F.col("quantity") < 0) & F.lit(not allow_short), "short stock"),
        F.when(F.col("short_option") & ~F.col("defined_risk") & F.lit(not allow_naked), "undefined risk"),
        F.when(option & (F.col("quantity") > 0) & F.col("max_loss").isNull(), "no largest loss")]
    t = trades.withColumn("why", F.concat_ws("; ", *reasons))
    return t.withColumn("refused", F.col("why") != "")


def whole_units(allowed: Column, unit: Column, kind: Column, multiplier: Column) -> Column:
    """The allowed notional in whole contracts, where contracts can't be split."""
    return F.when((kind == "option") | (multiplier > 1), F.floor(allowed / unit + 1e-9) * unit).otherwise(allowed)
