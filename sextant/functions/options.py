"""Option mathematics: closed forms as columns, root finding and trees as vectorised functions of columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import normal_cdf, normal_cdf_array
from .windows import spread

ROOT_2_PI = math.sqrt(2 / math.pi)


def d1_d2(s: Column, k: Column, t: Column, r: Column, q: Column, v: Column) -> tuple[Column, Column]:
    spread = v * F.sqrt(t)
    d1 = F.when((t > 0) & (v > 0), (F.log(s / k) + (r - q + v * v / 2) * t) / spread)
    return d1, d1 - spread


def bs_price(s, k, t, r, q, v, call: Column) -> Column:
    """Black-Scholes-Merton with a dividend yield; without time or volatility the discounted intrinsic value."""
    d1, d2 = d1_d2(s, k, t, r, q, v)
    sign = F.when(call, 1.0).otherwise(-1.0)
    ahead, cash = s * F.exp(-q * t), k * F.exp(-r * t)
    flat = F.greatest(sign * F.when(t > 0, ahead - cash).otherwise(s - k), F.lit(0.0))
    return F.when((t > 0) & (v > 0), sign * (ahead * normal_cdf(sign * d1) - cash * normal_cdf(sign * d2))).otherwise(flat)


def bs_greeks(s, k, t, r, q, v, call: Column) -> dict[str, Column]:
    d1, d2 = d1_d2(s, k, t, r, q, v)
    sign = F.when(call, 1.0).otherwise(-1.0)
    pdf = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    ahead, cash = F.exp(-q * t), k * F.exp(-r * t)
    n1, n2 = normal_cdf(sign * d1), normal_cdf(sign * d2)
    return {
        "delta": sign * ahead * n1, "gamma": ahead * pdf / (s * v * F.sqrt(t)), "vega": s * ahead * pdf * F.sqrt(t),
        "theta": -s * ahead * pdf * v / (2 * F.sqrt(t)) - sign * r * cash * n2 + sign * q * s * ahead * n1, "rho": sign * cash * t * n2}


def price_bounds(s, k, t, r, q, call: Column) -> tuple[Column, Column]:
    ahead, cash = s * F.exp(-q * t), k * F.exp(-r * t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    return F.greatest(sign * (ahead - cash), F.lit(0.0)), F.when(call, ahead).otherwise(cash)


def _price_array(s, k, t, r, q, v, call):
    d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / (v * np.sqrt(t))
    sign = np.where(call, 1.0, -1.0)
    return sign * (s * np.exp(-q * t) * normal_cdf_array(sign * d1) - k * np.exp(-r * t) * normal_cdf_array(sign * (d1 - v * np.sqrt(t))))


def _vega_array(s, k, t, r, q, v):
    d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / (v * np.sqrt(t))
    return s * np.exp(-q * t) * np.exp(-d1 * d1 / 2) * np.sqrt(t / (2 * np.pi))


def _solve_array(p, s, k, t, r, q, call, lo: float, hi: float) -> np.ndarray:
    """NaN outside the bounds. Newton's steps within a bracket; halving where rounding of the price moves the root by more than 1e-10."""
    x = np.full(len(p), np.nan)
    bounds = [_price_array(s, k, t, r, q, np.full(len(p), v), call) for v in (lo, hi)]
    live = np.flatnonzero((t > 0) & (bounds[0] <= p) & (bounds[1] >= p))
    args = [v[live] for v in (s, k, t, r, q)]
    a, b = np.full(len(live), lo), np.full(len(live), hi)
    # the price bends the other way at this volatility, from which Newton's steps do not turn back
    v = np.clip(np.sqrt(2 * np.abs(np.log(args[0] / args[1]) + (args[3] - args[4]) * args[2]) / args[2]), max(lo, 0.05), hi)
    todo = np.arange(len(live))
    for _ in range(60):
        some, at = [w[todo] for w in args], v[todo]
        over = _price_array(*some, at, call[live[todo]]) - p[live[todo]]
        a[todo], b[todo] = np.where(over < 0, at, a[todo]), np.where(over < 0, b[todo], at)
        step = at - over / _vega_array(*some, at)
        v[todo] = np.where((step >= a[todo]) & (step <= b[todo]), step, (a[todo] + b[todo]) / 2)
        todo = todo[np.abs(v[todo] - at) > 1e-13]
        if not len(todo):
            break
    vague = np.flatnonzero(~(np.finfo(float).eps * (args[0] + args[1]) < 1e-10 * _vega_array(*args, v)))
    some, sought, side = [w[vague] for w in args], p[live[vague]], call[live[vague]]
    a, b = np.full(len(vague), lo), np.full(len(vague), hi)
    for _ in range(60):
        m = (a + b) / 2
        low = _price_array(*some, m, side) < sought
        a, b = np.where(low, m, a), np.where(low, b, m)
    v[vague] = (a + b) / 2
    x[live] = v
    return x


def implied_vol(price, s, k, t, r, q, call: Column, lo: float = 1e-4, hi: float = 5.0) -> Column:
    """The volatility in [lo, hi] that gives the price; NULL outside the no-arbitrage bounds."""

    @F.pandas_udf("double")
    def solve(p: pd.Series, s_: pd.Series, k_: pd.Series, t_: pd.Series, r_: pd.Series, q_: pd.Series, c: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(_solve_array(*(x.to_numpy(float) for x in (p, s_, k_, t_, r_, q_)), c.to_numpy(bool), lo, hi))

    x = solve(price, s, k, t, r, q, call)
    return F.when(~F.isnan(x), x)


#: Options whose trees move back together: a layer of them stays in a core's cache.
TREES = 512
#: Steps of a tree, as in the reference.
STEPS = 400
#: Distinct trees whose prices a task keeps; beyond that it begins anew.
KEPT = 100_000


def _tree_array(s, k, t, r, q, v, call, american: bool, steps: int) -> list[np.ndarray]:
    """European prices and, if wanted, American ones by binomial trees: a row for each node, a column for each option."""
    sign = np.where(call, 1.0, -1.0)
    dt = t / steps
    jump = v * np.sqrt(dt)
    u = np.exp(jump)
    p, disc = (np.exp((r - q) * dt) - 1 / u) / (u - 1 / u), np.exp(-r * dt)
    up, down = disc * p, disc * (1 - p)
    # what exercise gives at every price that a node can have, by turns those of one layer and of the next
    worth = [sign * (s * np.exp(jump * i[:, None]) - k) for i in (np.arange(-steps, steps + 1.0, 2), np.arange(1.0 - steps, steps, 2))]
    ends = np.maximum(worth[0], 0)

    def back(exercise: bool) -> np.ndarray:
        value, low = ends.copy(), np.empty((steps, len(s)))
        for n in range(steps - 1, -1, -1):
            np.multiply(value[: n + 1], down, out=low[: n + 1])
            value = value[1 : n + 2]
            value *= up
            value += low[: n + 1]
            if exercise:
                first = (steps - n) // 2
                np.maximum(value, worth[(steps - n) % 2][first : first + n + 1], out=value)
        return value[0]

    if ((p > 0) & (p < 1)).all():
        # without exercise the tree is a mean over binomially distributed ends
        j = np.arange(steps + 1.0)[:, None]
        ways = np.array([math.lgamma(steps + 1) - math.lgamma(i + 1) - math.lgamma(steps - i + 1) for i in range(steps + 1)])[:, None]
        european = (np.exp(ways + j * np.log(up) + (steps - j) * np.log(down)) * ends).sum(0)
    else:
        european = back(False)
    return [european, back(True)] if american else [european]


def _trees(steps: int, american: bool):
    """A function that gives a batch's row of European and, if wanted, one of American prices.

    A price is in proportion to the spot, so options of equal strike over spot, time, rates, volatility and side have one
    tree; its prices for a spot of 1 are kept within the task.
    """
    known: dict[bytes, np.ndarray] = {}

    def of(columns: tuple[pd.Series, ...]) -> np.ndarray:
        *numbers, call = (x.to_numpy(float) if i < 6 else x.to_numpy(bool) for i, x in enumerate(columns))
        if not len(call):
            return np.zeros((1 + american, 0))
        with np.errstate(all="ignore"):
            scale = np.where((numbers[0] > 0) & np.isfinite(numbers[0]), numbers[0], 1.0)
            rows = np.column_stack([numbers[0] / scale, numbers[1] / scale, *numbers[2:], call])
            keys, first, at = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            keys = [k.tobytes() for k in keys]
            if len(known) + len(keys) > KEPT:
                known.clear()
            new = [i for i, k in enumerate(keys) if k not in known]
            for i in range(0, len(new), TREES):
                some = new[i : i + TREES]
                *x, side = rows[first[some]].T.copy()
                known.update(zip([keys[j] for j in some], np.array(_tree_array(*x, side > 0, american, steps)).T))
            return np.array([known[k] for k in keys])[at].T * scale

    return of


def crr_price(s, k, t, r, q, v, call: Column, american: bool = True, steps: int = STEPS) -> Column:
    """Binomial tree, options of a batch moved back together."""

    @F.pandas_udf("double")
    def tree(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        of = _trees(steps, american)
        for columns in batches:
            yield pd.Series(of(columns)[-1])

    return tree(*(x.cast("double") for x in (s, k, t, r, q, v)), call)


def crr_prices(s, k, t, r, q, v, call: Column, steps: int = STEPS) -> Column:
    """american and european price by binomial trees, as one column."""

    @F.pandas_udf("american double, european double")
    def trees(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        of = _trees(steps, True)
        for columns in batches:
            european, american = of(columns)
            yield pd.DataFrame({"american": american, "european": european})

    return trees(*(x.cast("double") for x in (s, k, t, r, q, v)), call)


def early_exercise_premium(*args, steps: int = STEPS) -> Column:
    both = crr_prices(*args, steps=steps)
    return both["american"] - both["european"]


def parity_gap(call, put, s, k, t, r, q) -> Column:
    return call - put - (s * F.exp(-q * t) - k * F.exp(-r * t))


def parity_arbitrage(call_bid, call_ask, put_bid, put_ask, s_bid, s_ask, k, t, r, q, cost: float = 0.0) -> tuple[Column, Column]:
    """Profit of a conversion (sell call, buy put and stock) and a reversal at bid and ask, net of cost."""
    cash = k * F.exp(-r * t)
    return call_bid - put_ask - s_ask * F.exp(-q * t) + cash - cost, put_bid - call_ask + s_bid * F.exp(-q * t) - cash - cost


def expected_move(s, v, t) -> tuple[Column, Column]:
    one = s * v * F.sqrt(t)
    return one, one * ROOT_2_PI


def expected_move_from_straddle(straddle, s) -> Column:
    return straddle / s / ROOT_2_PI


def implied_event_move(iv_front, t_front, iv_back, t_back) -> Column:
    """The sd of one event before the front expiry but in no background volatility of both; NULL if the two disagree."""
    background = (iv_back * iv_back * t_back - iv_front * iv_front * t_front) / (t_back - t_front)
    event = iv_front * iv_front * t_front - background * t_front
    return F.when((t_back > t_front) & (background >= 0) & (event >= 0), F.sqrt(event))


def prob_above(s, k, t, r, q, v) -> Column:
    return normal_cdf(d1_d2(s, k, t, r, q, v)[1])


def lognormal_pdf(x, s, t, mu, sigma) -> Column:
    sd = sigma * F.sqrt(t)
    z = (F.log(x / s) - (mu - sigma * sigma / 2) * t) / sd
    return F.exp(-z * z / 2) / (x * sd * math.sqrt(2 * math.pi))


def gradient(y: str, x: str, by: list[str]) -> Column:
    """Second-order derivative estimate on an uneven grid, one-sided at its ends."""
    w = Window.partitionBy(*by).orderBy(x)
    y0, y1, y2, x0, x1, x2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w), F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    a, b = x1 - x0, x2 - x1
    inner = (a * a * y2 + (b * b - a * a) * y1 - b * b * y0) / (a * b * (a + b))
    return F.when(x0.isNull(), (y2 - y1) / b).when(x2.isNull(), (y1 - y0) / a).otherwise(inner)


def breeden_litzenberger(chain: DataFrame, by: list[str], strike: str, call: str, r: float, t: str) -> DataFrame:
    """Adds density: exp(r t) times the second derivative of call prices in the strike."""
    first = chain.withColumn("_g", gradient(call, strike, by))
    return first.withColumn("density", F.exp(F.lit(r) * F.col(t)) * gradient("_g", strike, by)).drop("_g")


def atm_term_structure(chain: DataFrame, by: list[str]) -> DataFrame:
    """by, strike, iv, straddle: at the strike nearest the spot (ties: the lower), mean of both ivs, the straddle if both quote.

    chain: by, strike, right (C or P), spot, iv, mid.
    """
    near = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), "strike"))
    each = chain.groupBy(*by, "strike").agg(near.alias("_near"), F.sum("iv").alias("_v"), F.count("iv").alias("_c"), F.count("mid").alias("_n"), F.sum("mid").alias("_s"))
    best = each.groupBy(*by).agg(F.min_by(F.struct("strike", (F.col("_v") / F.nullif("_c", F.lit(0))).alias("iv"), "_n", "_s"), "_near").alias("_b"))
    best = best.select(*by, "_b.*").where(F.col("strike").isNotNull())
    return best.withColumn("straddle", F.when(F.col("_n") == 2, F.col("_s"))).drop("_n", "_s")


def skew_25d(chain: DataFrame, by: list[str]) -> DataFrame:
    """by, put_iv, call_iv, risk_reversal: ivs of the put nearest delta -0.25 and the call nearest 0.25."""
    put, call = F.col("right") == "P", F.col("right") == "C"
    pick = lambda side, d: F.min_by(F.when(side, F.col("iv")), F.when(side, F.struct(F.abs(F.col("delta") - d), "strike")))
    g = chain.where("iv IS NOT NULL AND delta IS NOT NULL").groupBy(*by).agg(pick(put, -0.25).alias("put_iv"), pick(call, 0.25).alias("call_iv"))
    return g.withColumn("risk_reversal", F.col("call_iv") - F.col("put_iv"))


def butterfly_violations(chain: DataFrame, by: list[str]) -> DataFrame:
    """by, n_quotes, n_violations: strikes where the slope of mids in the strike falls."""
    w = Window.partitionBy(*by).orderBy("strike")
    slope = (F.col("mid") - F.lag("mid").over(w)) / (F.col("strike") - F.lag("strike").over(w))
    c = chain.where("mid IS NOT NULL").withColumn("_s", slope).withColumn("_b", F.col("_s") - F.lag("_s").over(w) < -1e-9)
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n_quotes"), F.count(F.when(F.col("_b"), 1)).alias("n_violations"))


def calendar_violations(terms: DataFrame, by: list[str], t: str = "t", iv: str = "iv") -> DataFrame:
    """by, n_violations: expiries whose total at-the-money variance is below the one before."""
    w = Window.partitionBy(*by).orderBy(t)
    total = F.col(iv) * F.col(iv) * F.col(t)
    c = terms.where(F.col(iv).isNotNull()).withColumn("_v", total).withColumn("_b", F.col("_v") < F.lag("_v").over(w) - 1e-12)
    return c.groupBy(*by).agg(F.count(F.when(F.col("_b"), 1)).alias("n_violations"))


def payoff(legs: Column, price: Column) -> Column:
    """Value at expiry of legs (array of structs qty, strike, right, premium; right S is stock): payoff less premiums."""
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x["qty"] * (
        F.when(x["right"] == "C", F.greatest(price - x["strike"], F.lit(0.0))).when(x["right"] == "P", F.greatest(x["strike"] - price, F.lit(0.0))).otherwise(price) - x["premium"]))


def breakevens(positions: DataFrame, key: str, legs: str, spot: str, width: float = 0.6, n: int = 201) -> DataFrame:
    """key, breakevens, max_profit, max_loss on a price grid around the spot; an open upper end counts as NULL."""
    step = 2 * width / (n - 1)
    grid = spread(positions.select(key, legs, spot), [key], 2_500).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("x", F.col(spot) * (1 - width + F.col("i") * step))
    w = Window.partitionBy(key).orderBy("i")
    g = grid.withColumn("v", payoff(F.col(legs), F.col("x"))).withColumns({"_v": F.lead("v").over(w), "_x": F.lead("x").over(w)})
    cross = F.when((F.signum("v") * F.signum("_v") < 0) | (F.col("v") == 0), F.round(F.col("x") - F.col("v") * (F.col("_x") - F.col("x")) / F.nullif(F.col("_v") - F.col("v"), F.lit(0.0)), 4))
    up = F.aggregate(F.first(legs), F.lit(0.0), lambda a, l: a + F.when(l["right"] != "P", l["qty"]).otherwise(0.0))
    return g.groupBy(key).agg(F.sort_array(F.collect_set(cross)).alias("breakevens"), F.when(up > 1e-12, None).otherwise(F.max("v")).alias("max_profit"), F.when(up < -1e-12, None).otherwise(F.min("v")).alias("max_loss"))


def fill_price(bid: Column, ask: Column, buy: Column, capture: float = 0.5) -> Column:
    """mid plus or minus the part of the half spread that is paid; NULL for a bad quote or a sale at no bid."""
    half, mid = (ask - bid) / 2, (ask + bid) / 2
    bad = bid.isNull() | ask.isNull() | (ask <= 0) | (ask < bid) | (~buy & (bid <= 0))
    return F.when(~bad, mid + F.when(buy, 1.0).otherwise(-1.0) * half * (1 - capture))


def select_contract(chain: DataFrame, by: list[str], min_days: int, target: Column) -> DataFrame:
    """Of each group the first expiry with at least min_days, then the strike nearest the target (ties: the lower)."""
    w = Window.partitionBy(*by).orderBy("days", F.abs(F.col("strike") - target), "strike", "right")
    return chain.where(F.col("days") >= min_days).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def enrich_chain(chain: DataFrame, r: float, q: float = 0.0, session: str = "session", max_rel_spread: float = 0.25) -> DataFrame:
    """Adds t, mid, spread, moneyness, iv_bid, iv_mid, iv_ask, iv_reliable and Greeks at iv_mid.

    chain: session, expiration, strike, right, bid, ask, spot. A volatility is reliable with a bid, a relative spread below
    max_rel_spread, out of the money or within 2 % of it.
    """
    call, mid = F.col("right") == "C", (F.col("bid") + F.col("ask")) / 2
    c = chain.withColumns({"t": F.datediff("expiration", session) / F.lit(365.0), "mid": mid, "spread": F.col("ask") - F.col("bid"), "moneyness": F.col("strike") / F.col("spot")})
    args = (F.col("spot"), F.col("strike"), F.col("t"), F.lit(float(r)), F.lit(float(q)))
    c = c.withColumns({f"iv_{n}": implied_vol(F.col(n), *args, call) for n in ("bid", "mid", "ask")})
    outside = F.when(call, F.col("moneyness") >= 0.98).otherwise(F.col("moneyness") <= 1.02)
    reliable = (F.col("bid") > 0) & (F.col("spread") / F.nullif("mid", F.lit(0.0)) < max_rel_spread) & outside
    return c.withColumn("iv_reliable", F.coalesce(reliable, F.lit(False))).withColumns(bs_greeks(*args, F.col("iv_mid"), call))


def leg(right: str, strike: Column, qty: float, premium: Column, t: Column) -> Column:
    """One leg of a position; right is C, P or S (stock)."""
    return F.struct(F.lit(float(qty)).alias("qty"), strike.cast("double").alias("strike"), F.lit(right).alias("right"), premium.cast("double").alias("premium"), t.cast("double").alias("t"))


def straddle(k, t, call, put, qty: float = 1.0) -> Column:
    return F.array(leg("C", k, qty, call, t), leg("P", k, qty, put, t))


def strangle(kp, kc, t, put, call, qty: float = 1.0) -> Column:
    return F.array(leg("P", kp, qty, put, t), leg("C", kc, qty, call, t))


def vertical(right: str, bought, sold, t, paid, got, qty: float = 1.0) -> Column:
    return F.array(leg(right, bought, qty, paid, t), leg(right, sold, -qty, got, t))


def iron_condor(kp_long, kp_short, kc_short, kc_long, t, premiums: list[Column], qty: float = 1.0) -> Column:
    """Sold put and call spreads; premiums in the order of the strikes."""
    return F.array(leg("P", kp_long, qty, premiums[0], t), leg("P", kp_short, -qty, premiums[1], t), leg("C", kc_short, -qty, premiums[2], t), leg("C", kc_long, qty, premiums[3], t))


def butterfly(right: str, lo, mid, hi, t, premiums: list[Column], qty: float = 1.0) -> Column:
    return F.array(leg(right, lo, qty, premiums[0], t), leg(right, mid, -2 * qty, premiums[1], t), leg(right, hi, qty, premiums[2], t))


def covered_call(spot, k, t, call, qty: float = 1.0) -> Column:
    return F.array(leg("S", spot, qty, spot, t), leg("C", k, -qty, call, t))


def position_marks(positions: DataFrame, key: str, legs: str, spot: str, r: float, q: float, sigma: Column, elapsed: float = 0.0) -> DataFrame:
    """key, value, delta, gamma, vega, theta, rho: model mark less premiums, and the legs' summed Greeks (stock has a delta of 1)."""
    each = positions.select(key, F.col(spot).alias("_s"), sigma.alias("_v"), F.explode(legs).alias("_l")).select(key, "_s", "_v", "_l.*")
    t, call, stock = F.greatest(F.col("t") - elapsed, F.lit(0.0)), F.col("right") == "C", F.col("right") == "S"
    args = (F.col("_s"), F.col("strike"), t, F.lit(float(r)), F.lit(float(q)))
    g = bs_greeks(*args, F.col("_v"), call)
    value = F.col("qty") * (F.when(stock, F.col("_s")).otherwise(bs_price(*args, F.col("_v"), call)) - F.col("premium"))
    total = lambda n: F.sum(F.col("qty") * F.when(stock, 1.0 if n == "delta" else 0.0).otherwise(F.coalesce(g[n], F.lit(0.0)))).alias(n)
    return each.groupBy(key).agg(F.sum(value).alias("value"), *[total(n) for n in g])
