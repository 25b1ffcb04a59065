"""Steps that hold on larger tables: work spread by key, single aggregations, sweeps and sums that do not depend on their order."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.functions import options, windows
from sextant.operators import records, relative, security, stats


def test_spread_deals_small_tables(spark):
    rows = spark.range(20).select(F.col("id").alias("k")).coalesce(1)
    out = windows.spread(rows, ["k"], 2)
    assert out.rdd.getNumPartitions() == 10 and sorted(r["k"] for r in out.collect()) == list(range(20))
    wide = out.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).groupBy("k", "i").agg(F.count(F.lit(1)).alias("n"))
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and wide.count() == 180


def test_option_chains_need_no_join(spark):
    rows = [("a", 7, k, side, 100.0, 0.2 + k / 1000, m) for k, m in ((95.0, 7.0), (99.0, 3.0), (101.0, 2.0), (105.0, 1.0)) for side in "CP"]
    rows = [*rows, ("b", 7, 50.0, "C", 100.0, None, 1.0), ("a", 30, 106.0, "C", 100.0, 0.4, 1.0), ("a", 30, 106.0, "P", 100.0, 0.3, 1.0), ("a", 90, 105.0, "C", 100.0, 0.4, 1.0)]
    chain = spark.createDataFrame(rows, "u string, days int, strike double, right string, spot double, iv double, mid double")
    terms = options.atm_term_structure(chain, ["u", "days"])
    got = {(r["u"], r["days"]): (r["strike"], r["iv"] and round(r["iv"], 6), r["straddle"]) for r in terms.collect()}
    assert got == {("a", 7): (99.0, 0.299, 6.0), ("b", 7): (50.0, None, None), ("a", 30): (106.0, 0.35, 2.0), ("a", 90): (105.0, 0.4, None)}
    picked = options.select_contract(chain, ["u"], 10, F.col("spot") * 1.06)
    assert [(r["u"], r["days"], r["strike"], r["right"]) for r in picked.collect()] == [("a", 30, 106.0, "C")]
    assert not any("Join" in df._jdf.queryExecution().executedPlan().toString() for df in (terms, picked))


def test_trees_and_roots_equal_plain_ones():
    rng = np.random.default_rng(4)
    n = options.TREES + 88
    s, t = rng.uniform(50, 150, n), rng.choice([7, 30, 90], n) / 365
    k, v, call = s * rng.choice(np.linspace(0.8, 1.2, 9), n), rng.uniform(0.1, 0.6, n), rng.random(n) < 0.5
    r, q = np.full(n, 0.04), np.full(n, 0.01)

    def tree(american, steps):
        sign, dt = np.where(call, 1.0, -1.0)[:, None], (t / steps)[:, None]
        u = np.exp(v[:, None] * np.sqrt(dt))
        p, disc = (np.exp((r - q)[:, None] * dt) - 1 / u) / (u - 1 / u), np.exp(-r[:, None] * dt)
        worth = lambda m: sign * (s[:, None] * u ** (2.0 * np.arange(m + 1) - m) - k[:, None])
        value = np.maximum(worth(steps), 0)
        for m in range(steps - 1, -1, -1):
            value = disc * (p * value[:, 1:] + (1 - p) * value[:, :-1])
            value = np.maximum(value, worth(m)) if american else value
        return value[:, 0]

    for steps in (1, 2, 25):
        european, american = options._trees(tuple(map(pd.Series, (s, k, t, r, q, v, call))), True, steps)
        assert np.allclose(european, tree(False, steps), atol=1e-9) and np.allclose(american, tree(True, steps), atol=1e-9)
    prices = options._price_array(s, k, t, r, q, v, call)
    calls = 0
    plain = options._price_array

    def counted(p, *args):
        nonlocal calls
        calls += len(p)
        return plain(p, *args)

    with pytest.MonkeyPatch.context() as m, np.errstate(all="ignore"):
        m.setattr(options, "_price_array", counted)
        found = options._solve_array(np.append(prices, [1e9, np.nan]), *(np.append(x, x[:2]) for x in (s, k, t, r, q, call)), 1e-4, 5.0)
    assert np.isnan(found[-2:]).all() and calls < 45 * n  # bisection takes 62 prices each
    sure = np.finfo(float).eps * (s + k) < 1e-10 * options._vega_array(s, k, t, r, q, v)
    assert np.allclose(found[:-2][sure], v[sure], atol=1e-9)
    known = ~np.isnan(found[:-2])  # a price without any time value may lie outside the bounds by its rounding
    assert known.mean() > 0.9 and np.allclose(plain(s, k, t, r, q, found[:-2], call)[known], prices[known], atol=1e-9)


def test_breakevens_are_spread_by_key(spark):
    pos = spark.createDataFrame([(i, 100.0) for i in range(40)], "id int, spot double").coalesce(1)
    pos = pos.withColumn("legs", options.straddle(F.lit(100.0), F.lit(0.5), F.lit(5.0), F.lit(5.0)))
    b = options.breakevens(pos, "id", "legs", "spot")
    assert b._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and b.rdd.getNumPartitions() >= 4
    assert all(np.allclose(r["breakevens"], [90, 110]) for r in b.collect())


def test_gains_that_cancel_are_no_profit(spark):
    d = datetime.date
    net = [0.1, 0.2, -0.3] * 10
    forward = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 6, 1), x, 0.0) for x in net], "s int, entry date, exit date, net double, slippage double").coalesce(1)
    history = spark.createDataFrame([(1, 0.0, 1.0)], "s int, hist_mean double, hist_sd double")
    r = records.eligibility(forward, history, "s", 0.001).first()
    assert sum(net) > 0 and not r["profitable"] and not r["eligible"]


def test_quantiles_slice_counts_and_values_alike(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 101 / 100).alias("x")).repartition(8)
    plan = windows.exact_quantiles(rows, ["g"], "x", [0.05, 0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan  # sketched again, a value may fall into another slice than it was counted in


def test_harmonic_numbers(spark):
    got = spark.createDataFrame([(float(m),) for m in (1, 2, 49, 50, 51, 52, 1000, 300000)], "m double").select("m", stats.harmonic_number(F.col("m")).alias("h")).collect()
    assert all(math.isclose(r["h"], math.fsum(1 / i for i in range(1, int(r["m"]) + 1)), rel_tol=1e-14) for r in got)


def test_identifiers_by_spans(spark):
    d = lambda n: datetime.date(2024, 1, n)
    held = [(1, "X", d(1), d(5)), (1, "X", d(3), d(9)), (1, "X", d(15), None), (2, "X", d(8), d(10)), (3, "X", d(8), d(10)), (4, "X", d(12), d(11)), (5, "Y", d(1), d(2)), (None, "X", d(1), d(30)), (6, None, d(1), d(30))]
    asked = [("X", d(n)) for n in (1, 4, 7, 8, 9, 10, 11, 12, 15, 30)] + [("Z", d(1)), (None, d(1)), ("Y", d(2)), ("X", d(4))]
    i = spark.createDataFrame(held, "security_id long, value string, valid_from date, valid_to date")
    got = {(r["value"], r["as_of"]): (r["n_matches"], r["security_id"]) for r in security.resolve(i, spark.createDataFrame(asked, "value string, as_of date")).collect()}
    want = {}
    for v, at in asked:
        ids = {s for s, w, a, b in held if s is not None and w is not None and w == v and a <= at <= (b or datetime.date.max)}
        want[v, at] = (len(ids), min(ids) if len(ids) == 1 else None)
    assert got == want


@pytest.mark.parametrize("width", [4, 512])
def test_correlations_by_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(relative, "WIDTH", width)
    rng = np.random.default_rng(5)
    x = rng.normal(1000, 0.01, (13, 30))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[3], x[4], x[5, 1:], x[6] = 0.1, 3 * x[2], np.nan, np.nan
    x[7, :15], x[8, 15:] = np.nan, np.nan  # nothing in common
    rows = [(f"n{i:02d}", j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)] + [("n06", 1, None)]
    found = relative.correlations(spark.createDataFrame(rows, "symbol string, session int, ret double"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i in range(13):
        for j in range(i + 1, 13):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.any():
                a, b = x[i, both], x[j, both]
                want[f"n{i:02d}", f"n{j:02d}"] = 0.0 if np.ptp(a) == 0 or np.ptp(b) == 0 else float(np.corrcoef(a, b)[0, 1])
    got = {(r["a"], r["b"]): r["rho"] for r in found.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in want)
