"""Operators on small fixtures with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.functions import features, options
from sextant.functions.special import normal_cdf, normal_quantile, t_tail
from sextant.functions.windows import quantile_bucket
from sextant.operators import metrics, panel, pit, resample, risk, security, signals, stats, trades, validation
from sextant.operators.costs import PROFILES, Costs
from sextant.plans import research_log
from sextant.sources import vendors
from sextant.sources.store import DataProblem, Store, derive_label
from sextant.streaming import bars as stream


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(i)


@pytest.fixture(scope="module")
def market(spark):
    """Two symbols over 120 sessions, one with gaps; a split and a dividend."""
    rng = np.random.default_rng(1)
    rows = []
    for s, gap in (("A", ()), ("B", (30, 31, 77))):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
        for i in range(120):
            if i not in gap:
                o = c[i] * (1 + rng.normal(0, 0.005))
                rows.append((s, day(i), float(o), float(max(o, c[i]) * 1.01), float(min(o, c[i]) * 0.99), float(c[i]), float(1e6 + i)))
    bars = spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, volume double")
    acts = spark.createDataFrame([("A", day(50), "split", 2.0), ("A", day(60), "dividend", 1.5), ("A", day(500), "dividend", 9.0)], "symbol string, ex_date date, action string, value double")
    return panel.build_panel(bars, acts).cache()


def pandas_of(p, symbol):
    return p.where(F.col("symbol") == symbol).toPandas().sort_values("session").reset_index(drop=True)


def test_total_return_spans_gaps_and_actions(market):
    a, b = pandas_of(market, "A"), pandas_of(market, "B")
    assert len(a) == len(b) == 120 and math.isnan(b["ret"][30]) and math.isnan(b["close"][30])
    assert math.isclose(b["ret"][32], b["raw_close"][32] / b["raw_close"][29] - 1)
    assert math.isclose(a["ret"][50], 2 * a["raw_close"][50] / a["raw_close"][49] - 1) and math.isclose(a["ret"][60], (a["raw_close"][60] + 1.5) / a["raw_close"][59] - 1)
    assert math.isclose(a["close"][119], a["raw_close"][0] * (1 + a["ret"].fillna(0)).prod(), rel_tol=1e-10)
    assert math.isclose(a["volume"][60], a["raw_volume"][60] / 2)


@pytest.mark.parametrize("spec", ["rsi(n=14)", "atr(n=14)"])
def test_wilder_features_match_pandas(market, spec):
    got = pandas_of(features.add(market, spec, "x"), "B")
    c, h, low = got["close"], got["high"], got["low"]
    if spec.startswith("rsi"):
        d = c.diff()
        up, dn = (d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
        want = 100 - 100 / (1 + up / dn)
    else:
        tr = np.maximum(np.maximum(h - low, (h - c.shift()).abs()), (low - c.shift()).abs())
        want = pd.Series(tr).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / c
    pd.testing.assert_series_equal(got["x"], want, check_names=False)


@pytest.mark.parametrize("spec", ["mom(lookback=20, skip=2)", "zret(h=2, vol_n=10)", "rsi", "breadth(n=10)", "beta(n=20, market=A)", "drawdown(n=10)"])
def test_features_have_no_look_ahead(market, spec):
    assert features.leaks(market, spec, [day(60), day(100)]).count() == 0


def test_a_leaky_feature_is_caught(market):
    features.FAMILIES["leaky"] = (lambda p: F.lead("close").over(features.by_symbol()), {})
    try:
        assert features.leaks(market, "leaky", [day(60)]).count() > 0
    finally:
        del features.FAMILIES["leaky"]


def test_specs():
    assert features.canonical("mom(skip=5)") == "mom(lookback=252,skip=5)" and features.parse("vol")[1] == {"n": 21}
    for bad in ("nope", "mom(window=3)"):
        with pytest.raises(KeyError):
            features.parse(bad)


def test_asof_passes_over_late_revisions(spark):
    ts = lambda d, h: dt.datetime(2024, 1, d, h)
    v = spark.createDataFrame([("x", dt.date(2024, 1, 2), 10.0, ts(2, 21), 1), ("x", dt.date(2024, 1, 3), 11.0, ts(3, 21), 2), ("x", dt.date(2024, 1, 2), 99.0, ts(5, 12), 3)], "s string, observation_date date, value double, available_at timestamp, seq int")
    d = spark.createDataFrame([("x", ts(2, 20)), ("x", ts(2, 22)), ("x", ts(4, 0)), ("x", ts(6, 0))], "s string, decision_at timestamp")
    got = [r["value"] for r in pit.asof_backward(d, v, ["s"]).orderBy("decision_at").collect()]
    assert got == [None, 10.0, 11.0, 11.0]
    with pytest.raises(pit.LookAheadError):
        pit.assert_available(v, ts(4, 0))


def test_vintages(spark):
    v = spark.createDataFrame([("g", dt.date(2024, 3, 31), 1.0, dt.datetime(2024, 4, 25), 1), ("g", dt.date(2024, 3, 31), 1.5, dt.datetime(2024, 5, 30), 2)], "s string, p date, value double, available_at timestamp, seq int")
    at = lambda m: [r["value"] for r in pit.as_of(v, dt.datetime(2024, m, 1), ["s", "p"]).collect()]
    assert (at(4), at(5), at(6)) == ([], [1.0], [1.5])


def test_reused_and_renamed_identifiers(spark):
    d = dt.date
    i = spark.createDataFrame([("old", "DELL", d(1990, 1, 1), d(2013, 10, 29)), ("new", "DELL", d(2018, 12, 28), None), ("pcln", "PCLN", d(1999, 1, 1), d(2018, 2, 26)), ("pcln", "BKNG", d(2018, 2, 27), None)], "security_id string, value string, valid_from date, valid_to date")
    q = spark.createDataFrame([("DELL", d(2010, 1, 1)), ("DELL", d(2024, 1, 1)), ("DELL", d(2015, 1, 1))], "value string, as_of date")
    got = {(r["value"], r["as_of"].year): r["security_id"] for r in security.resolve(i, q).collect()}
    assert got == {("DELL", 2010): "old", ("DELL", 2024): "new", ("DELL", 2015): None}
    assert security.attribute(i, spark.createDataFrame([("pcln", d(2018, 3, 1))], "security_id string, as_of date")).first()["value"] == "BKNG"
    assert security.overlaps(i).count() == 0


def test_halts_and_membership(spark):
    d = dt.date
    p = spark.createDataFrame([(d(2008, 9, x), "LEH", 1.0) for x in (12, 15, 16, 17)], "session date, symbol string, raw_volume double")
    sec = spark.createDataFrame([("LEH", d(1994, 1, 1), None)], "security_id string, first_session date, last_session date")
    ev = spark.createDataFrame([("LEH", "halt", d(2008, 9, 16))], "symbol string, event_type string, event_date date")
    assert [r["tradable"] for r in security.tradable(p, sec, ev).orderBy("session").collect()] == [True, True, False, False]
    m = spark.createDataFrame([("OLD", d(2000, 1, 1), d(2020, 6, 22), dt.datetime(2000, 1, 1)), ("NEW", d(2020, 6, 22), None, dt.datetime(2020, 6, 12, 22))], "symbol string, start_date date, end_date date, available_at timestamp")
    assert [r[0] for r in security.members(m, "2020-06-19").collect()] == ["OLD"] and [r[0] for r in security.members(m, "2020-06-22").collect()] == ["NEW"]


def test_bar_checks(spark):
    d = dt.date
    b = spark.createDataFrame([("A", d(2024, 1, 2), 10.0, 11.0, 9.0, 10.5, 100.0), ("A", d(2024, 1, 3), 10.0, 9.5, 9.0, 10.5, 100.0), ("A", d(2024, 1, 4), -1.0, 11.0, 9.0, 10.5, 100.0), ("A", d(2024, 1, 6), 10.0, 11.0, 9.0, 10.5, 0.0)], "symbol string, session date, open double, high double, low double, close double, volume double")
    s = spark.createDataFrame([(d(2024, 1, x),) for x in (2, 3, 4, 5, 8)], "session date")
    got = {r["check"]: r["n"] for r in validation.validate_bars(b.where("session < '2024-01-06'").unionByName(b.where("session = '2024-01-06'")), s).collect()}
    assert got["ohlc_inconsistent"] >= 1 and got["non_positive_or_missing_price"] == 1 and got["non_trading_session"] == 1 and got["zero_volume"] == 1


def test_multiple_testing(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005)], "id int, p double")
    r = {x["id"]: x for x in stats.adjust(p, "p", ["id"]).collect()}
    near = lambda name, want: np.allclose([r[i][name] for i in range(4)], want)
    assert near("bonferroni", [0.04, 0.16, 0.12, 0.02]) and near("holm", [0.03, 0.06, 0.06, 0.02]) and near("bh", [0.02, 0.04, 0.04, 0.02])
    assert near("by", np.array([0.02, 0.04, 0.04, 0.02]) * (1 + 1 / 2 + 1 / 3 + 1 / 4))


def test_special_functions(spark):
    x = spark.createDataFrame([(0.0,), (1.96,)], "x double")
    got = [r[0] for r in x.select(normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5, 0.9750021]) and math.isclose(x.select(normal_quantile(F.lit(0.975))).first()[0], 1.959964, rel_tol=1e-6)
    assert math.isclose(t_tail(2.0, 10), 0.03669401738537, rel_tol=1e-9)


def test_quantile_buckets_match_rank_cuts(spark):
    for n in (50, 52, 57):
        got = [r[0] for r in spark.range(1, n + 1).orderBy("id").select(quantile_bucket(F.col("id"), F.lit(n), 5)).collect()]
        assert got == (pd.qcut(pd.Series(range(n)), 5, labels=False) + 1).tolist()


def test_hac_matches_numpy(spark):
    x = np.random.default_rng(0).normal(0.1, 1, 300)
    r = stats.hac_test(spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, i int, x double"), ["g"], "i", "x", lags=4).first()
    u = x - x.mean()
    s = (u @ u + 2 * sum((1 - k / 5) * (u[k:] @ u[:-k]) for k in range(1, 5))) / 300
    assert math.isclose(r["se"], math.sqrt(s / 300), rel_tol=1e-9) and math.isclose(r["t"], x.mean() / math.sqrt(s / 300), rel_tol=1e-9)


def test_option_values(spark):
    one = spark.range(1)
    a = tuple(F.lit(v) for v in (100.0, 100.0, 1.0, 0.05, 0.0, 0.2))
    call, put = F.lit(True), F.lit(False)
    c, p = one.select(options.bs_price(*a, call), options.bs_price(*a, put)).first()
    assert math.isclose(c, 10.450584, rel_tol=1e-6) and math.isclose(p, 5.573526, rel_tol=1e-6)
    assert math.isclose(one.select(options.implied_vol(F.lit(c), *a[:5], call)).first()[0], 0.2, rel_tol=1e-6)
    amer, euro = one.select(options.crr_price(*a, put, True, 400), options.crr_price(*a, put, False, 400)).first()
    assert abs(euro - p) < 0.02 and amer > euro and one.select(options.implied_vol(F.lit(200.0), *a[:5], call)).first()[0] is None
    g = one.select(*[v.alias(k) for k, v in options.bs_greeks(*a, call).items()]).first()
    assert math.isclose(g["delta"], 0.636831, rel_tol=1e-5) and math.isclose(g["vega"], 37.524, rel_tol=1e-4)


def plain_tree(s, k, t, r, q, v, call, american, steps):
    """One option, node by node."""
    dt, sign = t / steps, 1 if call else -1
    u = math.exp(v * math.sqrt(dt))
    p, disc = (math.exp((r - q) * dt) - 1 / u) / (u - 1 / u), math.exp(-r * dt)
    worth = lambda n: sign * (s * u ** (n - 2.0 * np.arange(n + 1)) - k)
    value = np.maximum(worth(steps), 0)
    for n in range(steps - 1, -1, -1):
        value = disc * (p * value[:-1] + (1 - p) * value[1:])
        value = np.maximum(value, worth(n)) if american else value
    return value[0]


def test_crr_query_takes_every_step(spark):
    from sextant.plans import queries_models

    c = queries_models.chain(spark, "/root/testdata/sf0.001").where("underlying % 100 = 7").collect()
    got = {(r["underlying"], r["days"], r["k"], r["right"]): r for r in queries_models.crr_price(spark, "/root/testdata/sf0.001").where("underlying % 100 = 7").collect()}
    assert len(got) == len(c) > 50
    for r in c:
        american, european = (plain_tree(r["spot"], r["strike"], r["t"], 0.04, 0.01, r["iv"], r["right"] == "C", x, 400) for x in (True, False))
        row = got[r["underlying"], r["days"], r["k"], r["right"]]
        assert abs(row["american"] - american) < 6e-6 and abs(row["premium"] - (american - european)) < 6e-6


def test_options_of_one_moneyness_share_a_tree(monkeypatch):
    rng, n = np.random.default_rng(0), 200
    s = rng.choice([50.0, 100.0, 1e5, 0.0, np.nan], n)
    k = np.where(s > 0, s, 80.0) * rng.choice([0.5, 1.0, 2.0], n)
    numbers, call = [s, k, rng.choice([0.1, 1.0], n), np.full(n, 0.05), rng.choice([0.0, 0.08], n), rng.choice([0.2, 0.4], n)], rng.random(n) < 0.5
    want = np.array([[plain_tree(*(x[i] for x in numbers), call[i], american, 30) for i in range(n)] for american in (False, True)])
    run, asked = options._tree_array, []
    monkeypatch.setattr(options, "_tree_array", lambda *x: asked.append(len(x[0])) or run(*x))
    of = options._trees(30, True)
    columns = tuple(pd.Series(x) for x in (*numbers, call))
    for _ in range(2):
        assert np.allclose(of(columns), want, rtol=1e-9, atol=1e-9, equal_nan=True)
    assert sum(asked) < n and len(asked) == 1
    monkeypatch.setattr(options, "KEPT", 10)  # what no longer fits is worked out again
    of = options._trees(30, True)
    assert all(np.allclose(of(tuple(x[i : i + 50] for x in columns)), want[:, i : i + 50], rtol=1e-9, atol=1e-9, equal_nan=True) for i in (0, 50, 0))


def test_breakevens(spark):
    leg = "array<struct<qty:double,strike:double,right:string,premium:double>>"
    pos = spark.createDataFrame([(1, [(1.0, 100.0, "C", 5.0), (1.0, 100.0, "P", 5.0)], 100.0)], f"id int, legs {leg}, spot double")
    r = options.breakevens(pos, "id", "legs", "spot").first()
    assert np.allclose(r["breakevens"], [90, 110]) and r["max_profit"] is None and math.isclose(r["max_loss"], -10)


def test_greedy_trades_and_slots(spark, market):
    p = signals.random_signal(market, 0.3, 3)
    c = trades.candidates(p, PROFILES["retail_etf"], holding=3)
    kept = trades.without_overlap(c).toPandas().sort_values(["symbol", "entry_pos"])
    assert all((g["entry_pos"].to_numpy()[1:] > g["exit_pos"].to_numpy()[:-1]).all() for _, g in kept.groupby("symbol"))
    daily = trades.to_daily(trades.without_overlap(c), market.select("session").distinct(), 2).toPandas()
    assert len(daily) == 120 and np.isclose(np.log1p(daily["ret"] * 2).sum(), np.log1p(kept["net_ret"]).sum(), atol=0.05)


def test_trade_summary(spark):
    r = metrics.trades_summary(spark.createDataFrame([(1, x) for x in (0.1, -0.05, 0.02, -0.01)], "g int, ret double"), ["g"]).first()
    assert r["win_rate"] == 0.5 and math.isclose(r["profit_factor"], 2) and math.isclose(r["payoff"], 2)


def test_var_es(spark):
    r = stats.var_es(spark.createDataFrame([(1, 0.01)] * 94 + [(1, -0.1)] * 6, "g int, x double"), ["g"], "x").first()
    assert math.isclose(r["var"], 0.1) and math.isclose(r["es"], 0.1)


def test_cusum_closed_form(spark):
    x = np.random.default_rng(3).normal(-0.5, 1, 200)
    got = stats.cusum(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, x double"), ["g"], ["i"], "x", 0.0, 1.0).orderBy("i").toPandas()["cusum"]
    s, want = 0.0, []
    for v in x:
        s = max(0, s - v - 0.5)
        want.append(s)
    assert np.allclose(got, want)


def test_resampling(spark):
    x = np.random.default_rng(0).normal(0.2, 1, 200)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(x - x.mean())] + [("c", 0, 1.0)], "g string, i int, x double")
    a, b = ({r["g"]: r for r in resample.bootstrap_ci(rows, ["g"], ["i"], "x", 300, seed=1).collect()} for _ in range(2))
    assert a == b and set(a) == {"a", "b"} and a["a"]["lo"] < x.mean() < a["a"]["hi"]
    width = a["a"]["hi"] - a["a"]["lo"]
    assert 0.6 < width / (2 * 1.96 * x.std() / math.sqrt(200)) < 1.5
    p = {r["g"]: r["p"] for r in resample.sign_flip_test(rows, ["g"], ["i"], "x", 300).collect()}
    assert p["a"] < 0.05 < p["b"]


def test_risk(spark):
    base = {"equity": 1e5, "cash": 1e5, "held": 0.0, "gross": 0.0, "sector_value": 0.0, "beta": 1.0, "beta_exposure": 0.0, "adv": 1e9, "drawdown": 0.0, "var95": None, "event_risk": False, "event_value": 0.0, "loss_share": None, "vega_share": None}
    t = [base | {"id": i, "notional": n} | more for i, n, more in ((1, 1000.0, {}), (2, 5e4, {}), (3, 1000.0, {"drawdown": -0.3}), (4, -1000.0, {"drawdown": -0.3}), (5, 1000.0, {"var95": 0.05}), (6, 2e4, {"event_risk": True}), (7, 6e3, {"loss_share": 1.0}), (8, 1000.0, {"cash": 1000.0}))]
    kinds = ", ".join(f"{k} {'int' if k == 'id' else 'boolean' if k == 'event_risk' else 'double'}" for k in t[0])
    df = spark.createDataFrame([tuple(r.values()) for r in t], kinds)
    got = {r["id"]: (r["verdict"], r["binding"]) for r in risk.gate(df).collect()}
    assert got == {1: ("APPROVE", None), 2: ("REDUCE", "position"), 3: ("REJECT", "hard"), 4: ("APPROVE", None), 5: ("REJECT", "hard"), 6: ("REDUCE", "event_risk"), 7: ("REDUCE", "option_premium_at_risk"), 8: ("REJECT", "cash")}
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([("g", float(v)) for v in rng.choice([0.1, -0.08], 400)], "g string, x double")
    k = risk.kelly_empirical(x, ["g"], "x").first()["kelly"]
    v = np.array([r["x"] for r in x.collect()])
    f = np.linspace(0.001, 9.9, 2000)
    assert abs(k - f[np.argmax([np.log1p(z * v).mean() if (1 + z * v).min() > 0 else -9 for z in f])]) < 0.05


def test_chain_detects_changes(spark):
    e = spark.createDataFrame([("l", i, f"p{i}") for i in range(6)], "log string, seq int, payload string")
    log = research_log.chain(e, "log", "seq", "payload")
    assert research_log.broken(log, "log").count() == 0
    bad = log.withColumn("payload", F.when(F.col("seq") == 3, "changed").otherwise(F.col("payload")))
    assert [r["seq"] for r in research_log.broken(bad, "log").collect()] == [3]
    assert research_log.broken(log.where("seq <> 2"), "log").count() == 1
    with pytest.raises(ValueError):
        research_log.grid(["a"] * 5, [1.0] * 5, [5])


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    df = spark.createDataFrame([("x", dt.date(2024, 1, 1), dt.datetime(2024, 1, 2), 1.0, "src")], "series_id string, observation_date date, available_at timestamp, value double, source string")
    h = s.save("macro_series", df)
    assert s.save("macro_series", df) == h == s.latest("macro_series") and s.load("macro_series").count() == 1
    assert s.query("SELECT sum(value) AS v FROM m", m="macro_series").first()["v"] == 1.0
    with pytest.raises(DataProblem):
        s.save("macro_series", df.union(df))
    s.save("macro_series", df.union(df), force=True)
    assert s.forced_errors().count() == 1 and derive_label(["REAL", "SIMULATED"]) == "SIMULATED"


def test_vendor_files(spark, tmp_path):
    cal = vendors.calendar(spark, "2020-08-28", "2020-09-02", early=["2020-08-28"])
    assert {r["close_at"].hour for r in cal.collect()} == {17, 20}
    (tmp_path / "s.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-08-29,1,1,1,1,1\n2020-08-31,1,2,1,x,5\n")
    r = vendors.read_stooq(spark, str(tmp_path / "s.csv"), "S", cal).collect()
    assert len(r) == 1 and r[0]["close"] is None and r[0]["available_at"].minute == 15
    (tmp_path / "bad.csv").write_text("No data\n")
    with pytest.raises(ValueError):
        vendors.read_stooq(spark, str(tmp_path / "bad.csv"), "S", cal)
    (tmp_path / "t.json").write_text('[{"date":"2020-08-31T00:00","open":1,"high":1,"low":1,"close":1,"volume":1,"splitFactor":4.0,"divCash":0},{"date":"2020-09-01T00:00","open":1,"high":1,"low":1,"close":1,"volume":1,"splitFactor":1.0,"divCash":0.2}]')
    bars, acts = vendors.read_tiingo(spark, str(tmp_path / "t.json"), "T", cal)
    assert bars.count() == 2 and {(r["action"], r["value"]) for r in acts.collect()} == {("split", 4.0), ("dividend", 0.2)}
    (tmp_path / "f.json").write_text('{"observations":[{"date":"2020-01-01","value":".","realtime_start":"2020-02-01"},{"date":"2020-01-01","value":"2.5","realtime_start":"2020-02-01"}]}')
    f = vendors.read_fred(spark, str(tmp_path / "f.json"), "G", True).collect()
    assert len(f) == 1 and f[0]["value"] == 2.5 and f[0]["available_at"] == dt.datetime(2020, 2, 2, 4, 59)


def test_results_releases(spark):
    d, t = dt.date, dt.datetime
    rows = [("a1", d(2004, 12, 31), t(2005, 2, 20), "10-K", ""), ("a2", d(2005, 1, 11), t(2005, 1, 11), "8-K", "2.02,9.01"), ("a3", d(2005, 1, 12), t(2005, 2, 1), "8-K", "2.02"), ("a4", d(2005, 3, 31), t(2005, 5, 1), "10-Q", ""), ("a5", d(2005, 4, 20), t(2005, 4, 30), "8-K", "2.02"), ("a6", d(2005, 4, 20), t(2005, 4, 30), "8-K", "5.02")]
    f = spark.createDataFrame([("S", *r) for r in rows], "symbol string, accessionNumber string, report_date date, accepted_at timestamp, form string, items string")
    got = {r["period_end"]: r["accession"] for r in vendors.earnings(f, ["symbol"]).collect()}
    assert got == {d(2004, 12, 31): "a3", d(2005, 3, 31): "a5"}  # 30 days after, as the single-candidate quarter


def test_streams_equal_batches(spark):
    from sextant.sources.adapters import bars_intraday

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = "/root/testdata/sf0.001/events*.parquet"
    got = stream.run_to_table(stream.streaming_bars(stream.ticks(spark, folder, e.schema).withColumn("ts", F.col("ts").cast("timestamp")), late="0 seconds"), "bars_stream", "append")
    want = {(r["symbol"], str(r["bar_start"])): r["close"] for r in bars_intraday(spark, "/root/testdata/sf0.001").collect()}
    rows = got.collect()
    assert len(rows) > 0.9 * len(want) and all(want[r["symbol"], str(r["bar_start"])] == r["close"] for r in rows)
    c = stream.run_to_table(stream.streaming_cusum(stream.ticks(spark, folder, e.schema), 50.0, 30.0), "cusum_stream", "update").collect()
    assert sum(r["n"] for r in c) == e.count()


def test_walk_forward_folds(spark):
    s = spark.createDataFrame([(day(i),) for i in range(1300)], "session date")
    f = resample.walk_forward_folds(s, 756, 252, 21).orderBy("fold").collect()
    assert len(f) == 2 and all((r["test_from"] - r["train_to"]).days == 22 and (r["test_to"] - r["test_from"]).days == 251 for r in f)


def test_option_queries_take_the_whole_chain(spark):
    from sextant import registry

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    for name in ("implied_vol", "crr_price"):
        got = registry.QUERIES[name](spark, sf)
        assert got.count() == 54 * parts == got.select("underlying", "days", "k", "right").distinct().count()


def test_weights_without_features_are_no_decision(spark):
    rows = [(day(0), "A", None), (day(0), "B", None), (day(1), "A", 1.0), (day(1), "B", None), (day(2), "A", -1.0), (day(2), "B", -2.0)]
    p = spark.createDataFrame(rows, "session date, symbol string, x double")
    got = {(r["session"], r["symbol"]): r["weight"] for r in signals.state_weights(p, [("x", ">", 0.0)]).collect()}
    assert [got[day(i), s] for i in range(3) for s in "AB"] == [None, None, 1.0, 0.0, 0.0, 0.0]


def test_forward_session_is_the_first_that_closes_after(spark):
    t = lambda d, h: dt.datetime(2020, 1, d, h)
    s = spark.createDataFrame([(dt.date(2020, 1, d), t(d, 16)) for d in (2, 3, 6)], "session date, close_at timestamp")
    e = spark.createDataFrame([(1, t(1, 9)), (2, t(2, 16)), (3, t(2, 17)), (4, t(3, 18)), (5, t(6, 16)), (6, t(6, 17)), (7, None)], "id int, at timestamp")
    got = {r["id"]: r["session"] and r["session"].day for r in pit.asof_forward(e, s, "at").collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 6, 5: 6, 6: None, 7: None}


def test_refused_trades_and_whole_contracts(spark):
    t = spark.createDataFrame([(1, "equity", -5.0, 3.0, False, True, None), (2, "option", -1.0, 0.0, True, False, 5.0), (3, "option", 1.0, 0.0, False, True, None), (4, "option", 1.0, 0.0, False, True, 9.0)],
        "id int, kind string, quantity double, existing double, short_option boolean, defined_risk boolean, max_loss double")
    assert {r["id"]: r["why"] for r in risk.refusals(t).collect()} == {1: "short stock", 2: "undefined risk", 3: "no largest loss", 4: ""}
    units = t.select(risk.whole_units(F.lit(2750.0), F.lit(500.0), F.col("kind"), F.lit(1)).alias("u")).collect()
    assert [r["u"] for r in units] == [2750.0, 2500.0, 2500.0, 2500.0]


def test_positions(spark):
    s = F.lit(100.0)
    legs = options.covered_call(s, F.lit(105.0), F.lit(0.5), F.lit(3.0))
    p = spark.range(1).select(F.col("id"), s.alias("spot"), legs.alias("legs"))
    m = options.position_marks(p, "id", "legs", "spot", 0.0, 0.0, F.lit(0.2)).first()
    d1 = (math.log(100 / 105) + 0.02 * 0.5) / (0.2 * math.sqrt(0.5))
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    call = 100 * phi(d1) - 105 * phi(d1 - 0.2 * math.sqrt(0.5))
    assert math.isclose(m["value"], 3.0 - call, rel_tol=1e-6) and math.isclose(m["delta"], 1 - phi(d1), rel_tol=1e-6)
    b = options.breakevens(p.withColumn("legs", options.vertical("C", F.lit(95.0), F.lit(105.0), F.lit(0.5), F.lit(7.0), F.lit(3.0))), "id", "legs", "spot", 0.6, 241).first()
    assert b["breakevens"] == [99.0] and math.isclose(b["max_profit"], 6.0) and math.isclose(b["max_loss"], -4.0)


def test_unknown_kinds_are_told(spark):
    from sextant.operators import evaluation

    assert evaluation.template_kind("measurement:vrp") == "measurement"
    with pytest.raises(KeyError):
        evaluation.template_kind("nothing")
    with pytest.raises(Exception, match="unknown universe kind"):
        research_log.universe_flags(spark.createDataFrame([("a", "funds")], "name string, kind string")).collect()

