"""Relative value, slots and resampling against plain numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import learn, relative, resample, trades

DAY = dt.date(2010, 1, 1)


def panel(spark, columns, name="ret"):
    """Long rows of {symbol: values}; NaN for missing."""
    rows = [(DAY + dt.timedelta(i), s, None if np.isnan(v) else float(v)) for s, x in columns.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"session date, symbol string, {name} double")


def plain_unit_root(x, most, constant):
    x = np.asarray(x, float)
    dx = np.diff(x)

    def fit(lags, skip):
        y = dx[skip:]
        m = np.stack([x[skip:-1], *[dx[skip - k : len(dx) - k] for k in range(1, lags + 1)], *([np.ones(len(y))] if constant else [])], 1)
        b = np.linalg.lstsq(m, y, rcond=None)[0]
        r = y - m @ b
        return b[0] / math.sqrt(r @ r / (len(y) - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0]), len(y) * math.log(r @ r / len(y)) + 2 * m.shape[1]

    best = min(range(most + 1), key=lambda k: fit(k, most)[1])
    return fit(best, best)[0], best


def pair(n, seed, joined):
    rng = np.random.default_rng(seed)
    x, e = np.cumsum(rng.normal(0, 0.01, n)), np.zeros(n)
    for t in range(1, n):
        e[t] = 0.95 * e[t - 1] + rng.normal(0, 0.005)
    return np.exp(0.8 * x + (e if joined else np.cumsum(rng.normal(0, 0.01, n))) + 4), np.exp(x + 4)


def test_cointegration(spark):
    y, x = pair(900, 0, True)
    _, z = pair(900, 5, False)
    short = np.where(np.arange(900) < 60, z, np.nan)
    gaps = np.where(np.arange(900) % 7 == 3, np.nan, y)
    p = panel(spark, {"y": y, "x": x, "z": z, "short": short, "gaps": gaps}, "close")
    got = {(r["y"], r["x"]): r for r in relative.engle_granger(p).collect()}
    assert len(got) == 20 and got["y", "short"]["t"] is None and got["y", "short"]["n"] == 60
    for a, b, sa, sb in (("y", "x", y, x), ("x", "y", x, y), ("z", "x", z, x), ("gaps", "z", gaps, z)):
        both = ~np.isnan(sa) & ~np.isnan(sb)
        la, lb = np.log(sa[both]), np.log(sb[both])
        slope, cut = np.polyfit(lb, la, 1)
        t, lags = plain_unit_root(la - slope * lb - cut, relative.default_lags(len(la)), False)
        r = got[a, b]
        assert abs(r["hedge"] - slope) < 1e-8 and abs(r["t"] - t) < 1e-6 and r["lags"] == lags and r["n"] == len(la)
    assert got["y", "x"]["p"] < 0.01 < 0.05 < got["z", "x"]["p"]
    assert got["gaps", "y"]["t"] == -math.inf  # the same series


def test_unit_roots(spark):
    rng = np.random.default_rng(0)
    still = np.zeros(400)
    for i in range(1, 400):
        still[i] = 0.5 * still[i - 1] + rng.normal()
    series = {"walk": 100 + np.cumsum(rng.normal(size=400)), "still": still, "flat": np.full(400, 3.0), "short": np.where(np.arange(400) < 30, still, np.nan)}
    got = {r["symbol"]: r for r in relative.unit_root_tests(panel(spark, series, "x"), ["symbol"], "session", "x").collect()}
    for name in ("walk", "still"):
        t, lags = plain_unit_root(series[name], relative.default_lags(400, True), True)
        assert abs(got[name]["t"] - t) < 1e-6 and got[name]["lags"] == lags
    assert got["walk"]["p"] > 0.05 and got["still"]["p"] < 0.001 and got["flat"]["t"] is None and got["short"]["p"] is None


def test_p_values_at_published_points(spark):
    """Critical values of the statistics give back their levels."""
    points = [(1, -3.43, 0.01), (1, -2.86, 0.05), (1, -2.57, 0.10), (2, -3.90, 0.01), (2, -3.34, 0.05), (2, -3.05, 0.10), (1, 3.0, 1.0), (2, -30.0, 0.0)]
    df = spark.createDataFrame([(t, p) for _, t, p in points], "t double, p double")
    for (series, t, p) in points:
        r = df.where(F.col("t") == t).select(relative.unit_root_p(F.col("t"), series)).first()[0]
        assert abs(r - p) < 0.003


def returns(n=420, k=8, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.01, n)
    return {f"S{i}": m * rng.uniform(0.8, 1.2) + rng.normal(0, 0.005, n) for i in range(k)}


@pytest.mark.parametrize("factors, steps", [(1, 24), (2, 24), (1, 5)])
def test_factor_residuals(spark, factors, steps):
    r = returns()
    r["S3"][7] = np.nan
    x = np.nan_to_num(np.stack([r[s] for s in sorted(r)], 1))
    want = np.full(x.shape, np.nan)
    for i in range(252, len(x)):
        if i % 63 == 0:
            past = x[i - 252 : i] - x[i - 252 : i].mean(0)
            v = np.linalg.svd(past, full_matrices=False)[2][:factors].T
        if i >= 252:
            want[i] = x[i] - v @ (v.T @ x[i])
    got = np.full(x.shape, np.nan)
    for row in relative.pca_residuals(panel(spark, r), factors, 252, 63, steps).collect():
        got[(row["session"] - DAY).days, int(row["symbol"][1:])] = row["residual"]
    assert np.nanmax(np.abs(got - want)) < (1e-10 if steps == 24 else 2e-4) and (np.isnan(got) == np.isnan(want)).all()


def test_explained_variance(spark):
    r = returns()
    r["S1"][5] = np.nan
    x = np.stack([v for v in r.values()], 1)
    x = x[~np.isnan(x).any(1)]
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    got = [row["share"] for row in relative.explained_variance(panel(spark, r), 3).orderBy("component").collect()]
    assert np.allclose(got, (s / s.sum())[:3], atol=1e-10) and got[0] > 0.5


def one_at_a_time(names, d, cut):
    """Average linkage, the nearest pair first; ties by smaller, then larger name."""
    groups = {n: [i] for i, n in enumerate(names)}
    while len(groups) > 1:
        dist, a, b = min((round(float(np.mean([d[i][j] for i in groups[a] for j in groups[b]])), 12), a, b) for a in groups for b in groups if a < b)
        if dist > cut + 1e-12:
            break
        groups[a] += groups.pop(b)
    return {names[i]: n for n, g in groups.items() for i in g}


@pytest.mark.parametrize("seed, levels", [(0, None), (1, None), (2, 4), (3, 3), (4, 2)])
def test_clusters_equal_one_at_a_time(spark, seed, levels):
    rng = np.random.default_rng(seed)
    n, names = 14, [f"n{i:02d}" for i in range(14)]
    rho = np.clip(rng.uniform(-0.2, 1, (n, n)), -1, 1)
    rho = np.round(rho * levels) / levels if levels else rho  # few levels: many ties
    rho = np.minimum(rho, rho.T)
    pairs = spark.createDataFrame([(names[i], names[j], float(rho[i, j])) for i in range(n) for j in range(i + 1, n)], "a string, b string, rho double")
    symbols = spark.createDataFrame([(s,) for s in [*names, "alone"]], "symbol string")
    got = {r["symbol"]: r["cluster"] for r in relative.correlation_clusters(symbols, pairs, 0.5).collect()}
    want = one_at_a_time(names, np.sqrt(np.maximum(2 * (1 - rho), 0)), 1.0)
    assert got == want | {"alone": "alone"} and 1 < len(set(want.values())) < n


@pytest.mark.parametrize("piece, copies", [(512, 1), (3, 1), (3, 4)])
def test_clusters_of_series_keep_no_pairs(spark, monkeypatch, piece, copies):
    """The same clusters as one at a time: with gaps, constants, series without a common session, copies, and clusters of more than a block."""
    monkeypatch.setattr(relative, "PIECE", piece)
    monkeypatch.setattr(relative, "MOST", piece)
    written, pairs = relative.written, []
    monkeypatch.setattr(relative, "written", lambda df, name: pairs.append(written(df, name)) or pairs[-1])
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (24, 40)) + np.repeat(rng.normal(0, 1, (4, 40)), 6, axis=0) * np.repeat([[2.0], [1.2], [0.8], [0.3]], 6, axis=0)
    x[1, rng.random(40) < 0.4], x[7, :20], x[8, 20:], x[20], x[21, 3:], x[22] = np.nan, np.nan, np.nan, 5.0, np.nan, np.nan
    x = np.tile(x, (copies, 1))
    names = [f"n{i:03d}" for i in rng.permutation(len(x))]
    rho = pd.DataFrame(x.T).corr(min_periods=2).fillna(0).to_numpy()
    d = np.sqrt(np.clip(2 * (1 - np.round(rho, 12)), 0, 4))
    p = spark.createDataFrame([(names[i], j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "symbol string, session int, ret double")
    got = {r["symbol"]: r["cluster"] for r in relative.return_clusters(p, 0.25).collect()}
    want = one_at_a_time(names, d, math.sqrt(1.5))
    assert got == want and 3 < len(set(want.values())) < len(want) - 8
    assert not any({"a", "b"} <= set(t.columns) for t in pairs)


def test_cluster_query_writes_no_pairs(spark, monkeypatch):
    """What is written grows with the symbols, not with their pairs."""
    from sextant import registry

    written, rows = relative.written, []
    monkeypatch.setattr(relative, "written", lambda df, name: rows.append(written(df, name)) or rows[-1])
    monkeypatch.setattr(relative, "discard", lambda *tables: None)
    n = registry.QUERIES["correlation_clusters"](spark, "/root/testdata/sf0.01").count()
    assert n == 100 and max(t.count() for t in rows if "session" not in t.columns) < 3 * n


def test_correlations_of_constant_series(spark):
    p = panel(spark, {"a": np.arange(5.0), "b": np.array([1.0, 1, 1, 1, 1]), "c": -np.arange(5.0)})
    assert {(r["a"], r["b"]): round(r["rho"], 9) for r in relative.correlations(p).collect()} == {("a", "b"): 0.0, ("a", "c"): -1.0, ("b", "c"): 0.0}


@pytest.mark.parametrize("seed", range(4))
def test_slots_by_islands(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for run in ("r1", "r2"):
        for i in range(120):
            entry = int(rng.integers(0, 60)) * (3 if seed % 2 else 1)
            rows.append((run, f"s{i:03d}", DAY + dt.timedelta(entry), DAY + dt.timedelta(entry + int(rng.integers(0, 5))), float(rng.normal(0, 0.02))))
    df = spark.createDataFrame(rows, "run string, symbol string, entry_session date, exit_session date, net_ret double")
    want = {}
    for run in ("r1", "r2"):
        busy = [dt.date.min] * 3
        for _, s, e, x, _ in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            free = next((k for k, b in enumerate(busy) if b <= e), None) if x > e else None
            want[run, s] = free
            if free is not None:
                busy[free] = x
    got = {(r["run"], r["symbol"]): r["slot"] for r in trades.slots(df, 3, "run").collect()}
    assert got == want
    assert trades.islands(df, "run").select("run", "island").distinct().count() > 2


def picked(n, draws, seed):
    """The positions that each draw takes, by the same hashes."""
    import hashlib

    u = lambda *p: (int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[: resample.DIGITS], 16) + 0.5) / 16**resample.DIGITS
    p = n ** (-1 / 3)
    most = math.ceil(n * p + 6 * math.sqrt(n * p) + 12)
    for draw in range(draws):
        at, out = 0, []
        for i in range(most):
            if at >= n:
                break
            size = n - at if i == most - 1 else min(1 + math.floor(math.log(u(seed, draw, i, "len")) / math.log(1 - p)), n - at)
            a = math.floor(u(seed, draw, i, "start") * n)
            out += [(a + k) % n for k in range(size)]
            at += size
        assert len(out) == n
        yield out


def test_bootstrap_of_any_statistic(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.02, 150)
    p = panel(spark, {"a": x, "few": np.where(np.arange(150) < 4, x, np.nan)})
    picks = [x[i] for i in picked(150, 60, 3)]
    cases = {
        "sharpe": (resample.bootstrap(p, ["symbol"], ["session"], *resample.sharpe_sums("ret"), 60, seed=3), lambda v: v.mean() / v.std(ddof=1) * math.sqrt(252)),
        "ratio": (resample.bootstrap(p.where("ret IS NOT NULL"), ["symbol"], ["session"], *resample.ratio_sums(F.greatest("ret", F.lit(0.0)), F.greatest(-F.col("ret"), F.lit(0.0))), 60, seed=3), lambda v: np.maximum(v, 0).sum() / np.maximum(-v, 0).sum()),
        "quantile": (resample.bootstrap_quantile(p, ["symbol"], ["session"], "ret", 0.37, 60, seed=3), lambda v: np.quantile(v, 0.37)),
    }
    for made, of in cases.values():
        rows = made.collect()
        assert [r["symbol"] for r in rows] == ["a"]
        drawn = np.array([of(v) for v in picks])
        r = rows[0]
        assert np.allclose([r["estimate"], r["lo"], r["hi"], r["p_le_zero"]], [of(x), np.quantile(drawn, 0.025), np.quantile(drawn, 0.975), (drawn <= 0).mean()], atol=1e-9)


def test_explanations(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        a, b = rng.normal(), rng.normal()
        rows.append((DAY + dt.timedelta(i // 4), f"s{i % 4}", a, b, float(rng.random() < 1 / (1 + np.exp(-2 * a)))))
    df = spark.createDataFrame(rows, "session date, symbol string, a double, b double, label double")
    fitted = learn.estimator("logistic", ["a", "b"], "label").fit(df)
    got = learn.explain(fitted, df, ["a", "b"], "label", size=300, repeats=3, grid=6).collect()
    value = {r["feature"]: r["value"] for r in got if r["kind"] == "importance"}
    assert value["a"] > 0.05 > abs(value["b"]) and all(r["sd"] >= 0 for r in got if r["kind"] == "importance")
    curve = sorted((r["at"], r["value"]) for r in got if r["kind"] == "dependence" and r["feature"] == "a")
    assert len(curve) == 6 and all(x[1] < y[1] for x, y in zip(curve, curve[1:]))
    # by hand: the sample with `a` set to the first grid point
    few = learn._sampled(df, ["a", "b"], "label", 300, 0).withColumn("a", F.lit(curve[0][0]))
    from pyspark.ml.functions import vector_to_array

    assert abs(fitted.transform(few).agg(F.avg(vector_to_array("probability")[1])).first()[0] - curve[0][1]) < 1e-9
