"""Running compositions and quantiles by selection against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.functions.features import ewm
from sextant.functions.windows import composed, exact_quantiles


@pytest.mark.parametrize("block", [3, 1000])
def test_compositions(spark, block):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(rng.uniform(0.2, 1.1)), float(rng.normal())) for g, n in (("a", 50), ("b", 1), ("c", 9)) for i in range(n)]
    got = {(r["g"], r["pos"]): (r["a"], r["b"]) for r in composed(spark.createDataFrame(rows, "g string, pos int, a double, b double"), ["g"], block).collect()}
    now = None
    for g, i, a, b in rows:
        now = (a, b) if i == 0 else (now[0] * a, now[1] * a + b)
        assert np.allclose(got[g, i], now, rtol=1e-12)
    assert len(got) == len(rows)


def test_wilder_means_with_gaps(spark):
    rng = np.random.default_rng(2)
    day = dt.date(2020, 1, 1)
    series = {s: np.where(rng.random(300) < gap, np.nan, rng.normal(size=300)) for s, gap in (("x", 0.0), ("y", 0.3), ("z", 0.97))}
    series["w"] = np.full(300, np.nan)
    df = spark.createDataFrame([(s, day + dt.timedelta(i), None if np.isnan(v) else float(v), float(i)) for s, x in series.items() for i, v in enumerate(x)], "symbol string, session date, v double, u double")
    got = {(r["symbol"], (r["session"] - day).days): (r["_e_v"], r["_e_u"]) for r in ewm(df, ["v", "u"], 5).collect()}
    for s, x in series.items():
        for values, at in ((x, 0), (np.arange(300.0), 1)):
            want = pd.Series(values).ewm(alpha=1 / 5, adjust=False, min_periods=5).mean()
            mine = np.array([np.nan if got[s, i][at] is None else got[s, i][at] for i in range(300)])
            assert np.allclose(mine, want, rtol=1e-10, equal_nan=True)


@pytest.mark.parametrize("slices", [2, 5, 32])
def test_quantiles_are_exact(spark, slices):
    rng = np.random.default_rng(3)
    groups = {"wide": rng.normal(size=900), "ties": rng.integers(0, 4, 333).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "same": np.full(50, 3.0), "inf": np.array([1.0, np.inf, 2.0, -np.inf, 5.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("none", None), ("wide", float("nan"))]
    qs = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, slices).collect()}
    assert len(got) == len(groups) * len(qs)
    for g, x in groups.items():
        for q in qs:
            n, value = got[g, q]
            low, high = np.sort(x)[[int(np.floor((len(x) - 1) * q)), int(np.ceil((len(x) - 1) * q))]]
            assert n == len(x) and (value == low == high or np.isclose(value, np.quantile(x, q), rtol=1e-12, equal_nan=True) or not np.isfinite(high))
    assert exact_quantiles(spark.createDataFrame(rows, "g string, v double").where(F.lit(False)), ["g"], "v", qs).count() == 0
