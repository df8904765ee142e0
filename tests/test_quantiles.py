"""Distributed exact quantiles and bucketed prefix sums against pandas."""

import numpy as np
import pandas as pd
import pytest

from tillsight.operators.quantiles import exact_quantiles, running_total_before

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("n,kind", [(1, "u"), (2, "u"), (7, "u"), (1000, "ties"), (4000, "heavy")])
def test_exact_quantiles_match_pandas(spark, n, kind):
    rng = np.random.default_rng(n)
    if kind == "u":
        v = rng.random(n) * 100
    elif kind == "ties":
        v = rng.integers(0, 5, n).astype(float)
    else:                                   # one value holds half of the rows
        v = np.where(rng.random(n) < 0.5, 3.0, rng.random(n) * 10)
    w = rng.integers(-50, 50, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], PROBS, buckets=8).first()
    for c, vals in (("x", v), ("y", w)):
        want = pd.Series(vals).quantile(PROBS).tolist()
        np.testing.assert_allclose([got[f"{c}_q{i}"] for i in range(len(PROBS))], want, rtol=0, atol=1e-12)


def test_exact_quantiles_empty_column_is_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.5]).first()
    assert got["x_q0"] is None and got["y_q0"] == 1.5


def test_running_total_before_by_group(spark):
    rng = np.random.default_rng(4)
    n = 3000
    g = rng.integers(0, 3, n)
    o = rng.permutation(n).astype(float)
    v = rng.integers(0, 10, n)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, o, v)],
                               "g int, o double, v long")
    got = running_total_before(df, "o", "v", "cum", by=["g"], buckets=16).toPandas()
    p = pd.DataFrame({"g": g, "o": o, "v": v}).sort_values(["g", "o"])
    p["cum"] = p.groupby("g")["v"].cumsum() - p["v"]
    m = got.merge(p, on=["g", "o"], suffixes=("", "_want"))
    assert len(m) == n and (m["cum"] == m["cum_want"]).all()
