"""MLlib fits, attribution additivity, exact Shapley check, streaming."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tillsight.ml import attribution as AT
from tillsight.ml import forecast as FC


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(11)
    n = 300
    x = rng.random((n, 3))
    y = 10 * (x[:, 0] > 0.5) + 5 * x[:, 1] * (x[:, 2] > 0.3) + rng.normal(0, 0.1, n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "date long, a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_shap_adds_up_to_prediction(toy, kind):
    if kind == "forest":
        m = RandomForestRegressor(labelCol="y", numTrees=8, maxDepth=4, seed=1).fit(toy)
    else:
        m = GBTRegressor(labelCol="y", maxIter=6, maxDepth=3, seed=1).fit(toy)
    attr = AT.shap_tree(m, toy, cols=["a", "b", "c"]).toPandas().sort_values("date")
    pred = m.transform(toy).select("date", "prediction").toPandas().sort_values("date")
    np.testing.assert_allclose(attr["prediction"].to_numpy(), pred["prediction"].to_numpy(), atol=1e-8)
    imp = AT.shap_importance(AT.shap_tree(m, toy, cols=["a", "b", "c"]), cols=["a", "b", "c"]).collect()
    assert imp[0].feature == "a"


def _cond_expectation(t, x, S, j=0):
    if t["left"][j] < 0:
        return t["value"][j]
    f = t["feature"][j]
    l, r = t["left"][j], t["right"][j]
    if f in S:
        return _cond_expectation(t, x, S, l if x[f] <= t["threshold"][j] else r)
    return (t["cover"][l] * _cond_expectation(t, x, S, l)
            + t["cover"][r] * _cond_expectation(t, x, S, r)) / t["cover"][j]


def test_tree_shap_equals_exact_shapley(spark, toy):
    m = DecisionTreeRegressor(labelCol="y", maxDepth=3).fit(toy)
    trees, _, _ = AT.tree_tables(m, spark)
    t = trees[0]
    M = 3
    for x in np.random.default_rng(2).random((5, 3)):
        phi = np.zeros(M)
        for leaf in AT.leaf_paths(t):
            AT.add_leaf(leaf, x[None], phi[None], 1.0)
        exact = np.zeros(M)
        for i in range(M):
            others = [k for k in range(M) if k != i]
            for size in range(M):
                for S in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(M - size - 1) / math.factorial(M)
                    exact[i] += w * (_cond_expectation(t, x, set(S) | {i}) - _cond_expectation(t, x, set(S)))
        np.testing.assert_allclose(phi, exact, atol=1e-9)


def test_attributions_of_a_panel_keep_their_rows_apart(toy):
    m = GBTRegressor(featuresCol="features", labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(toy)
    panel = toy.withColumn("Country", F.lit("A")).unionByName(toy.withColumns({"Country": F.lit("B"), "a": F.col("a") + 1}))
    cols, keys = ["a", "b", "c"], ["Country", "date"]
    attr = AT.shap_tree(m, panel, cols=cols, key=keys)
    alone = {r["date"]: r for r in AT.shap_tree(m, toy, cols=cols).collect()}
    got = attr.where("Country = 'A'").collect()
    assert attr.count() == 2 * len(got) == 2 * len(alone)
    assert all(abs(r[c] - alone[r["date"]][c]) < 1e-12 for r in got for c in cols)
    one = AT.explain_one_row(attr, cols, keys, at=("A", got[0]["date"])).collect()
    assert {r["feature"]: r["shap"] for r in one} == {c: got[0][c] for c in cols}
    assert {r["Country"] for r in AT.explain_one_row(attr, cols, keys).collect()} == {"A"}


def test_linear_fit_and_shap(spark, toy):
    m = FC.forecast_linear(toy, "y")
    X = np.array(toy.select("a", "b", "c").toPandas())
    y = np.array(toy.select("y").toPandas())[:, 0]
    coef, *_ = np.linalg.lstsq(np.c_[np.ones(len(X)), X], y, rcond=None)
    np.testing.assert_allclose([m.intercept, *m.coefficients.toArray()], coef, rtol=1e-6, atol=1e-8)
    attr = AT.shap_linear(m, toy, toy, cols=["a", "b", "c"]).toPandas().sort_values("date")
    pred = m.transform(toy).select("date", "prediction").toPandas().sort_values("date")
    np.testing.assert_allclose(attr["prediction"].to_numpy(), pred["prediction"].to_numpy(), atol=1e-8)


def test_stream_watermark_drops_late_rows(spark, tmp_path):
    from tillsight.streaming import events as ST

    d = tmp_path / "events"
    rows1 = [(1, "2024-01-01 10:00:00", 1, "view", 1.0, "{}"), (2, "2024-01-03 10:00:00", 2, "view", 2.0, "{}")]
    rows2 = [(3, "2024-01-01 11:00:00", 3, "view", 4.0, "{}"),   # late: before watermark
             (4, "2024-01-05 10:00:00", 1, "view", 8.0, "{}")]
    sch = "event_id long, ts string, user_id long, event_type string, value double, props string"
    base = str(tmp_path / "run")
    out = None
    for i, rows in enumerate([rows1, rows2]):
        spark.createDataFrame(rows, sch).withColumn("ts", F.to_timestamp_ntz("ts")) \
             .coalesce(1).write.mode("append").parquet(str(d))
        ev = ST.read_events(spark, str(d))
        out = ST.run_available(ST.stream_daily_totals(ev, "1 day"), "t", base=base)
    got = {str(r.date): (r.events, r.users) for r in spark.read.parquet(out).collect()}
    # day 1 keeps only the on-time event: the late one arrives after the
    # watermark passed 2024-01-02 10:00 and is dropped
    assert got["2024-01-01"] == (1, 1)
    assert "2024-01-05" not in got          # its window is still open


def test_kmeans_restarts_in_parallel_match_sequential(spark, monkeypatch):
    from tillsight.ml import parallel as PA
    from tillsight.ml import segments as KS
    from tillsight.operators import ranking as RK
    from tillsight.plans import queries as Q

    scored = RK.rfm_scores(Q.customers(spark, "/root/testdata/sf0.001"))
    got = {}
    for par in (1, 4):
        monkeypatch.setattr(PA, "FIT_PARALLELISM", par)
        seg, model = KS.kmeans_segments(scored, k=3, starts=4, max_iter=20)
        got[par] = (sorted(map(tuple, seg.select("CustomerID", "segment").collect())),
                    model.summary.trainingCost)
    assert got[1] == got[4]
