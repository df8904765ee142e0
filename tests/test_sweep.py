"""All k-means runs of a sweep in the same passes, from MLlib's starts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from tillsight.ml import segments as KS
from tillsight.ml import silhouette as SI
from tillsight.ml import starts as ST


def test_batched_runs_match_mllib(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(400, 2)) + 4 * rng.integers(0, 3, size=(400, 1))]
    data = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(rows, "x double, y double")).cache()
    jobs = [(k, s) for k in (2, 3, 5) for s in (1, 2)]
    starts, want = [], []
    for k, s in jobs:
        kmeans = KMeans(k=k, seed=s, maxIter=300)
        want.append(kmeans.fit(data))
        starts.append(np.array(kmeans.setMaxIter(0).fit(data).clusterCenters()))
    for (centres, cost), model in zip(KS.lloyd(data, ["x", "y"], starts), want, strict=True):
        assert np.allclose(centres, model.clusterCenters(), atol=1e-9)
        assert np.isclose(cost, model.summary.trainingCost, rtol=1e-9)
        mine = KS.with_cluster(data, ["x", "y"], centres).select("x", "y", "cluster").collect()
        theirs = model.transform(data).select("x", "y", "prediction").collect()
        assert sorted(map(tuple, mine)) == sorted(map(tuple, theirs))
    data.unpersist()


def test_a_cluster_without_points_keeps_its_centre(spark):
    data = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    (centres, cost), = KS.lloyd(data, ["x"], [np.array([[0.4], [50.0]])])
    assert centres.tolist() == [[0.5], [50.0]] and cost == 0.5


def test_finest_level_is_found_by_halving(spark):
    df = spark.createDataFrame([(0, i / 8) for i in range(64)], "cluster int, x double")
    counts: dict[int, int] = {}
    level = SI.finest_level(df, ["x"], 40, counts)
    assert level == 2 and len(counts) <= 5


def _overlapping(spark, n, parts, seed=3):
    rng = np.random.default_rng(seed)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(n, 2)) + 2.5 * rng.integers(0, 3, size=(n, 1))]
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame(rows, "x double, y double").repartition(parts)).cache()


@pytest.mark.parametrize(("n", "parts"), [(9000, 1), (3000, 5), (40, 7), (6, 2)])
def test_starts_are_those_of_mllib(spark, n, parts):
    data = _overlapping(spark, n, parts)
    jobs = [(k, s) for k in (2, 3, 8) for s in (42, 43)]
    points, found = KS.point_blocks(data, ["x", "y"])
    for (k, s), centres in zip(jobs, ST.starts(points, found, jobs), strict=True):
        want = np.array(KMeans(k=k, seed=s, maxIter=0).fit(data).clusterCenters())
        assert centres.shape == want.shape and np.allclose(centres, want, atol=1e-9)
    points.unpersist()
    data.unpersist()


def test_uniforms_from_any_place():
    whole, stream = ST.uniforms(-7, 0, 700), ST._Doubles(-7)
    assert whole.tolist() == [stream.double() for _ in range(700)]
    assert ST.uniforms(-7, 613, 87).tolist() == whole[613:].tolist()


def test_many_iterations_in_a_pass(spark, monkeypatch):
    data = _overlapping(spark, 6000, 3)
    starts = [np.array(KMeans(k=k, seed=s, maxIter=0).fit(data).clusterCenters()) for k, s in ((3, 1), (5, 2), (8, 3))]
    iterations = [KMeans(k=k, seed=s, maxIter=300).fit(data).summary.numIter for k, s in ((3, 1), (5, 2), (8, 3))]
    whole = KS.lloyd(data, ["x", "y"], starts)
    passes, sort_out = [], KS._sorted_out
    monkeypatch.setattr(KS, "LOCAL", 600)
    monkeypatch.setattr(KS, "_sorted_out", lambda models: passes.append(max(reach for _, reach in models.values())) or sort_out(models))
    for (centres, cost), (want, least) in zip(KS.lloyd(data, ["x", "y"], starts), whole, strict=True):
        assert np.allclose(centres, want, atol=1e-9) and np.isclose(cost, least, rtol=1e-9)
    assert len(passes) < max(iterations) and 0 < max(passes) < np.inf
    short = KS.lloyd(data, ["x", "y"], starts, max_iter=4)
    monkeypatch.setattr(KS, "LOCAL", 10 ** 6)
    assert all(np.allclose(a, b, atol=1e-9) for (a, _), (b, _) in zip(short, KS.lloyd(data, ["x", "y"], starts, max_iter=4), strict=True))
    data.unpersist()


def test_equal_distances_go_to_the_first_centre():
    points = np.array([[0.0, 1.0, 2.0, 5.0]])
    table, _, hot = KS.nearest_table(points, KS._terms(points), np.array([[0.0], [2.0], [2.0]]))
    assert hot.argmax(0).tolist() == [0, 0, 1, 1] and table[:, 0].tolist() == [2, 2, 0]


def test_a_sweep_fits_no_model_by_itself(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cust = spark.createDataFrame([(i, int(r[0] * 300), int(r[1] * 20), float(r[2])) for i, r in enumerate(rng.random((300, 3)))],
                                 "CustomerID long, recency long, frequency long, monetary double")
    monkeypatch.setattr(KMeans, "fit", lambda *a, **k: pytest.fail("a series of jobs for each start"))
    rows = KS.k_sweep(cust, (2, 4), starts=3).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 4] and rows[0]["inertia"] > rows[1]["inertia"] > 0 and sum(r["best_by_silhouette"] for r in rows) == 1
