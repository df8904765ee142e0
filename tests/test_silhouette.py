"""Euclidean silhouette from grid cells against brute force."""

import numpy as np
import pytest

from tillsight.ml import silhouette as SI

COLS = ["x", "y", "z"]


def _brute(points, own):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    out = []
    for i in range(len(own)):
        size = (own == own[i]).sum()
        a = d[i, own == own[i]].sum() / max(size - 1, 1)
        b = min(d[i, own == c].mean() for c in set(own.tolist()) - {own[i]})
        out.append((b - a) / max(a, b) if size > 1 and max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def _clusters(n, seed=3):
    rng = np.random.default_rng(seed)
    own = rng.choice([0, 0, 0, 4, 7], n)         # a hot cluster, gaps in the ids
    points = rng.normal(0, [1, 0.2, 2], (n, 3)) + np.array([[own_i, -own_i, 0.3] for own_i in own])
    points[::10] = points[0]                    # copies
    points[1] = [60, -40, 55]                   # far away
    return points, own


def _frame(spark, points, own):
    return spark.createDataFrame([(*map(float, p), int(c)) for p, c in zip(points, own)],
                                 "x double, y double, z double, cluster int")


def test_equals_brute_force(spark):
    points, own = _clusters(900)
    own[5] = 9                                  # alone in its cluster
    value, error = SI.silhouette(_frame(spark, points, own), COLS)
    assert error < 1e-6 and value == pytest.approx(_brute(points, own), abs=1e-6)


def test_coarse_grid_holds_the_value_and_is_refined(spark, monkeypatch):
    points, own = _clusters(1500, seed=8)
    df, exact = _frame(spark, points, own).cache(), _brute(points, own)
    widths = []
    for level in (0, 2, 4):
        low, high = SI.silhouette_interval(df, COLS, level, 0.01)
        assert low <= exact <= high
        widths.append(high - low)
    assert widths[0] > widths[1] > widths[2]
    monkeypatch.setattr(SI, "FIRST_CELLS", 100)
    value, error = SI.silhouette(df, COLS)
    assert error <= SI.TOLERANCE and abs(value - exact) <= error
    monkeypatch.setattr(SI, "MOST_CELLS", 100)  # no finer grid allowed: the width says so
    value, error = SI.silhouette(df, COLS)
    assert error > SI.TOLERANCE and abs(value - exact) <= error


def test_far_nodes_stay_closed():
    import pandas as pd
    rng = np.random.default_rng(1)
    points = rng.normal(0, 1, (4000, 2))
    key = np.floor(points * 64).astype(int)
    table = (pd.DataFrame({"_c": 0, "_k0": key[:, 0], "_k1": key[:, 1], "_n": 1, "_s0": points[:, 0] - key[:, 0] / 64,
                           "_s1": points[:, 1] - key[:, 1] / 64}))
    table["_q"] = table["_s0"] ** 2 + table["_s1"] ** 2
    table = table.groupby(["_c", "_k0", "_k1"], as_index=False).sum()
    tree = SI.build_tree(table, 2, 1 / 64)
    c, n, _, _ = SI.open_nodes(tree, np.array([5.0, 5.0]), 0.1, 1e-2)
    assert n.sum() == 4000 and len(c) < len(table) / 4


@pytest.mark.parametrize("rows", [[], [(0.0, 0.0, 0.0, 1)], [(0.0, 0.0, 0.0, 1), (1.0, 0.0, 0.0, 1)]])
def test_fewer_than_two_clusters(spark, rows):
    value, error = SI.silhouette(spark.createDataFrame(rows, "x double, y double, z double, cluster int"), COLS)
    assert np.isnan(value) and np.isnan(error)


def test_equal_points_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0)] * 3 + [(1.0, 1.0, 1.0, 1)] * 3 + [(None, 1.0, 1.0, 1)],
                               "x double, y double, z double, cluster int")
    assert SI.silhouette(df, COLS) == (0.0, 0.0)


def test_clusterings_in_one_walk_hold_brute_force(spark, monkeypatch):
    points, own = _clusters(1500, seed=8)
    rng = np.random.default_rng(2)
    other, one = (points[:, 0] > 2).astype(int) * 3 - 1, np.zeros(len(own), int)
    other[7] = 5                                # alone in its cluster
    labels = np.column_stack([own, other, one, rng.integers(0, 3, len(own))])
    df = spark.createDataFrame([(*map(float, p), *map(int, c)) for p, c in zip(points, labels)],
                               "x double, y double, z double, a int, b int, c int, d int").cache()
    exact = [_brute(points, labels[:, j]) if j != 2 else None for j in range(4)]
    walks = []
    interval = SI.class_intervals
    monkeypatch.setattr(SI, "class_intervals", lambda *a: walks.append(a[2]) or interval(*a))
    monkeypatch.setattr(SI, "FIRST_CELLS", 60)  # more rows than that: together
    found = SI.silhouettes(df, COLS, ["a", "b", "c", "d"])
    assert len(walks) > 1 and walks == sorted(walks)
    assert np.isnan(found[2]).all()
    assert all(error <= SI.TOLERANCE and abs(value - want) <= error + 1e-12 for (value, error), want in zip(found, exact) if want is not None)
    monkeypatch.setattr(SI, "MOST_CELLS", 60)   # no finer grid allowed: the widths say so
    rough = SI.silhouettes(df, COLS, ["a", "b", "d"])
    assert max(e for _, e in rough) > SI.TOLERANCE
    assert all(abs(value - want) <= error + 1e-12 for (value, error), want in zip(rough, [x for x in exact if x is not None]))
    df.unpersist()


def test_nodes_by_polynomial_covariance_and_variance_hold_the_sums():
    import pandas as pd
    rng = np.random.default_rng(4)
    points, own = rng.normal(0, [1, 0.4, 2], (20000, 3)), rng.integers(0, 5, 20000)
    key, side = np.floor(points * 8).astype(int), 1 / 8
    off = points - key * side
    table = pd.DataFrame({"_c": own, "_n": 1} | {f"_k{i}": key[:, i] for i in range(3)} | {f"_s{i}": off[:, i] for i in range(3)}
                         | {f"_p{i}{j}": off[:, i] * off[:, j] for i in range(3) for j in range(i, 3)})
    table = table.groupby(["_c", "_k0", "_k1", "_k2"], as_index=False).sum()
    member = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1], [0, 1, 0, 1]], float)
    tree = SI.build_moments(table, 3, side, np.full(5, 8000.0))
    for place in ([0, 0, 0], [2, 0.5, -3], [9, 9, 9]):
        some = place + rng.normal(0, 0.05, (50, 3))
        kinds = SI.opened(tree, some.mean(0), 0.2, 1e-3)
        assert sum(k["n"].sum() for k in kinds) == 20000 and len(kinds[0]["c"]) < len(table) / 2
        exact = np.array([np.bincount(own, np.sqrt(((points - x) ** 2).sum(1)), 5) for x in some]) @ member
        low, high = SI.class_sums(tree, some, member, 1e-3)
        assert (low <= exact + 1e-6).all() and (exact <= high + 1e-6).all() and ((high - low) / exact).max() < 0.01
