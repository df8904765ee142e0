"""Boosted trees against a plain version, linear folds against lstsq."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tillsight.ml import attribution as AT
from tillsight.ml import boosting as BO
from tillsight.ml import forecast as FC
from tillsight.ml import linear as LN
from tillsight.operators.daily import walk_forward_splits
from tillsight.operators.metrics import regression_metrics
from tillsight.schema import FORECAST_FEATURES

SF = "/root/testdata/sf0.001"


def vectors(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "date long, x array<double>, y double").select("date", array_to_vector("x").alias("features"), "x", "y")


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 4)), 1)  # ties in every column
    x[:, 3] = 1.0  # and a constant one
    y = 4 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 2] + rng.normal(0, 0.2, 400)
    return vectors(spark, x, y).cache()


def plain_trees(x, y, cuts, mark, unit, rounds, depth, leaves, step, rows, cols, penalty, least, seed):
    """Every split of every leaf tried by itself, on the raw values."""
    now, out = np.full(len(y), y.mean()), []
    for tree in range(rounds):
        g = np.rint((y - now) / unit)
        seen = BO.drawn_rows(mark, tree, seed, rows)
        use = BO.drawn_columns(x.shape[1], tree, seed, cols)
        score = lambda i: g[i].sum() ** 2 / (len(i) + penalty)

        def best(own, depth_left):
            top = (0.0, None, None)
            for c in use if depth_left else ():
                for cut in cuts[c]:
                    a, b = own[x[own, c] <= cut], own[x[own, c] > cut]
                    if min(len(a), len(b)) >= max(least, 1):
                        gain = score(a) + score(b) - score(own)
                        if gain > top[0] * (1 + 1e-12) + 1e-6:
                            top = (gain, c, cut)
            return top
        open_, done, place = [(np.flatnonzero(seen), np.arange(len(y)), depth)], [], 0
        full = leaves >= 1 << depth
        todo = [(*best(open_[0][0], depth), *open_[0])]
        while todo and (full or len(todo) + len(done) < leaves):
            todo.sort(key=lambda t: -t[0])
            gain, c, cut, own, every, left = todo.pop(0)
            if not gain:
                done.append((own, every))
                continue
            for side in (lambda i: x[i, c] <= cut, lambda i: x[i, c] > cut):  # noqa: B023
                a, e = own[side(own)], every[side(every)]
                todo.append((*best(a, left - 1), a, e, left - 1))
            place += 1
        for own, every in done + [(t[3], t[4]) for t in todo]:
            now[every] += step * unit * g[own].sum() / (len(own) + penalty)
        out.append(place)
    return now, out


@pytest.mark.parametrize("kind", [{"rows": 0.8, "cols": 0.8, "penalty": 1.0, "least": 1}, {"leaves": 6, "rows": 1.0, "cols": 1.0, "penalty": 0.0, "least": 20}])
def test_boosted_trees_equal_a_plain_version(toy, kind):
    model = BO.fit_boosted(toy, "y", rounds=12, depth=3, step=0.3, seed=5, **kind)
    pdf = model.transform(toy.withColumn("mark", F.xxhash64("x", "y"))).orderBy("date").toPandas()
    x, y = np.stack(pdf["x"]), pdf["y"].to_numpy()
    want, splits = plain_trees(x, y, BO.cut_points(toy, 4)[0], pdf["mark"].to_numpy().astype(np.int64).view(np.uint64), (y.max() - y.min()) / 2.0**BO.UNIT, 12, 3,
                               kind.get("leaves", 8), 0.3, kind["rows"], kind["cols"], kind["penalty"], kind["least"], 5)
    np.testing.assert_allclose(pdf["prediction"], want, atol=1e-6)
    assert [int((t["left"] >= 0).sum()) for t in model.trees] == splits


def test_boosted_trees_do_not_depend_on_tasks(toy):
    one, three = (BO.fit_boosted(toy, "y", rounds=2, depth=2, tasks=k) for k in (1, 3))
    assert one.rows == three.rows


def test_boosted_trees_are_kept_and_add_up(spark, toy, tmp_path):
    model = FC.forecast_boosted_no_sampling(toy, "y", rounds=5)
    again = FC.load_model(FC.save_model(model, str(tmp_path / "m")))
    assert isinstance(again, BO.BoostedTrees) and again.rows == model.rows
    df = toy.select("date", "features", *(F.col("x")[i].alias(c) for i, c in enumerate("abcd")))
    attr = AT.shap_tree(again, df, cols=list("abcd")).orderBy("date").toPandas()
    np.testing.assert_allclose(attr["prediction"], model.transform(df).orderBy("date").toPandas()["prediction"], atol=1e-9)


def test_boosting_without_splits(spark):
    df = vectors(spark, np.ones((5, 2)), [1.0, 2, 3, 4, 5])
    assert {r["prediction"] for r in BO.fit_boosted(df, "y", rounds=3, rows=1.0).transform(df).collect()} == {3.0}


def series(spark, n=260, per_day=1):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n * per_day, len(FORECAST_FEATURES))) * 10.0 ** rng.integers(-1, 5, len(FORECAST_FEATURES)) + 2000
    x[:, 4] = 2010  # constant
    x[:, 5] = x[:, 6] + x[:, 7]  # dependent
    y = x[:, 0] * 0.5 + x[:, 1] + rng.normal(size=len(x))
    rows = [(i // per_day, f"k{i % per_day}", *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    schema = "d int, key string, " + ", ".join(f"{c} double" for c in FORECAST_FEATURES) + ", units_sold double"
    return spark.createDataFrame(rows, schema).withColumn("date", F.expr("date_add(date'2020-01-01', d)"))


@pytest.mark.parametrize(("days", "per_day"), [(260, 1), (130, 3), (93, 1), (60, 1)])
def test_linear_folds_equal_lstsq(spark, days, per_day):
    table = series(spark, days, per_day)
    keys = ("key",) if per_day > 1 else ()
    got = sorted(map(tuple, FC.walk_forward_cv(table, FC.forecast_linear, keys=keys).collect()), key=lambda r: r[3])
    folds = walk_forward_splits(table, keys=keys).toPandas()
    want = []
    for k, f in folds.groupby("fold"):
        tr, te = (f[f["role"] == r] for r in ("train", "test"))
        x, y = tr[list(FORECAST_FEATURES)].to_numpy(), tr["units_sold"].to_numpy()
        beta = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-10)[0]
        te = te.assign(prediction=y.mean() + (te[list(FORECAST_FEATURES)].to_numpy() - x.mean(axis=0)) @ beta)
        m = regression_metrics(spark.createDataFrame(te[["units_sold", "prediction"]].assign(fold=k)), by=["fold"]).first()
        want.append((m["R2"], m["RMSE"], m["MAE"], k, tr["date"].nunique(), te["date"].nunique()))
    assert [r[3:] for r in got] == [r[3:] for r in want]
    np.testing.assert_allclose(np.array([r[:3] for r in got], dtype=float), np.array([r[:3] for r in want], dtype=float), atol=0.02)


def test_linear_fit_is_kept(toy, tmp_path):
    model = LN.fit_linear(toy, "y")
    x, y = np.array(toy.select("x").toPandas()["x"].tolist()), toy.select("y").toPandas()["y"].to_numpy()
    beta = np.linalg.lstsq(np.c_[np.ones(len(x)), x[:, :3]], y, rcond=None)[0]
    np.testing.assert_allclose([model.intercept, *model.coefficients.toArray()], [*beta, 0.0], atol=1e-9)
    again = FC.load_model(FC.save_model(model, str(tmp_path / "m")))
    assert again.rows == model.rows
    pred = again.transform(toy).orderBy("date").toPandas()["prediction"]
    np.testing.assert_allclose(pred, np.c_[np.ones(len(x)), x[:, :3]] @ beta, atol=1e-9)
