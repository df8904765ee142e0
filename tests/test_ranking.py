"""Global rank and RFM scores against brute force / pandas qcut."""

import numpy as np
import pandas as pd
import pytest

from tillsight.operators import ranking as RK
from tillsight.operators import segments as SG


def _qcut_scores(vals, reverse=False):
    r = pd.Series(vals).rank(method="first")
    labels = [5, 4, 3, 2, 1] if reverse else [1, 2, 3, 4, 5]
    return pd.qcut(r, 5, labels=labels).astype(int).tolist()


@pytest.mark.parametrize("n", [5, 7, 11, 23, 64, 199])
def test_quintiles_equal_qcut(spark, n):
    rng = np.random.default_rng(n)
    rec = rng.integers(0, 10, n).tolist()      # heavy ties
    freq = [1] * n                              # all tied
    mon = rng.random(n).round(2).tolist()
    ids = list(range(100, 100 + n))
    df = spark.createDataFrame(list(zip(ids, rec, freq, mon)),
                               "CustomerID long, recency long, frequency long, monetary double")
    got = RK.rfm_scores(df, buckets=4, checkpoint=False).orderBy("CustomerID").toPandas()
    assert got["R_score"].tolist() == _qcut_scores(rec, reverse=True)
    assert got["F_score"].tolist() == _qcut_scores(freq)
    assert got["M_score"].tolist() == _qcut_scores(mon)
    assert (got["RFM_score"] == got["R_score"] + got["F_score"] + got["M_score"]).all()


def test_global_rank_heavy_value_is_split(spark):
    rng = np.random.default_rng(0)
    n = 3000
    v = np.where(rng.random(n) < 0.4, 1.0, rng.integers(0, 1000, n)).tolist()  # 40 % one value
    ids = rng.permutation(n).tolist()
    df = spark.createDataFrame(list(zip(ids, v)), "k long, v double")
    plan = RK.rank_edges(df, ["v"], "k", buckets=16)["v"]
    assert plan[0] == [1.0]                     # detected as heavy
    got = RK.global_rank(df, "v", "k", plan=plan).toPandas().sort_values("rank")
    want = pd.DataFrame({"k": ids, "v": v}).sort_values(["v", "k"])
    assert got["k"].tolist() == want["k"].tolist()
    assert got["rank"].tolist() == list(range(1, n + 1))


def test_label_clusters_more_than_pool(spark):
    rows = [(i, c, float(c)) for i, c in enumerate([0, 1, 2, 3, 4, 5, 6] * 3)]
    df = spark.createDataFrame(rows, "CustomerID long, cluster int, RFM_score double")
    lab = {r.cluster: r.segment for r in SG.label_clusters(df).collect()}
    assert lab == {6: "Segment 0", 5: "Segment 1", 4: "Segment 2", 3: "Segment 3",
                   2: "Segment 4", 1: "Segment 5", 0: "Segment 6"}
    five = df.filter("cluster < 5")
    lab5 = {r.cluster: r.segment for r in SG.label_clusters(five).collect()}
    assert lab5 == {4: "Champions", 3: "Loyal Customers", 2: "Big Spenders",
                    1: "Potential Loyalists", 0: "At Risk"}


def test_rank_cuts_of_many_ties(spark):
    rng = np.random.default_rng(4)
    n = 5000
    v = np.where(rng.random(n) < 0.5, 3.0, np.round(rng.normal(size=n), 1))
    ids = rng.permutation(n) * 7
    df = spark.createDataFrame([(int(i), float(x), float(i % 3)) for i, x in zip(ids, v, strict=True)], "k long, v double, w double").repartition(5)
    ranks = [1, 2, 1000, 1700, 2500, 2501, n - 1, n]
    got = RK.rank_cuts(df, ["v", "w"], "k", ranks, buckets=16)
    for c, x in (("v", v), ("w", (ids % 3).astype(float))):
        order = sorted(zip(x.tolist(), ids.tolist(), strict=True))
        assert got[c] == [order[r - 1] for r in ranks]
