"""Association rules and model metrics against brute force."""

import itertools

import numpy as np
import pytest

from tillsight.operators import baskets as B
from tillsight.operators import metrics as M


def _brute_rules(baskets, min_support, min_conf):
    n = len(baskets)
    items = sorted({i for b in baskets for i in b})
    supp = {}
    for k in range(1, len(items) + 1):
        for s in itertools.combinations(items, k):
            c = sum(1 for b in baskets if set(s) <= set(b))
            if c / n >= min_support:
                supp[s] = c / n
    rules = set()
    for s, sup in supp.items():
        for k in range(1, len(s)):
            for a in itertools.combinations(s, k):
                c = tuple(x for x in s if x not in a)
                conf = sup / supp[a]
                if conf >= min_conf:
                    rules.add((", ".join(a), ", ".join(c), round(sup, 12), round(conf, 12),
                               round(conf / supp[c], 12)))
    return rules


def test_rules_match_brute_force(spark):
    rng = np.random.default_rng(3)
    baskets = [sorted(set(rng.choice(list("abcdef"), rng.integers(2, 5)).tolist())) for _ in range(120)]
    baskets += [["a", "b", "c"]] * 30            # a frequent triple: 2-item consequents
    baskets = [b for b in baskets if len(b) > 1]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(baskets)], "InvoiceNo string, items array<string>")
    got = {(r.antecedents, r.consequents, round(r.support, 12), round(r.confidence, 12), round(r.lift, 12))
           for r in B.association_rules(B.frequent_itemsets(df, 0.05), 0.3).collect()}
    assert got == _brute_rules(baskets, 0.05, 0.3)
    assert any(", " in r[1] for r in got)          # multi-item consequents exist


def test_no_multi_item_basket_gives_empty_rules(spark, tx):
    df = tx([("1", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X"),
             ("2", "A", "b", 1, "2020-01-01 10:00", 1.0, 1, "X")])
    baskets = B.build_baskets(df)
    assert baskets.count() == 0
    rules = B.association_rules(B.frequent_itemsets(baskets))
    assert rules.count() == 0 and rules.columns == ["antecedents", "consequents", "support",
                                                    "confidence", "lift"]


def test_binary_metrics_vs_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)               # many ties
    p = (s >= 0.5).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(y, p, s)],
                               "label int, prediction int, score double")
    r = M.binary_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    tp = int(((y == 1) & (p == 1)).sum()); fp = int(((y == 0) & (p == 1)).sum())
    fn = int(((y == 1) & (p == 0)).sum())
    assert r.ROC_AUC == round(auc, 4)
    assert r.Accuracy == round(float((y == p).mean()), 4)
    assert r.Precision == round(tp / (tp + fp), 4) and r.Recall == round(tp / (tp + fn), 4)
    assert r.F1 == round(2 * tp / (2 * tp + fp + fn), 4)


def test_binary_metrics_one_class_is_nan(spark):
    df = spark.createDataFrame([(1, 1, 0.7), (1, 0, 0.2)], "label int, prediction int, score double")
    r = M.binary_metrics(df).first()
    assert np.isnan(r.ROC_AUC) and r.Precision == 1.0 and r.Recall == 0.5


def test_regression_metrics(spark):
    rng = np.random.default_rng(9)
    y = rng.random(50) * 100
    p = y + rng.normal(0, 5, 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "units_sold double, prediction double")
    r = M.regression_metrics(df).first()
    assert r.R2 == round(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 4)
    assert r.RMSE == round(float(np.sqrt(((y - p) ** 2).mean())), 2)
    assert r.MAE == round(float(np.abs(y - p).mean()), 2)


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    z = [r.x_z for r in M.standardize(df, ["x"]).orderBy("x").collect()]
    v = np.array([1, 2, 3, 4.0])
    np.testing.assert_allclose(z, (v - v.mean()) / v.std())
    w = {r.churned: r.weight for r in M.class_weights(
        spark.createDataFrame([(1,), (1,), (1,), (0,)], "churned int")).collect()}
    assert w == {1: 4 / 6, 0: 2.0}


def test_rules_of_a_large_itemset(spark):
    """One itemset of 21 items among its 1- and 20-item subsets: only the
    confident consequents are grown."""
    from tillsight.operators.baskets import association_rules

    names = [f"i{k:02d}" for k in range(21)]
    rows = [(names, 0.1)] + [([n], 0.5) for n in names] + [(names[:k] + names[k + 1:], 0.2 if k else 0.1) for k in range(21)]
    got = association_rules(spark.createDataFrame(rows, "items array<string>, support double"), 0.9)
    assert [(r["consequents"], r["confidence"]) for r in got.collect()] == [("i00", 1.0)]
