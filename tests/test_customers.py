"""Customer features, churn data set, cohorts and KPIs on edge rows."""

import datetime as dt

import pytest

from tillsight.operators import clean as C
from tillsight.operators import cohorts as CO
from tillsight.operators import customers as CU
from tillsight.operators import daily as D
from tillsight.operators import reporting as RP


def _typed(df):
    return C.add_total_price(df)


def test_customer_features_rounding_chain(tx):
    df = _typed(tx([
        ("1", "A", "a", 2, "2020-01-01 10:00", 1.005, 7, "X"),
        ("1", "B", "b", 1, "2020-01-01 10:30", 3.0, 7, "X"),
        ("2", "A", "a", 1, "2020-03-15 09:00", 10.0, 7, "X"),
        ("3", "A", "a", 1, "2020-03-20 12:00", 5.0, 0, "X"),      # placeholder customer 0
        ("4", "A", "a", 1, "2020-03-21 12:00", 5.0, None, "X"),   # guest
    ]))
    rows = {r.CustomerID: r for r in CU.customer_features(df).collect()}
    assert set(rows) == {7}
    r = rows[7]
    # snapshot = last identified line (2020-03-15 09:00) + 1 day: the later
    # lines of customer 0 and of the guest do not move it
    assert r.recency == 1
    assert r.frequency == 2
    assert r.monetary == 15.01
    assert r.avg_basket_size == 1.5
    assert r.active_months == 2.4    # 73 days / 30 = 2.43 -> 2.4
    assert r.purchase_frequency_per_month == round(2 / 2.4, 2)
    assert r.clv_simple == round(round(15.01 / 2, 2) * round(2 / 2.4, 2) * 2.4, 2)


def test_churn_dataset_cutoff_edges(tx):
    df = _typed(tx([
        ("1", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X"),
        ("2", "A", "a", 1, "2020-01-10 10:00", 1.0, 2, "X"),
        ("3", "A", "a", 1, "2020-01-11 10:00", 1.0, 2, "X"),      # exactly on the cutoff
        ("4", "A", "a", 1, "2020-01-05 10:00", 1.0, 3, "X"),
        ("5", "A", "a", 1, "2020-04-10 10:00", 1.0, 4, "X"),      # only after the cutoff
        ("6", "A", "a", 1, "2020-04-10 10:00", 1.0, 0, "X"),
    ]))
    # max = 2020-04-10 10:00, cutoff = 2020-01-11 10:00
    got = {r.CustomerID: r.churned for r in CU.churn_dataset(df).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
    ids = {r.CustomerID for r in CU.churned_customers(df).collect()}
    assert ids == {1, 3}


def test_churn_dataset_fails_without_history(tx):
    df = _typed(tx([("1", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X")]))
    with pytest.raises(Exception, match="cutoff"):
        CU.churn_dataset(df).collect()


def test_cohort_period_zero_is_100(tx):
    df = _typed(tx([
        ("1", "A", "a", 1, "2020-01-05 10:00", 1.0, 1, "X"),
        ("2", "A", "a", 1, "2020-03-05 10:00", 1.0, 1, "X"),
        ("3", "A", "a", 1, "2020-01-20 10:00", 1.0, 2, "X"),
        ("4", "A", "a", 1, "2020-02-01 10:00", 1.0, 3, "X"),
        ("5", "A", "a", 1, "2020-02-02 10:00", 1.0, None, "X"),
    ]))
    long = {(r.cohort_month, r.period_number): r.retention for r in CO.cohort_retention_long(df).collect()}
    assert long == {("2020-01", 0): 100.0, ("2020-01", 2): 50.0, ("2020-02", 0): 100.0}
    wide = {r.cohort_month: r.asDict() for r in CO.cohort_retention(df).collect()}
    assert wide["2020-02"]["2"] is None and wide["2020-01"]["2"] == 50.0


def test_cohorts_over_more_months_than_a_word(spark):
    """Random months of 40 years, against sets in Python."""
    import numpy as np

    rng = np.random.default_rng(3)
    lines = [(int(c) if c else None, dt.datetime(1980 + int(m) // 12, int(m) % 12 + 1, int(rng.integers(1, 29))))
             for c, m in zip(rng.integers(0, 60, 3000), rng.integers(0, 480, 3000))] + [(1, None)] * 3
    df = spark.createDataFrame(lines, "CustomerID long, InvoiceDate timestamp_ntz")
    own = {}
    for c, d in lines:
        if c is not None and d is not None:
            own.setdefault(c, set()).add(d.year * 12 + d.month - 1)
    want = {}
    for months in own.values():
        first = min(months)
        for m in months:
            key = (f"{first // 12}-{first % 12 + 1:02d}", m - first)
            want[key] = want.get(key, 0) + 1
    got = {(r.cohort_month, r.period_number): r.customers for r in CO.cohort_retention_long(df).collect()}
    assert got == want and max(p for _, p in got) > 400
    assert CO.cohort_retention_long(df.limit(0)).count() == 0


def test_kpis_vs_daily_orders_midnight(tx):
    df = _typed(tx([("1", "A", "a", 1, "2020-01-01 23:59", 1.0, 1, "X"),
                    ("1", "B", "b", 1, "2020-01-02 00:01", 1.0, 1, "X")]))
    k = RP.kpis(df).first()
    d = RP.kpis_from_daily(D.daily_totals(df), CU.customer_features(df)).first()
    assert k.n_orders == 1 and d.total_orders == 2 and d.days_of_data == 2
    assert k.avg_order_value == 2.0


def test_kpis_empty_is_zero_aov(tx):
    df = _typed(tx([("1", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X")])).filter("false")
    assert RP.kpis(df).first().avg_order_value == 0.0


def test_filter_transactions_inclusive(tx):
    df = _typed(tx([("1", "A", "a", 1, "2020-01-01 00:00", 1.0, 1, "X"),
                    ("2", "A", "a", 1, "2020-01-31 23:59", 1.0, 1, "Y"),
                    ("3", "A", "a", 1, "2020-02-01 00:00", 1.0, 1, "X")]))
    assert RP.filter_transactions(df, "2020-01-01", "2020-01-31").count() == 2
    assert RP.filter_transactions(df, "2020-01-01", "2020-01-31", "X").count() == 1
    assert RP.filter_transactions(df, country="All").count() == 3
