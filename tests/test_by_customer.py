"""Lines staged by customer: equal results, no exchange of the bucketed lines."""

import datetime as dt

import numpy as np
import pytest

from tillsight.operators import customers as CU
from tillsight.operators import segments as SG
from tillsight.sources import by_customer as BC


def _lines(spark, n=3000):
    rng = np.random.default_rng(8)
    rows = [(f"i{rng.integers(0, 700)}", f"s{rng.integers(0, 40)}", "d",
             dt.datetime(2021, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 8000))), float(rng.integers(1, 9)),
             round(float(rng.random() * 40), 2), None if c == 0 else (7 if c < 40 else int(c)), "X")
            for c in rng.integers(0, 100, n)]  # customer 7 has more than a third
    return spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, InvoiceDate timestamp_ntz, "
                                       "Quantity double, TotalPrice double, CustomerID long, Country string")


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    lines = _lines(spark).cache()
    return lines, BC.write_by_customer(lines, str(tmp_path_factory.mktemp("by") / "t"), buckets=6)


def _ops(by):
    snap, cut = CU.snapshot_of(by.all()), CU.checked_cutoff(by.all())
    return {"invoices": (CU.invoice_summary, lambda df: CU.invoice_summary(CU.identified_only(df))),
            "features": (lambda df: CU.customer_features(df, snapshot=snap), CU.customer_features),
            "churn": (lambda df: CU.churn_dataset(df, cutoff=cut), CU.churn_dataset),
            "span": (CU.customer_span, lambda df: CU.customer_span(CU.identified_only(df)))}


@pytest.mark.parametrize("what", ["invoices", "features", "churn", "span"])
def test_equal_to_the_plain_tables(spark, staged, what):
    lines, by = staged
    mine, plain = _ops(by)[what]
    assert _rows(by.apply(mine)) == _rows(plain(lines))
    plan = mine(by.light)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" in plan


def test_hot_customers_are_apart(spark, staged):
    lines, by = staged
    assert {r[0] for r in by.heavy.select("CustomerID").distinct().collect()} == {7}
    assert by.light.filter("CustomerID = 7").count() == 0
    assert by.all().count() == lines.filter("CustomerID IS NOT NULL").count()


def test_segments_join_without_a_shuffle_of_lines(spark, staged, tmp_path):
    _, by = staged
    seg = spark.createDataFrame([(c, "A" if c % 2 else "B") for c in range(40, 90)], "CustomerID long, segment string")
    own = BC.write_by_customer(seg, str(tmp_path / "seg"), buckets=6)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        joined = SG.join_segments(by.light, own.light)
        assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert _rows(joined) == _rows(SG.join_segments(by.light, seg))
    finally:
        spark.conf.set(conf, before)


def test_reopened_by_its_folder_and_empty(spark, tmp_path):
    lines = _lines(spark, 200)
    for name, df in (("a", lines), ("b", lines.limit(0))):
        by = BC.write_by_customer(df, str(tmp_path / name), buckets=3)
        again = BC.read_by_customer(spark, str(tmp_path / name))
        assert _rows(again.all()) == _rows(by.all()) == _rows(df.filter("CustomerID IS NOT NULL"))
