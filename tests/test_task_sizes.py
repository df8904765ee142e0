"""Shared tables are made once, by tasks whose size does not follow the input."""
import pytest
from conftest import SF_SMALL

from tillsight.operators import daily as D
from tillsight.plans import queries as Q
from tillsight.session import SCAN_BYTES, SHUFFLE_BYTES, SHUFFLE_ROWS, bounded_tasks

SCAN, SHUFFLE, PARTS = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"


def test_bounded_tasks_for_a_while(spark):
    before = {k: spark.conf.get(k, None) for k in (SCAN, SHUFFLE, PARTS)}
    with pytest.raises(KeyError), bounded_tasks(spark, 1000 * SHUFFLE_ROWS + 1):
        assert [int(spark.conf.get(k)) for k in (SCAN, SHUFFLE, PARTS)] == [SCAN_BYTES, SHUFFLE_BYTES, 1001]
        raise KeyError
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_smaller_sizes_of_the_session_are_kept(spark):
    before = spark.conf.get(SCAN, None)
    spark.conf.set(SCAN, "1m")
    try:
        with bounded_tasks(spark, 1):
            assert spark.conf.get(SCAN) == "1m" and spark.conf.get(PARTS) == "8"
        assert spark.conf.get(SCAN) == "1m"
    finally:
        spark.conf.unset(SCAN) if before is None else spark.conf.set(SCAN, before)


def test_shared_tables_are_made_by_bounded_tasks(spark):
    Q.unstage_sales(SF_SMALL)
    assert Q.once(spark, SF_SMALL, "probe", lambda: int(spark.conf.get(SCAN))) == SCAN_BYTES


@pytest.mark.parametrize("query", ["daily_totals", "daily_totals_by_country", "customer_features", "churn_dataset", "frequent_itemsets"])
def test_shared_tables_are_read_not_made_again(spark, query):
    plan = Q.QUERIES[query](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_daily_totals_multiply_invoices_not_lines(spark, tx):
    lines = tx([("1", "a", "x", 1, "2020-01-01 10:00", 2.0, 7, "A"), ("1", "b", "x", 2, "2020-01-01 11:00", 2.0, 8, "A"),
                ("1", "a", "x", 4, "2020-01-02 10:00", 2.0, 7, "A"), (None, "a", "x", 8, "2020-01-02 10:00", 2.0, None, "B"),
                (None, "b", "x", 16, "2020-01-02 10:00", 2.0, 7, "B"), ("2", "a", "x", 32, "2020-01-02 10:00", 2.0, None, "B")])
    lines = lines.selectExpr("*", "Quantity * UnitPrice as TotalPrice")
    totals = D.daily_totals(lines)
    got = [(str(r["date"]), r["units_sold"], r["revenue"], r["num_invoices"], r["num_customers"]) for r in totals.orderBy("date").collect()]
    assert got == [("2020-01-01", 3.0, 6.0, 1, 2), ("2020-01-02", 60.0, 120.0, 2, 1)]
    assert {(r["Country"], r["num_invoices"]) for r in D.daily_totals(lines, ["Country"]).where("date = '2020-01-02'").collect()} == {("A", 1), ("B", 1)}
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Expand", 1)[1]
