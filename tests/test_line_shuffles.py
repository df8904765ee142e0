"""Lines are shuffled as often as needed, whatever the sizes of the other tables."""
import datetime as dt

import pytest

from tillsight.operators import clean as C
from tillsight.plans import queries as Q
from tillsight.sources import fixtures as FX

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders whose keys repeat or are missing, parts under one key with
    different names, lines that appear twice."""
    root = str(tmp_path_factory.mktemp("tables"))
    day = dt.date(1997, 1, 1)
    made = {
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_returnflag string",
                     [(o, p, n, 2.0, 10.0 + (p or 0), "R" if o % 3 else "N") for o in range(1, 31) for p in (3, 4, 50, None) for n in (1, 2, 2)] + [(None, 3, 1, 1.0, 1.0, "N")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date", [(o, o % 5, day) for o in [*range(1, 31), 7, 7, 11]] + [(8, 1, dt.date(1998, 1, 1)), (None, 1, day), (9, None, day)]),
        "customer": ("c_custkey long, c_nationkey long", [(c, c % 2) for c in [*range(5), 3]] + [(None, 1)]),
        "nation": ("n_nationkey long, n_name string", [(0, "A"), (1, "B")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string",
                 [(3, "a b", "c", "t"), (3, "a", "b c", "t"), (3, "z", "c", "t"), (4, None, "c", "t"), (50, "x", "y", "u"), (None, "n", "n", "n")]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def lines_in_order(spark, root):
    """The view with the joins in the order of the foreign keys, in SQL."""
    for t in FX.SOURCE_TABLES:
        FX.table(spark, root, t).createOrReplaceTempView(f"ls_{t}")
    return spark.sql("""
        SELECT l_orderkey, l_partkey, l_linenumber, n_name, p_name, p_brand, p_type, o_orderdate, o_custkey
        FROM ls_lineitem JOIN ls_orders ON l_orderkey = o_orderkey JOIN ls_customer ON o_custkey = c_custkey
             JOIN ls_nation ON c_nationkey = n_nationkey JOIN ls_part ON l_partkey = p_partkey""")


def test_no_line_is_lost_or_made(spark, tables):
    want = lines_in_order(spark, tables)
    n = want.selectExpr("sum(if(l_partkey % 50 = 0, 2, 1)) n").first()["n"]
    assert FX.retail_raw(spark, tables).count() == n > 300


@pytest.mark.parametrize("most", ["-1", "32m"])
def test_order_key_changes_no_grouping(spark, tables, most):
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, most)
    try:
        plain = C.drop_duplicates(FX.retail_raw(spark, tables))
        keyed = C.drop_duplicates(FX.retail_raw(spark, tables, with_order=True)).drop(FX.ORDER)
        assert keyed.columns == plain.columns
        assert sorted(map(repr, keyed.collect())) == sorted(map(repr, plain.collect()))
    finally:
        spark.conf.set(THRESHOLD, before)


def test_equal_lines_meet_without_another_shuffle(spark, tables):
    """Without broadcasts: lines by part, lines by order, and nothing after."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    try:
        rows = C.clean_rows(FX.retail_raw(spark, tables, with_order=True)).drop(FX.ORDER)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" in plan
        last = plan.index("Exchange hashpartitioning(l_orderkey")
        assert plan.count("Exchange hashpartitioning(l_") == 2
        assert "Exchange" not in plan[:last]
        assert "Aggregate" in plan[:last]
    finally:
        spark.conf.set(THRESHOLD, before)


def test_customer_lines_hold_what_customer_tables_need(spark, tables):
    by = Q.sales_by_customer(spark, tables)
    assert by.all().columns == list(Q.CUSTOMER_COLS)
    assert by.all().count() == Q.sales(spark, tables).where("CustomerID is not null").count() > 0


@pytest.mark.parametrize("name", ["customer_features", "churn_dataset"])
def test_lines_of_an_invoice_are_shuffled_once(spark, tx, name):
    from tillsight.operators import customers as CU

    lines = tx([(i, s, "x", 1, f"2020-0{1 + n % 9}-01 10:00", 2.0, c, "A") for n, (i, s, c) in enumerate(
        [(i, s, c) for i in ("1", "2", None) for s in ("a", "b", None) for c in (7, 8, 0, None)] * 2)]).selectExpr("*", "Quantity * UnitPrice as TotalPrice")
    if name == "customer_features":
        before, after = CU.customer_features(lines), CU.customer_features(CU.by_invoice(lines), snapshot=CU.snapshot_of(lines))
    else:
        before, after = CU.churn_dataset(lines), CU.churn_dataset(CU.by_invoice(lines), cutoff=CU.checked_cutoff(lines))
    assert sorted(map(repr, after.collect())) == sorted(map(repr, before.collect())) != []
    plan = after._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(CustomerID#") == 2 and plan.count("Exchange hashpartitioning(") == 2
