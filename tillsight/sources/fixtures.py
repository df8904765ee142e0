"""The ``retail_raw`` view: a dirty transaction log derived from the
TPC-H-like test tables.

Each kind of dirt the cleaning rules look for is injected by a fixed rule on
keys (see FIXTURES.md). The view is a plain DataFrame plan over the parquet
tables, so every query that starts here scales with ``lineitem``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.scalars import strip  # noqa: F401  (re-export for callers)

# fixed values: the dirt-injection rules of the fixture (FIXTURES.md §2)
CANCEL_ORDER_MOD = 10        # returned lines of these orders are cancellations
NULL_DESC_MOD = 53           # (order + part) divisible -> null description
NEG_QTY_ORDER_MOD = 97       # negative quantity
ZERO_PRICE_ORDER_MOD = 89    # zero unit price
GUEST_ORDER_MOD = 20         # null CustomerID
DUP_PART_MOD = 50            # lines of these parts appear twice
SECONDS_MULT, SECONDS_MOD, SECONDS_BASE, SECONDS_PER_LINE = 7919, 43200, 28800, 60


# The tables that the view reads.
SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "part")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


#: The column that ``with_order`` adds.
ORDER = "_order"


def retail_raw(spark: SparkSession, sf_dir: str, with_item_type: bool = True, with_order: bool = False) -> DataFrame:
    """Raw transaction lines (the reference's input schema) from the test tables.

    Lines meet their parts first and then the orders, which have met their
    customers by themselves: at any size the lines are shuffled twice at most
    (once where ``part`` is under the broadcast threshold), and lie by order
    afterwards. ``with_order`` adds the order key as ``ORDER``. InvoiceNo
    determines it, so it changes no grouping by all columns, but tells Spark
    that equal rows are together already. The duplicate lines are produced with an ``explode`` of a one- or two-element
    array instead of a second scan + union, so ``lineitem`` is read once.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")

    bought = (od.join(cu, od.o_custkey == cu.c_custkey)
                .join(F.broadcast(na), cu.c_nationkey == na.n_nationkey)
                .select("o_orderkey", "o_custkey", "o_orderdate", "n_name"))
    j = li.join(pa, li.l_partkey == pa.p_partkey).join(bought, li.l_orderkey == bought.o_orderkey)

    ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    name_brand = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))
    seconds = (ok * SECONDS_MULT) % SECONDS_MOD + SECONDS_BASE + ln * SECONDS_PER_LINE
    cols = [
        F.concat(F.when((F.col("l_returnflag") == "R") & (ok % CANCEL_ORDER_MOD == 0), F.lit("C"))
                  .otherwise(F.lit("")), ok.cast("string")).alias("InvoiceNo"),
        pk.cast("string").alias("StockCode"),
        F.when((ok + pk) % NULL_DESC_MOD == 0, F.lit(None).cast("string"))
         .when(ln == 1, F.concat(F.lit("  "), name_brand, F.lit(" ")))
         .otherwise(name_brand).alias("Description"),
        F.when(ok % NEG_QTY_ORDER_MOD == 0, -F.col("l_quantity"))
         .otherwise(F.col("l_quantity")).alias("Quantity"),
        F.timestamp_add("SECOND", seconds.cast("int"),
                       F.col("o_orderdate").cast("timestamp_ntz")).alias("InvoiceDate"),
        F.when(ok % ZERO_PRICE_ORDER_MOD == 0, F.lit(0.0))
         .otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
        F.when(ok % GUEST_ORDER_MOD == 0, F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
    ]
    if with_item_type:
        cols.append(F.col("p_type").alias("ItemType"))
    if with_order:
        cols.append(ok.alias(ORDER))
    copies = F.explode(F.when(pk % DUP_PART_MOD == 0, F.array(F.lit(1), F.lit(2)))
                        .otherwise(F.array(F.lit(1))))
    return j.select(*cols, copies.alias("_copy")).drop("_copy")
