"""Daily totals that grow by batches of lines.

A batch is written below ``root/lines``, by month and batch, and its days as
mergeable partial states below ``root/states``: exact sums, and sketches of the
invoices and customers. Exact totals are made anew for the months that a batch
touches, from the lines of these months alone, and replace their partitions of
``root/daily``; other months are neither read nor written. Approximate ones
come from the states without any line.

Every write replaces whole (month, batch) or month partitions, so a batch that
is written again after a failure changes nothing. Batches that touch the same
months must not be refreshed at the same time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.scalars import month_label, to_cents
from tillsight.operators.daily import daily_totals

LINE_COLS = ("InvoiceNo", "InvoiceDate", "Quantity", "TotalPrice", "CustomerID")
LG_K = 12  # sketches of 2^12 buckets: 1.6 % standard error


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has rows of. Rows are dealt out by
    partition, and large partitions are split into files of even size."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def daily_states(lines: DataFrame) -> DataFrame:
    """One mergeable row per day: units, cents, sketches of the different
    invoices and customers. Lines without a date belong to no day."""
    return (lines.select(F.to_date("InvoiceDate").alias("date"), month_label("InvoiceDate").alias("month"), *LINE_COLS).filter(F.col("date").isNotNull())
            .groupBy("month", "date")
            .agg(F.sum("Quantity").alias("units"), F.sum(to_cents("TotalPrice")).alias("cents"),
                 F.hll_sketch_agg("InvoiceNo", LG_K).alias("invoices"), F.hll_sketch_agg("CustomerID", LG_K).alias("customers")))


def add_batch(lines: DataFrame, root: str, batch: str) -> list[str]:
    """Store a batch; its months ('yyyy-MM', as many as the calendar has). The
    batch's own files are read back, so ``lines`` is computed once."""
    spark, name = lines.sparkSession, F.lit(batch).alias("batch")
    _replace(lines.filter(F.col("InvoiceDate").isNotNull()).select(*LINE_COLS, month_label("InvoiceDate").alias("month"), name), f"{root}/lines", "month", "batch")
    mine = spark.read.parquet(f"{root}/lines").filter(F.col("batch") == F.lit(batch))
    _replace(daily_states(mine.drop("month")).withColumn("batch", name), f"{root}/states", "month", "batch")
    return sorted(r[0] for r in mine.select(F.col("month").cast("string")).distinct().collect())


def refresh_daily(spark: SparkSession, root: str, months: Iterable[str]) -> None:
    """Exact daily totals of ``months``, from their lines alone."""
    months = list(months)
    if months:
        lines = spark.read.parquet(f"{root}/lines").filter(F.col("month").isin(months))
        totals = daily_totals(lines.drop("month", "batch"))
        _replace(totals.withColumn("month", month_label("date")), f"{root}/daily", "month")


def read_daily(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/daily").drop("month")


def daily_from_states(spark: SparkSession, root: str) -> DataFrame:
    """Daily totals of all batches without reading a line: sums are exact,
    the two distinct counts are estimates."""
    return (spark.read.parquet(f"{root}/states").groupBy("date")
            .agg(F.sum("units").alias("units_sold"), (F.sum("cents") / F.lit(100.0)).alias("revenue"),
                 F.hll_sketch_estimate(F.hll_union_agg("invoices")).alias("num_invoices"),
                 F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("num_customers")))
