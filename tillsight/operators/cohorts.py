"""Monthly cohort retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.scalars import month_start, round_even

WORD = 62  # months a bitmap word holds, all of them below the sign bit


def customer_month_bits(df: DataFrame) -> DataFrame:
    """Each identified customer's order months as bitmaps: a row per customer
    and word of 62 months, bit i standing for month ``word * 62 + i`` (counted
    from year 0), and ``first``, the customer's first month.

    ``bit_or`` is combined before the shuffle, so a customer with a third of
    all lines is one row a task. What the window sorts is a row a customer and
    word, mostly one a customer."""
    month = F.year("InvoiceDate") * 12 + F.month("InvoiceDate") - 1
    words = (df.filter(F.col("CustomerID").isNotNull() & F.col("InvoiceDate").isNotNull())
               .select("CustomerID", month.alias("_m"))
               .groupBy("CustomerID", F.expr(f"int(_m div {WORD})").alias("word"))
               .agg(F.expr(f"bit_or(shiftleft(1L, _m % {WORD}))").alias("bits")))
    # the bits below the lowest one set are as many as its place
    lowest = F.col("word") * WORD + F.expr("bit_count((bits & -bits) - 1)")
    return words.withColumn("first", F.min(lowest).over(Window.partitionBy("CustomerID")))


def first_purchase_month(df: DataFrame) -> DataFrame:
    """Each identified customer's first month, 'yyyy-MM'."""
    return (df.filter(F.col("CustomerID").isNotNull())
              .groupBy("CustomerID")
              .agg(F.date_format(F.min(month_start("InvoiceDate")), "yyyy-MM").alias("cohort_month")))


def cohort_retention_long(df: DataFrame) -> DataFrame:
    """cohort_month x period_number -> distinct customers and % of period 0
    (rounded to 4 places as a fraction, then x100)."""
    places = F.expr(f"filter(sequence(0, {WORD - 1}), i -> getbit(bits, i) = 1)")
    months = (customer_month_bits(df)
              .select("first", "word", F.explode(places).alias("place"))
              .select("first", (F.col("word") * WORD + F.col("place") - F.col("first")).alias("period_number")))
    counts = months.groupBy("first", "period_number").agg(F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("period_number") == 0, F.col("customers"))).over(
        Window.partitionBy("first"))
    return counts.select(
        F.date_format(F.make_date(F.expr("int(first div 12)"), F.col("first") % 12 + 1, F.lit(1)), "yyyy-MM").alias("cohort_month"),
        F.col("period_number").cast("int").alias("period_number"),
        F.col("customers").cast("long").alias("customers"),
        (round_even(F.col("customers") / size, 4) * 100.0).alias("retention"))


def cohort_retention(df: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Wide table: one row per cohort, one column per period ("0", "1", ...);
    a cohort with no customer in a period has null there. ``periods`` saves
    the job that looks for them; one that it leaves out fails the query."""
    long = cohort_retention_long(df)
    if periods is not None:
        p = F.col("period_number")
        long = long.withColumn("period_number", F.when(p.isin(*periods), p).otherwise(
            F.raise_error(F.concat(F.lit("period not listed: "), p.cast("string"))).cast("int")))
    g = long.groupBy("cohort_month")
    p = g.pivot("period_number", list(periods)) if periods is not None else g.pivot("period_number")
    return p.agg(F.first("retention"))
