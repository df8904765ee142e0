"""Cleaning a raw transaction log.

The rule order is fixed and matters, because the winsorizing bounds are taken
after every filter: dedupe -> missing description -> cancelled -> quantity ->
price -> types -> winsorize -> total price.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.scalars import round_even, strip
from tillsight.operators.quantiles import exact_quantiles
from tillsight.functions.scalars import with_scalars

# Rule names in the order they are applied (fixed values).
RULES = ("duplicate", "missing_description", "cancelled", "invalid_quantity",
         "invalid_price")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates over all columns (null equals null).

    A hash aggregate on every column: map-side partial aggregation collapses
    repeated copies before the shuffle, so a row repeated a billion times
    costs one buffer entry per task, not a hot reducer."""
    return df.dropDuplicates()


def drop_missing_description(df: DataFrame) -> DataFrame:
    """Drop rows with a null Description, then strip outer whitespace."""
    return (df.filter(F.col("Description").isNotNull())
              .withColumn("Description", strip("Description")))


def drop_cancelled(df: DataFrame) -> DataFrame:
    """Drop invoices whose number starts with 'C' (case-sensitive).

    A null InvoiceNo is kept (the reference turns it into the text "nan")."""
    inv = F.col("InvoiceNo").cast("string")
    return df.withColumn("InvoiceNo", inv).filter(inv.isNull() | ~inv.startswith("C"))


def drop_invalid_quantity(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Quantity") > 0)


def drop_invalid_price(df: DataFrame) -> DataFrame:
    return df.filter(F.col("UnitPrice") > 0)


# Date forms besides ISO (month first when both parts could be a month).
DATE_FORMS = ("M/d/yyyy[ H:mm[:ss]]", "M/d/yy[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]", "d MMM yyyy[ H:mm[:ss]]")


def parse_dates(text: F.Column, strict: bool = True) -> F.Column:
    """Text to timestamp_ntz: ISO 8601 (blank or ``T``, with or without time
    and fraction) or one of ``DATE_FORMS``. Null and blank text give null;
    other text fails the job, or gives null if not ``strict``."""
    bare = strip(text)
    parsed = F.coalesce(bare.try_cast("timestamp_ntz"),
                        *[F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMS])
    if not strict:
        return parsed
    return (F.when(parsed.isNotNull() | text.isNull() | (bare == ""), parsed)
             .otherwise(F.raise_error(F.concat(F.lit("InvoiceDate is no date: "), text)).cast("timestamp_ntz")))


def convert_types(df: DataFrame, strict_dates: bool = True) -> DataFrame:
    """InvoiceDate -> timestamp_ntz (``parse_dates``), CustomerID -> long
    (unparsable -> null), StockCode -> string. Already-typed columns pass
    through unchanged."""
    types = dict(df.dtypes)
    out = df
    if types.get("InvoiceDate") == "string":
        out = out.withColumn("InvoiceDate", parse_dates(F.col("InvoiceDate"), strict_dates))
    elif types.get("InvoiceDate") != "timestamp_ntz":
        out = out.withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    if types.get("CustomerID") != "bigint":
        # '12345.0' (a float-typed export) must parse too, like a numeric coerce.
        out = out.withColumn("CustomerID", F.coalesce(
            F.expr("try_cast(CustomerID AS BIGINT)"),
            F.expr("try_cast(try_cast(CustomerID AS DOUBLE) AS BIGINT)")))
    return out.withColumn("StockCode", F.col("StockCode").cast("string"))


def quantile_bounds(df: DataFrame, cols: Sequence[str], lo: float = 0.01,
                    hi: float = 0.99, exact: bool = True) -> DataFrame:
    """One-row frame with ``{col}_lo`` / ``{col}_hi`` quantile bounds.

    exact=True: linear-interpolation quantiles (equal to pandas and DuckDB
    ``quantile_cont``) computed by ``exact_quantiles`` as a distributed plan
    over distinct values - no task ever holds all distinct values.
    exact=False: ``percentile_approx`` (one pass, bounded sketch, rank error
    below 1/10000)."""
    if exact:
        q = exact_quantiles(df, list(cols), [lo, hi], prefix="__")
        return q.select(*[x for col in cols for x in (F.col(f"{col}__0").alias(f"{col}_lo"),
                                                     F.col(f"{col}__1").alias(f"{col}_hi"))])
    aggs = [F.percentile_approx(F.col(col), F.array(F.lit(lo), F.lit(hi)), 10000).alias(f"_{col}_q")
            for col in cols]
    b = df.agg(*aggs)
    return b.select(*[x for col in cols for x in (
        F.col(f"_{col}_q")[0].cast("double").alias(f"{col}_lo"),
        F.col(f"_{col}_q")[1].cast("double").alias(f"{col}_hi"))])


def winsorize(df: DataFrame, cols: Sequence[str] = ("Quantity", "UnitPrice"),
              lo: float = 0.01, hi: float = 0.99, exact: bool = True) -> DataFrame:
    """Clip each column to its [lo, hi] quantiles (cap, don't drop).

    The bounds are a one-row aggregate joined to every row; a one-row side is
    a proven-size broadcast (BroadcastNestedLoopJoin with no condition)."""
    return clip_to_bounds(df, quantile_bounds(df, cols, lo, hi, exact), cols)


def clip_to_bounds(df: DataFrame, bounds: DataFrame,
                   cols: Sequence[str] = ("Quantity", "UnitPrice")) -> DataFrame:
    """Clip each column to ``{col}_lo`` / ``{col}_hi`` of the one-row
    ``bounds`` frame (``quantile_bounds``); a projection, fused into the
    scan's codegen stage."""
    out = with_scalars(df, bounds)
    for col in cols:
        out = out.withColumn(col, F.least(F.greatest(F.col(col), F.col(f"{col}_lo")),
                                          F.col(f"{col}_hi")))
    return out.drop(*[f"{col}_{s}" for col in cols for s in ("lo", "hi")])


def add_total_price(df: DataFrame) -> DataFrame:
    """TotalPrice = Quantity * UnitPrice rounded half-even to cents."""
    return df.withColumn("TotalPrice", round_even(F.col("Quantity") * F.col("UnitPrice"), 2))


def clean_sales(df: DataFrame, exact_quantiles: bool = True) -> DataFrame:
    """The whole cleaning chain. The reference sorts the result by date only
    to write the file in order; a global sort is a range shuffle with no
    effect on any later result, so it is left to the writer
    (``sortWithinPartitions`` in ``write_stage``)."""
    return (df.transform(clean_rows)
              .transform(lambda d: winsorize(d, exact=exact_quantiles))
              .transform(add_total_price))


def clean_rows(df: DataFrame) -> DataFrame:
    """The row-level part of the chain (every filter and the type
    conversion), before the table-level winsorizing."""
    return (df.transform(drop_duplicates)
              .transform(drop_missing_description)
              .transform(drop_cancelled)
              .transform(drop_invalid_quantity)
              .transform(drop_invalid_price)
              .transform(convert_types))


def finish_sales(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``clean_rows`` output + its ``quantile_bounds`` -> the cleaned table
    (``clean_sales`` split in two, so the rows can be written once and the
    bounds taken from the written table)."""
    return add_total_price(clip_to_bounds(rows, bounds))


def _first_failed_rule() -> F.Column:
    inv = F.col("InvoiceNo").cast("string")
    return (F.when(F.col("Description").isNull(), F.lit("missing_description"))
             .when(inv.isNotNull() & inv.startswith("C"), F.lit("cancelled"))
             .when(~(F.col("Quantity") > 0) | F.col("Quantity").isNull(), F.lit("invalid_quantity"))
             .when(~(F.col("UnitPrice") > 0) | F.col("UnitPrice").isNull(), F.lit("invalid_price"))
             .otherwise(F.lit("kept")))


def cleaning_audit(df: DataFrame) -> DataFrame:
    """Rows removed by each rule, in one pass over the data.

    Duplicate copies are counted from the dedupe aggregate itself
    (``count - 1`` per distinct row); every distinct row is then labelled with
    the first rule it fails. Result: (rule, rows)."""
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    labelled = distinct.select(_first_failed_rule().alias("rule"), F.col("_n"))
    per_rule = labelled.groupBy("rule").agg(F.count(F.lit(1)).cast("long").alias("rows"))
    dups = labelled.agg((F.sum("_n") - F.count(F.lit(1))).cast("long").alias("rows")) \
                   .select(F.lit("duplicate").alias("rule"), "rows")
    return dups.unionByName(per_rule)


def cap_audit(df: DataFrame, cols: Sequence[str] = ("Quantity", "UnitPrice"),
              lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """For filtered, typed rows: bounds, max before and after capping, and how
    many values each bound changed. One row per column."""
    bounds = quantile_bounds(df, cols, lo, hi)
    j = with_scalars(df, bounds)
    aggs = []
    for col in cols:
        v, l, h = F.col(col), F.col(f"{col}_lo"), F.col(f"{col}_hi")
        aggs += [F.first(l).alias(f"{col}__lower"), F.first(h).alias(f"{col}__upper"),
                 F.max(v).alias(f"{col}__max_before"),
                 F.max(F.least(F.greatest(v, l), h)).alias(f"{col}__max_after"),
                 F.count(F.when(v < l, 1)).cast("long").alias(f"{col}__capped_low"),
                 F.count(F.when(v > h, 1)).cast("long").alias(f"{col}__capped_high")]
    wide = j.agg(*aggs)
    fields = ("lower", "upper", "max_before", "max_after", "capped_low", "capped_high")
    rows = F.array(*[F.struct(F.lit(col).alias("column"),
                              *[F.col(f"{col}__{f}").alias(f) for f in fields]) for col in cols])
    return wide.select(F.inline(rows))
