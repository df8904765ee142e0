"""Customer-level tables: invoice summary, RFM + CLV features, churn data set.

Both customer tables are two hash aggregates (invoice, then customer). The
second one shuffles partial aggregates, so a customer holding a third of all
invoices costs one buffer row per map task, never a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.scalars import round_even, to_cents, whole_days
from tillsight.schema import HOLDOUT_DAYS
from tillsight.functions.scalars import with_scalars


def identified_only(df: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Rows with a CustomerID; ``drop_zero`` also drops the placeholder 0."""
    cond = F.col("CustomerID").isNotNull()
    if drop_zero:
        cond = cond & (F.col("CustomerID") != 0)
    return df.filter(cond)


def by_invoice(df: DataFrame) -> DataFrame:
    """The identified lines, those of a customer's invoice together. A distinct
    count of its stock codes then needs no shuffle by code and another by
    invoice: the lines move once, with the columns that are used later."""
    return identified_only(df).repartition("CustomerID", "InvoiceNo")


def invoice_summary(df: DataFrame) -> DataFrame:
    """Per (customer, invoice): first line time, last line time, value in
    exact cents, distinct stock codes."""
    return (df.groupBy("CustomerID", "InvoiceNo")
              .agg(F.min("InvoiceDate").alias("invoice_date"),
                   F.max("InvoiceDate").alias("last_line"),
                   F.sum(to_cents("TotalPrice")).alias("value_cents"),
                   F.count_distinct("StockCode").alias("basket_size")))


def _per_customer(inv: DataFrame, *more: F.Column) -> DataFrame:
    """Customer aggregates from the invoice summary. A null InvoiceNo group
    counts for the span only (grouping drops it in the reference)."""
    has_inv = F.col("InvoiceNo").isNotNull()
    return (inv.groupBy("CustomerID")
               .agg(F.max(F.when(has_inv, F.col("invoice_date"))).alias("last_invoice"),
                    F.min("invoice_date").alias("first_line"),
                    F.max("last_line").alias("last_line"),
                    F.count("InvoiceNo").alias("frequency"),
                    F.sum(F.when(has_inv, F.col("value_cents"))).alias("value_cents"),
                    F.avg(F.when(has_inv, F.col("basket_size"))).alias("avg_basket"), *more))


def customer_span(df: DataFrame) -> DataFrame:
    """Whole days between a customer's first and last line."""
    return (df.groupBy("CustomerID")
              .agg(whole_days(F.min("InvoiceDate"), F.max("InvoiceDate")).alias("span_days")))


def snapshot_of(df: DataFrame, drop_zero: bool = True) -> DataFrame:
    """One row: a day after the last line of the identified rows."""
    return (identified_only(df, drop_zero=drop_zero)
            .agg(F.timestamp_add("DAY", F.lit(1), F.max("InvoiceDate")).alias("_snap")))


def customer_features(df: DataFrame, snapshot=None, drop_zero: bool = True) -> DataFrame:
    """Recency, frequency, monetary, basket size and simple CLV per
    identified customer.

    snapshot: a timestamp literal/string, or the one-row frame of
    ``snapshot_of``; default that of ``df``, joined by broadcast.
    Rounding chain: monetary 2 dp; active_months = max(span/30, 1) to 1 dp;
    orders per month = frequency / rounded months, 2 dp; CLV = AOV(2 dp) x
    orders per month x months, 2 dp."""
    ident = identified_only(df, drop_zero=drop_zero)
    cust = _per_customer(invoice_summary(ident))
    if snapshot is None or isinstance(snapshot, DataFrame):
        cust = with_scalars(cust, snapshot_of(df, drop_zero) if snapshot is None else snapshot)
    else:
        cust = cust.withColumn("_snap", F.lit(snapshot).cast("timestamp_ntz"))
    monetary = round_even(F.col("value_cents") / 100.0, 2)
    months = round_even(F.greatest(whole_days("first_line", "last_line") / 30.0, F.lit(1.0)), 1)
    return (cust.select(
        "CustomerID",
        whole_days("last_invoice", "_snap").alias("recency"),
        F.col("frequency").cast("long").alias("frequency"),
        monetary.alias("monetary"),
        round_even("avg_basket", 1).alias("avg_basket_size"),
        months.alias("active_months"))
        .withColumn("purchase_frequency_per_month",
                    round_even(F.col("frequency") / F.col("active_months"), 2))
        .withColumn("clv_simple", round_even(
            round_even(F.col("monetary") / F.col("frequency"), 2)
            * F.col("purchase_frequency_per_month") * F.col("active_months"), 2)))


def _guard(holds: F.Column, msg: str) -> F.Column:
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(msg)).cast("boolean"))


def churn_cutoff(df: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """One row: cutoff = max(InvoiceDate) - holdout days (identified rows)."""
    return (identified_only(df)
            .agg(F.timestamp_add("DAY", F.lit(-holdout_days), F.max("InvoiceDate")).alias("cutoff")))


def checked_cutoff(df: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """``churn_cutoff`` that fails, when run, if nobody bought before it."""
    cut = (identified_only(df)
           .agg(F.timestamp_add("DAY", F.lit(-holdout_days), F.max("InvoiceDate")).alias("cutoff"),
                F.min("InvoiceDate").alias("_first")))
    return cut.filter(_guard(F.col("_first") < F.col("cutoff"), "no customer has transactions before "
                             "the churn cutoff; reduce holdout_days")).drop("_first")


def churn_dataset(df: DataFrame, holdout_days: int = HOLDOUT_DAYS, cutoff: DataFrame | None = None) -> DataFrame:
    """Customer features strictly before the cutoff, label from on/after it.

    churned = 1 when the customer has no line in the holdout window. Customer
    0 is kept. Fails (lazily, when run) if nobody bought before the cutoff.
    Two scans: the dates for the cutoff, then one grouping whose conditional
    aggregates give features and label together. ``cutoff`` (one row) replaces
    the cutoff of ``df`` where that holds a part of the customers only."""
    ident = identified_only(df)
    cut = checked_cutoff(df, holdout_days) if cutoff is None else cutoff
    early = F.col("InvoiceDate") < F.col("cutoff")
    inv = (with_scalars(ident, cut).groupBy("CustomerID", "InvoiceNo")
           .agg(F.min(F.when(early, F.col("InvoiceDate"))).alias("invoice_date"),
                F.max(F.when(early, F.col("InvoiceDate"))).alias("last_line"),
                F.sum(F.when(early, to_cents("TotalPrice"))).alias("value_cents"),
                F.count_distinct(F.when(early, F.col("StockCode"))).alias("basket_size"),
                F.max(F.when(F.col("InvoiceDate") >= F.col("cutoff"), 1).otherwise(0)).alias("_back")))
    # an invoice of the holdout window counts for the label only
    inv = inv.withColumn("InvoiceNo", F.when(F.col("invoice_date").isNotNull(), F.col("InvoiceNo")))
    cust = with_scalars(_per_customer(inv, F.max("_back").alias("_back")).filter(F.col("first_line").isNotNull()), cut)
    months = F.greatest(whole_days("first_line", "last_line") / 30.0, F.lit(1.0))
    return cust.select(
        "CustomerID",
        whole_days("last_invoice", "cutoff").alias("recency"),
        F.col("frequency").cast("long").alias("frequency"),
        round_even(F.col("value_cents") / 100.0, 2).alias("monetary"),
        round_even("avg_basket", 1).alias("avg_basket_size"),
        round_even(F.col("frequency") / months, 2).alias("purchase_frequency_per_month"),
        (1 - F.col("_back")).cast("int").alias("churned"))


def churned_customers(df: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """Customers seen before the cutoff and not after it (``left_anti``)."""
    ident = identified_only(df)
    lines = with_scalars(ident, churn_cutoff(df, holdout_days))
    before = lines.filter(F.col("InvoiceDate") < F.col("cutoff")).select("CustomerID").distinct()
    after = lines.filter(F.col("InvoiceDate") >= F.col("cutoff")).select("CustomerID")
    return before.join(after, "CustomerID", "left_anti")
