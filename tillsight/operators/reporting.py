"""KPIs, rankings and report figures.

Top-N queries are ``orderBy(...).limit(n)``, which Spark plans as
``TakeOrderedAndProject`` (a per-partition top-n, then a merge of n rows per
partition) - never a full sort. Ties are broken by the key so results are
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.scalars import money_sum, round_even, safe_div, strip
from tillsight.functions.scalars import with_scalars


def filter_transactions(df: DataFrame, start: str | None = None, end: str | None = None,
                        country: str | None = None) -> DataFrame:
    """Inclusive range on the date part of InvoiceDate, optional country.

    Written as bounds on the raw timestamp ([start 00:00, end+1 00:00)) so
    Parquet can push them down and skip row groups."""
    out = df
    if start:
        out = out.filter(F.col("InvoiceDate") >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        out = out.filter(F.col("InvoiceDate") < F.timestamp_add(
            "DAY", F.lit(1), F.to_timestamp_ntz(F.lit(end))))
    if country and country != "All":
        out = out.filter(F.col("Country") == country)
    return out


def products(df: DataFrame) -> DataFrame:
    """Lines with a usable product name: null and blank descriptions are
    dropped (a blank one is what a CSV round trip turns into null)."""
    return df.filter(F.col("Description").isNotNull() & (strip("Description") != ""))


def kpis(df: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row: revenue, units, distinct orders, AOV (0 without orders) of
    ``df``, and customers: those of the segment table, whatever ``df`` is
    filtered by, or without one the identified customers of ``df`` (non-null,
    non-zero ids)."""
    if segments is not None:
        n = segments.agg(F.count_distinct("CustomerID").alias("customers"))
        return with_scalars(kpis(df).drop("customers"), n)
    ident = F.when(F.col("CustomerID").isNotNull() & (F.col("CustomerID") != 0), F.col("CustomerID"))
    return (df.agg(money_sum("TotalPrice").alias("total_revenue"),
                   F.sum("Quantity").alias("total_units"),
                   F.count_distinct("InvoiceNo").alias("n_orders"),
                   F.count_distinct(ident).alias("customers"))
              .withColumn("avg_order_value", safe_div("total_revenue", "n_orders")))


def kpis_from_daily(daily: DataFrame, customers: DataFrame) -> DataFrame:
    """The API's KPI row: sums over the daily table (orders = sum of per-day
    distinct invoices), days, and identified customers of ``customers``."""
    d = daily.agg(round_even(F.sum(F.rint(F.col("revenue") * 100).cast("long")) / 100.0, 2)
                  .alias("total_revenue"),
                  F.sum("units_sold").cast("long").alias("total_units_sold"),
                  F.sum("num_invoices").cast("long").alias("total_orders"),
                  F.count(F.lit(1)).alias("days_of_data"))
    c = customers.agg(F.count_distinct("CustomerID").alias("identified_customers"))
    return with_scalars(d, c)


def quick_facts(sales: DataFrame, daily: DataFrame) -> DataFrame:
    """Days in range, distinct countries, units per day (units / max(days, 1))."""
    d = daily.agg(F.count(F.lit(1)).alias("days"))
    s = sales.agg(F.count_distinct("Country").alias("countries"),
                  F.sum("Quantity").alias("_units"))
    return (with_scalars(d, s)
             .withColumn("units_per_day", F.col("_units") / F.greatest(F.col("days"), F.lit(1)))
             .drop("_units"))


def date_bounds(daily: DataFrame) -> DataFrame:
    return daily.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def country_list(df: DataFrame) -> DataFrame:
    return df.select("Country").filter(F.col("Country").isNotNull()).distinct().orderBy("Country")


def revenue_by_country(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.groupBy("Country").agg(money_sum("TotalPrice").alias("revenue"))
              .orderBy(F.desc("revenue"), F.asc("Country")).limit(n))


def top_country(df: DataFrame) -> DataFrame:
    """The leader row shown above the ranking."""
    return revenue_by_country(df, 1)


def popular_products(df: DataFrame, n: int = 20) -> DataFrame:
    return (products(df).groupBy("Description").agg(F.sum("Quantity").alias("Quantity"))
                        .orderBy(F.desc("Quantity"), F.asc("Description")).limit(n))


def top_revenue_products(df: DataFrame, n: int = 20) -> DataFrame:
    return (products(df).groupBy("Description").agg(money_sum("TotalPrice").alias("revenue"))
                        .orderBy(F.desc("revenue"), F.asc("Description")).limit(n))


def top_customers(df: DataFrame, n: int = 15) -> DataFrame:
    """Top customers by revenue with orders, units and AOV (guests excluded)."""
    return (df.filter(F.col("CustomerID").isNotNull())
              .groupBy("CustomerID")
              .agg(money_sum("TotalPrice").alias("revenue"),
                   F.count_distinct("InvoiceNo").alias("orders"),
                   F.sum("Quantity").alias("units"))
              .orderBy(F.desc("revenue"), F.asc("CustomerID")).limit(n)
              .withColumn("avg_order_value", round_even(F.col("revenue") / F.col("orders"), 2)))


def top_share(df: DataFrame, n: int = 5) -> DataFrame:
    """Share (%) of product revenue taken by the best ``n`` products.

    The top-n is a ``TakeOrderedAndProject`` over the product aggregate; the
    total is a one-row aggregate of the same exchange."""
    per = products(df).groupBy("Description").agg(
        F.sum(F.rint(F.col("TotalPrice") * 100).cast("long")).alias("cents"))
    top = per.orderBy(F.desc("cents"), F.asc("Description")).limit(n).agg(F.sum("cents").alias("top"))
    tot = per.agg(F.sum("cents").alias("total"))
    return with_scalars(top, tot).select((F.col("top") / F.col("total") * 100.0).alias("top_share_pct"))


def sales_by_dimension(df: DataFrame, dim: str) -> DataFrame:
    return df.groupBy(dim).agg(F.sum("Quantity").alias("units_sold"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count / mean / std / min / quartiles / max per column, one row per
    column. Moments come from one aggregate; quartiles are exact
    (``exact_quantiles``, distributed over distinct values)."""
    from tillsight.operators.quantiles import exact_quantiles

    q = exact_quantiles(df, list(cols), [0.25, 0.5, 0.75], prefix="__")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = with_scalars(df.agg(*aggs), q)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                              F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                              F.col(f"{c}__min").alias("min"), F.col(f"{c}__0").alias("p25"),
                              F.col(f"{c}__1").alias("p50"), F.col(f"{c}__2").alias("p75"),
                              F.col(f"{c}__max").alias("max")) for c in cols])
    return wide.select(F.inline(rows))


def target_correlation(features: DataFrame, cols: Sequence[str], target: str = "units_sold") -> DataFrame:
    """Pearson correlation of each column with the target, one aggregate job,
    unpivoted to (feature, correlation)."""
    wide = features.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c)
                          for c in cols])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                   F.col(c).alias("correlation")) for c in cols])))


# --- segment tables -----------------------------------------------------------

def segment_sizes(seg: DataFrame) -> DataFrame:
    """Customers per segment and share of all customers (%)."""
    counts = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share_pct",
                             F.col("count") / F.sum("count").over(Window.partitionBy()) * 100.0)


def segment_summary(seg: DataFrame) -> DataFrame:
    """Per segment: distinct customers and mean R/F/M to one decimal."""
    return seg.groupBy("segment").agg(
        F.count_distinct("CustomerID").alias("customers"),
        round_even(F.avg("recency"), 1).alias("avg_recency"),
        round_even(F.avg("frequency"), 1).alias("avg_frequency"),
        round_even(F.avg("monetary"), 1).alias("avg_monetary"))


def segment_value(seg: DataFrame) -> DataFrame:
    """Per segment: customers, total spend, share of all spend (%)."""
    g = seg.groupBy("segment").agg(
        F.count_distinct("CustomerID").alias("customers"),
        F.sum(F.rint(F.col("monetary") * 100).cast("long")).alias("_c"))
    return (g.withColumn("total_monetary", F.col("_c") / 100.0)
             .withColumn("share_pct", F.col("_c") / F.sum("_c").over(Window.partitionBy()) * 100.0)
             .drop("_c"))


def customers_in_segment(seg: DataFrame, name: str) -> DataFrame:
    """Rows of one segment, name matched case-insensitively (empty if none)."""
    return seg.filter(F.lower(F.col("segment")) == name.lower())


# --- churn tables -------------------------------------------------------------

RISK_LEVELS = ("High", "Medium", "Low")


def risk_level(p: F.Column) -> F.Column:
    """(-0.01, 0.3] Low, (0.3, 0.6] Medium, (0.6, 1.0] High."""
    return (F.when((p > -0.01) & (p <= 0.3), F.lit("Low"))
             .when((p > 0.3) & (p <= 0.6), F.lit("Medium"))
             .when((p > 0.6) & (p <= 1.0), F.lit("High")))


def churn_risk_counts(pred: DataFrame) -> DataFrame:
    """Customers per risk level; a missing level reports 0."""
    spark = pred.sparkSession
    levels = spark.createDataFrame([(x,) for x in RISK_LEVELS], "risk_level string")
    counts = pred.groupBy("risk_level").agg(F.count(F.lit(1)).alias("customers"))
    return (levels.join(counts, "risk_level", "left")
                  .select("risk_level", F.coalesce("customers", F.lit(0)).cast("long").alias("customers")))


def probability_histogram(pred: DataFrame, col: str = "churn_probability", bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins on [0, 1] (1.0 falls in the last)."""
    b = F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int")
    return (pred.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
                .withColumn("lower", F.col("bin") / float(bins))
                .withColumn("upper", (F.col("bin") + 1) / float(bins)))


def potential_loss(pred: DataFrame) -> DataFrame:
    """Historical spend of High-risk customers."""
    return pred.agg(F.coalesce(F.sum(F.when(F.col("risk_level") == "High",
                                            F.rint(F.col("monetary") * 100).cast("long"))), F.lit(0))
                    .alias("_c")).select((F.col("_c") / 100.0).alias("potential_loss"))


def at_risk_customers(pred: DataFrame, level: str | None = None) -> DataFrame:
    out = pred if level in (None, "All") else pred.filter(F.col("risk_level") == level)
    return out.select("CustomerID", "recency", "frequency", "monetary", "churn_probability", "risk_level")


def report_figures(daily: DataFrame, sales: DataFrame, seg: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of headline figures: totals and date span (daily table),
    identified customers (segment table), countries, the segment with the
    largest spend and its share, the 'At Risk' segment's size and spend (0
    when absent), the number of association rules, and the five largest
    products' share of revenue. Each figure is a small aggregate; the one-row results are cross-joined."""
    d = daily.agg(F.sum(F.rint(F.col("revenue") * 100).cast("long")).alias("_rc"),
                  F.sum("units_sold").alias("total_units"),
                  F.min("date").alias("date_start"), F.max("date").alias("date_end")) \
             .select((F.col("_rc") / 100.0).alias("total_revenue"), "total_units", "date_start", "date_end")
    cents = F.rint(F.col("monetary") * 100).cast("long")
    per_seg = seg.groupBy("segment").agg(F.count_distinct("CustomerID").alias("_cust"),
                                         F.sum(cents).alias("_c"))
    top = (per_seg.orderBy(F.desc("_c"), F.asc("segment")).limit(1)
                  .select(F.col("segment").alias("top_segment"),
                          F.col("_cust").alias("top_segment_customers"), F.col("_c").alias("_top_c")))
    tot = seg.agg(F.count_distinct("CustomerID").alias("customers"), F.sum(cents).alias("_all_c"),
                  F.count(F.when(F.col("segment") == "At Risk", 1)).alias("at_risk_customers"),
                  F.coalesce(F.sum(F.when(F.col("segment") == "At Risk", cents)), F.lit(0)).alias("_risk_c"))
    countries = sales.agg(F.count_distinct("Country").alias("countries"))
    n_rules = rules.agg(F.count(F.lit(1)).alias("n_rules"))
    for one in (tot, countries, top, n_rules, top_share(sales, 5)):
        d = with_scalars(d, one)
    return (d
             .select("total_revenue", "total_units", "date_start", "date_end", "customers", "countries",
                     "top_segment", "top_segment_customers",
                     (F.col("_top_c") / F.col("_all_c") * 100.0).alias("top_segment_share_pct"),
                     "at_risk_customers", (F.col("_risk_c") / 100.0).alias("at_risk_monetary"),
                     "n_rules", "top_share_pct"))
