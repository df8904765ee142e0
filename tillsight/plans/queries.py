"""Named queries: one per operator of the inventory.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` that starts from the
test tables, and (where SQL can express it) has an independent DuckDB query in
``ORACLE`` with the same output column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.operators import baskets as B
from tillsight.operators import clean as C
from tillsight.operators import cohorts as CO
from tillsight.operators import customers as CU
from tillsight.operators import daily as D
from tillsight.operators import ranking as RK
from tillsight.operators import refresh as RF
from tillsight.operators import reporting as RP
from tillsight.operators import segments as SG
from tillsight.plans.oracle import CENTS, MONEY_SUM, R, sql, with_stages
from tillsight.schema import FORECAST_FEATURES
from tillsight.session import bounded_tasks, materialize
from tillsight.sources import by_customer as BC
from tillsight.sources import files as FS
from tillsight.sources.fixtures import ORDER, SOURCE_TABLES, retail_raw, table, table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared stage builders (lazy plans; nothing is computed here)
# ---------------------------------------------------------------------------

def raw(spark, sf):
    return retail_raw(spark, sf)


def filtered(spark, sf):
    """Dedupe + the four row filters, before typing and capping."""
    return (raw(spark, sf).transform(C.drop_duplicates)
            .transform(C.drop_missing_description).transform(C.drop_cancelled)
            .transform(C.drop_invalid_quantity).transform(C.drop_invalid_price))


WINSOR_COLS = ("Quantity", "UnitPrice")

# What a session has derived from a set of source tables, for its later queries.
_DERIVED: dict[tuple, object] = {}


def once(spark, sf, what: str, make: Callable):
    """``make()``, kept for the session and for as long as the source tables
    stay the same files (path, bytes, modification time). Its jobs have tasks
    whose size does not follow the tables'."""
    key = (spark.sparkContext.applicationId, sf, what,
           FS.source_stamp(spark, [table_path(sf, t) for t in SOURCE_TABLES]))
    if key not in _DERIVED:
        with bounded_tasks(spark, table(spark, sf, "lineitem").count()):
            _DERIVED[key] = make()
    return _DERIVED[key]


def stage_sales(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Clean the transactions once and hand them over as a Parquet table in
    the shared folder; every ``sales(spark, sf)`` reads it.

    What is written is the filtered, typed rows (sorted inside each file by
    date), so the expensive part - scan, joins, the all-column dedupe
    shuffle - runs once. The winsorizing bounds are then computed from the
    written table (a two-column scan) and written as a one-row table beside
    it; the clip and the total price are a projection applied on read."""
    def make():
        path = FS.fresh_path(spark, "sales_clean")
        rows = C.clean_rows(retail_raw(spark, sf, with_order=True)).drop(ORDER)
        FS.write_stage(rows, f"{path}/rows", sort_by=["InvoiceDate"])
        rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        bounds = C.quantile_bounds(rows, WINSOR_COLS)
        FS.write_stage(bounds, f"{path}/bounds")
        return path, rows, spark.read.schema(bounds.schema).parquet(f"{path}/bounds")

    path, rows, bounds = once(spark, sf, "sales", make)
    if not FS.path_exists(spark, f"{path}/bounds/_SUCCESS"):  # the shared folder was emptied
        unstage_sales(sf)
        path, rows, bounds = once(spark, sf, "sales", make)
    return rows, bounds


def unstage_sales(sf) -> None:
    """Forget what was derived from the folder's tables."""
    for key in [k for k in _DERIVED if k[1] == sf]:
        del _DERIVED[key]


def sales(spark, sf):
    """Cleaned transactions, from the written stage: no job once it exists,
    and filters and column selections reach its scan."""
    return C.finish_sales(*stage_sales(spark, sf))


def staged(spark, sf, what: str, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``op`` of the cleaned lines, written once a session: each query that
    starts from it reads the small table, not the lines again."""
    lines = sales(spark, sf)  # first: an emptied folder forgets all tables
    return once(spark, sf, what, lambda: materialize(op(lines)))


def daily(spark, sf):
    return staged(spark, sf, "daily", D.daily_totals)


def daily_by_country(spark, sf):
    return staged(spark, sf, "daily by country", lambda lines: D.daily_totals(lines, keys=("Country",)))


def features(spark, sf):
    return D.daily_features(daily(spark, sf))


def customers(spark, sf):
    return staged(spark, sf, "customers", lambda lines: CU.customer_features(
        CU.by_invoice(lines), snapshot=CU.snapshot_of(lines)))


def scored(spark, sf):
    return RK.rfm_scores(customers(spark, sf), checkpoint=False)  # the customers are written already


def segmented(spark, sf):
    """Customers with RFM scores and rule clusters (cluster = R_score - 1)."""
    return SG.segment_customers(scored(spark, sf))


def churn(spark, sf):
    return staged(spark, sf, "churn", lambda lines: CU.churn_dataset(
        CU.by_invoice(lines), cutoff=CU.checked_cutoff(lines)))


def heuristic_scores(spark, sf):
    """A fit-free churn scorer used as fixed model output for the metric and
    risk operators: p = recency / (recency + 90), predicted churn p >= 0.5."""
    ch = churn(spark, sf)
    p = R4(F.col("recency") / (F.col("recency") + F.lit(90.0)))
    return (ch.withColumn("churn_probability", p)
              .withColumn("prediction", (F.col("churn_probability") >= 0.5).cast("int"))
              .withColumn("risk_level", RP.risk_level(F.col("churn_probability"))))


def R4(x):
    from tillsight.functions.scalars import round_even
    return round_even(x, 4)


HEURISTIC_SQL = f"""
scores AS (
  SELECT *, {R('recency / (recency + 90.0)', 4)} AS churn_probability FROM churn
),
scores2 AS (
  SELECT *, CAST(churn_probability >= 0.5 AS INTEGER) AS prediction,
         CASE WHEN churn_probability > -0.01 AND churn_probability <= 0.3 THEN 'Low'
              WHEN churn_probability > 0.3 AND churn_probability <= 0.6 THEN 'Medium'
              WHEN churn_probability > 0.6 AND churn_probability <= 1.0 THEN 'High' END AS risk_level
  FROM scores
)"""


# ---------------------------------------------------------------------------
# 2.1 / 2.2 scan and cleaning
# ---------------------------------------------------------------------------

@register("retail_raw", with_stages("raw", "SELECT * FROM retail_raw"))
def q_retail_raw(spark, sf):
    return raw(spark, sf)


@register("drop_duplicates", with_stages("dedup", "SELECT * FROM dedup"))
def q_drop_duplicates(spark, sf):
    return raw(spark, sf).transform(C.drop_duplicates)


@register("drop_missing_description", with_stages("nodesc", "SELECT * FROM nodesc"))
def q_drop_missing_description(spark, sf):
    return raw(spark, sf).transform(C.drop_duplicates).transform(C.drop_missing_description)


@register("drop_cancelled", with_stages("nocancel", "SELECT * FROM nocancel"))
def q_drop_cancelled(spark, sf):
    return (raw(spark, sf).transform(C.drop_duplicates)
            .transform(C.drop_missing_description).transform(C.drop_cancelled))


@register("drop_invalid_quantity", with_stages("qtyok", "SELECT * FROM qtyok"))
def q_drop_invalid_quantity(spark, sf):
    return (raw(spark, sf).transform(C.drop_duplicates)
            .transform(C.drop_missing_description).transform(C.drop_cancelled)
            .transform(C.drop_invalid_quantity))


@register("drop_invalid_price", with_stages("priceok", "SELECT * FROM priceok"))
def q_drop_invalid_price(spark, sf):
    return filtered(spark, sf)


@register("convert_types", with_stages("priceok", "SELECT * FROM priceok"))
def q_convert_types(spark, sf):
    """Text columns as exports hold them: four date forms, ids as decimals."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "M/d/yyyy H:mm:ss", "dd-MMM-yyyy HH:mm:ss")
    texts = filtered(spark, sf).withColumns({
        "InvoiceDate": F.array(*[F.date_format("InvoiceDate", f) for f in forms])[F.length("StockCode") % 4],
        "CustomerID": F.concat(F.col("CustomerID").cast("string"), F.lit(".0"))})
    return texts.transform(C.convert_types)


@register("winsorize", with_stages("clean", "SELECT * EXCLUDE (TotalPrice) FROM clean"))
def q_winsorize(spark, sf):
    return filtered(spark, sf).transform(C.convert_types).transform(C.winsorize)


@register("clean_sales", with_stages("clean", "SELECT * FROM clean"))
def q_clean_sales(spark, sf):
    return sales(spark, sf)


@register("add_total_price", with_stages(
    "clean", "SELECT InvoiceNo, StockCode, Quantity, UnitPrice, TotalPrice FROM clean"))
def q_add_total_price(spark, sf):
    return sales(spark, sf).select("InvoiceNo", "StockCode", "Quantity", "UnitPrice", "TotalPrice")


# ---------------------------------------------------------------------------
# 2.3 aggregations
# ---------------------------------------------------------------------------

@register("daily_totals", with_stages("daily", "SELECT * FROM daily"))
def q_daily_totals(spark, sf):
    return daily(spark, sf)


@register("daily_totals_incremental", with_stages("daily", "SELECT * FROM daily"))
def q_daily_totals_incremental(spark, sf):
    """The same totals from three batches of lines: the newest year's lines, the
    older ones, and late lines of all months, which split their invoices' days."""
    def make():
        root, lines = FS.fresh_path(spark, "daily_batches"), sales(spark, sf)
        late, new = F.pmod(F.hash("InvoiceNo", "StockCode"), F.lit(10)) == 0, F.year("InvoiceDate") >= 2001
        for name, rows in (("old", ~late & ~new), ("new", ~late & new), ("late", late)):
            RF.refresh_daily(spark, root, RF.add_batch(lines.filter(rows), root, name))
        return root
    return RF.read_daily(spark, once(spark, sf, "daily_batches", make))


@register("identified_only", sql("SELECT * FROM clean WHERE CustomerID IS NOT NULL", "clean"))
def q_identified_only(spark, sf):
    return CU.identified_only(sales(spark, sf))


@register("cleaning_audit", sql("""
SELECT 'duplicate' AS rule, CAST((SELECT count(*) FROM retail_raw) - (SELECT count(*) FROM dedup) AS BIGINT) AS rows
UNION ALL SELECT 'missing_description', (SELECT count(*) FROM dedup) - (SELECT count(*) FROM nodesc)
UNION ALL SELECT 'cancelled', (SELECT count(*) FROM nodesc) - (SELECT count(*) FROM nocancel)
UNION ALL SELECT 'invalid_quantity', (SELECT count(*) FROM nocancel) - (SELECT count(*) FROM qtyok)
UNION ALL SELECT 'invalid_price', (SELECT count(*) FROM qtyok) - (SELECT count(*) FROM priceok)
UNION ALL SELECT 'kept', (SELECT count(*) FROM priceok)""", "priceok"))
def q_cleaning_audit(spark, sf):
    return C.cleaning_audit(raw(spark, sf))


@register("cap_audit", sql("""
SELECT 'Quantity' AS "column", q_lo AS lower, q_hi AS upper, max(Quantity) AS max_before,
       max(least(greatest(Quantity, q_lo), q_hi)) AS max_after,
       count(*) FILTER (WHERE Quantity < q_lo) AS capped_low,
       count(*) FILTER (WHERE Quantity > q_hi) AS capped_high
FROM priceok CROSS JOIN bounds GROUP BY q_lo, q_hi
UNION ALL
SELECT 'UnitPrice', p_lo, p_hi, max(UnitPrice), max(least(greatest(UnitPrice, p_lo), p_hi)),
       count(*) FILTER (WHERE UnitPrice < p_lo), count(*) FILTER (WHERE UnitPrice > p_hi)
FROM priceok CROSS JOIN bounds GROUP BY p_lo, p_hi""", "bounds"))
def q_cap_audit(spark, sf):
    return C.cap_audit(filtered(spark, sf).transform(C.convert_types))


@register("filter_transactions", sql("""
SELECT * FROM clean WHERE CAST(InvoiceDate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
  AND Country = 'NATION_7'""", "clean"))
def q_filter_transactions(spark, sf):
    return RP.filter_transactions(sales(spark, sf), "1997-01-01", "1998-12-31", "NATION_7")


@register("daily_sales_range", sql("""
SELECT * FROM daily WHERE date >= DATE '1996-03-01' AND date <= DATE '1999-06-30'""", "daily"))
def q_daily_sales_range(spark, sf):
    return D.daily_sales_range(daily(spark, sf), "1996-03-01", "1999-06-30")


@register("invoice_summary", sql(f"""
SELECT CustomerID, InvoiceNo, min(InvoiceDate) AS invoice_date,
       {MONEY_SUM('TotalPrice')} AS invoice_value, count(DISTINCT StockCode) AS basket_size
FROM clean WHERE CustomerID IS NOT NULL GROUP BY CustomerID, InvoiceNo""", "clean"))
def q_invoice_summary(spark, sf):
    inv = CU.invoice_summary(CU.identified_only(sales(spark, sf)))
    return inv.select("CustomerID", "InvoiceNo", "invoice_date",
                      (F.col("value_cents") / 100.0).alias("invoice_value"), "basket_size")


@register("customer_span", sql("""
SELECT CustomerID, date_sub('day', min(InvoiceDate), max(InvoiceDate)) AS span_days
FROM clean WHERE CustomerID IS NOT NULL GROUP BY CustomerID""", "clean"))
def q_customer_span(spark, sf):
    return CU.customer_span(CU.identified_only(sales(spark, sf)))


@register("customer_features", sql("SELECT * FROM customer_features", "customers"))
def q_customer_features(spark, sf):
    return customers(spark, sf)


# What the customer tables are computed from.
CUSTOMER_COLS = ("CustomerID", "InvoiceNo", "InvoiceDate", "StockCode", "TotalPrice")


def sales_by_customer(spark, sf) -> BC.ByCustomer:
    """The cleaned lines, staged by customer once a session: every line, with
    the columns that customer tables need."""
    return once(spark, sf, "by_customer", lambda: BC.write_by_customer(
        sales(spark, sf).select(*CUSTOMER_COLS), FS.fresh_path(spark, "by_customer")))


@register("invoice_summary_by_customer", ORACLE["invoice_summary"])
def q_invoice_summary_by_customer(spark, sf):
    inv = sales_by_customer(spark, sf).apply(CU.invoice_summary)
    return inv.select("CustomerID", "InvoiceNo", "invoice_date",
                      (F.col("value_cents") / 100.0).alias("invoice_value"), "basket_size")


@register("customer_features_by_customer", ORACLE["customer_features"])
def q_customer_features_by_customer(spark, sf):
    lines = sales_by_customer(spark, sf)
    snap = CU.snapshot_of(lines.all())
    return lines.apply(lambda df: CU.customer_features(df, snapshot=snap))


@register("churn_dataset_by_customer", sql("SELECT * FROM churn", "churn"))
def q_churn_dataset_by_customer(spark, sf):
    lines = sales_by_customer(spark, sf)
    cut = CU.checked_cutoff(lines.all())
    return lines.apply(lambda df: CU.churn_dataset(df, cutoff=cut))


@register("cohort_retention_long", sql("SELECT * FROM cohort_long", "cohorts"))
def q_cohort_retention_long(spark, sf):
    return CO.cohort_retention_long(sales(spark, sf))


# The months that the fixture's order dates span, from a cohort's first on.
PERIODS = range(84)


@register("cohort_retention", sql("SELECT cohort_month, " + ", ".join(
    f'max(CASE WHEN period_number = {p} THEN retention END) AS "{p}"' for p in PERIODS)
    + " FROM cohort_long GROUP BY cohort_month", "cohorts"))
def q_cohort_retention(spark, sf):
    return CO.cohort_retention(sales(spark, sf), PERIODS)


@register("first_purchase_month", sql("""
SELECT CustomerID, strftime(min(CAST(date_trunc('month', InvoiceDate) AS DATE)), '%Y-%m') AS cohort_month
FROM clean WHERE CustomerID IS NOT NULL GROUP BY CustomerID""", "clean"))
def q_first_purchase_month(spark, sf):
    return CO.first_purchase_month(sales(spark, sf))


@register("kpis", sql(f"""
SELECT {MONEY_SUM('TotalPrice')} AS total_revenue, sum(Quantity) AS total_units,
       count(DISTINCT InvoiceNo) AS n_orders,
       count(DISTINCT CASE WHEN CustomerID <> 0 THEN CustomerID END) AS customers,
       coalesce({MONEY_SUM('TotalPrice')} / nullif(count(DISTINCT InvoiceNo), 0), 0.0) AS avg_order_value
FROM clean""", "clean"))
def q_kpis(spark, sf):
    return RP.kpis(sales(spark, sf))


@register("kpis_filtered", sql(f"""
SELECT {MONEY_SUM('TotalPrice')} AS total_revenue, sum(Quantity) AS total_units,
       count(DISTINCT InvoiceNo) AS n_orders, (SELECT count(DISTINCT CustomerID) FROM segments) AS customers,
       coalesce({MONEY_SUM('TotalPrice')} / nullif(count(DISTINCT InvoiceNo), 0), 0.0) AS avg_order_value
FROM clean WHERE CAST(InvoiceDate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
  AND Country = 'NATION_7'""", "segments"))
def q_kpis_filtered(spark, sf):
    """The filtered lines' figures beside the segment table's customers."""
    lines = RP.filter_transactions(sales(spark, sf), "1997-01-01", "1998-12-31", "NATION_7")
    return RP.kpis(lines, segmented(spark, sf))


@register("kpis_from_daily", sql(f"""
SELECT {R('CAST(sum(CAST(round_even(revenue * 100.0, 0) AS BIGINT)) AS DOUBLE) / 100.0', 2)} AS total_revenue,
       CAST(sum(units_sold) AS BIGINT) AS total_units_sold,
       CAST(sum(num_invoices) AS BIGINT) AS total_orders, count(*) AS days_of_data,
       (SELECT count(DISTINCT CustomerID) FROM customer_features) AS identified_customers
FROM daily""", "daily", "customers"))
def q_kpis_from_daily(spark, sf):
    return RP.kpis_from_daily(daily(spark, sf), customers(spark, sf))


@register("quick_facts", sql("""
SELECT (SELECT count(*) FROM daily) AS days, count(DISTINCT Country) AS countries,
       sum(Quantity) / greatest((SELECT count(*) FROM daily), 1) AS units_per_day
FROM clean""", "daily"))
def q_quick_facts(spark, sf):
    return RP.quick_facts(sales(spark, sf), daily(spark, sf))


@register("date_bounds", sql("SELECT min(date) AS min_date, max(date) AS max_date FROM daily", "daily"))
def q_date_bounds(spark, sf):
    return RP.date_bounds(daily(spark, sf))


@register("country_list", sql(
    "SELECT DISTINCT Country FROM clean WHERE Country IS NOT NULL ORDER BY Country", "clean"))
def q_country_list(spark, sf):
    return RP.country_list(sales(spark, sf))


@register("revenue_by_country", sql(f"""
SELECT Country, {MONEY_SUM('TotalPrice')} AS revenue FROM clean GROUP BY Country
ORDER BY revenue DESC, Country LIMIT 10""", "clean"))
def q_revenue_by_country(spark, sf):
    return RP.revenue_by_country(sales(spark, sf), 10)


@register("top_country", sql(f"""
SELECT Country, {MONEY_SUM('TotalPrice')} AS revenue FROM clean GROUP BY Country
ORDER BY revenue DESC, Country LIMIT 1""", "clean"))
def q_top_country(spark, sf):
    return RP.top_country(sales(spark, sf))


@register("monthly_revenue", sql(f"""
SELECT strftime(date, '%Y-%m') AS year_month,
       CAST(sum(CAST(round_even(revenue * 100.0, 0) AS BIGINT)) AS DOUBLE) / 100.0 AS revenue
FROM features GROUP BY 1""", "features"))
def q_monthly_revenue(spark, sf):
    return D.monthly_revenue(features(spark, sf))


@register("weekday_seasonality", sql("""
SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, avg(units_sold) AS avg_units_sold
FROM daily GROUP BY 1""", "daily"))
def q_weekday_seasonality(spark, sf):
    return D.weekday_seasonality(daily(spark, sf))


@register("sales_by_dimension", sql(
    "SELECT ItemType, sum(Quantity) AS units_sold FROM clean GROUP BY ItemType", "clean"))
def q_sales_by_dimension(spark, sf):
    return RP.sales_by_dimension(sales(spark, sf), "ItemType")


@register("describe", sql("""
SELECT 'Quantity' AS "column", count(Quantity) AS count, avg(Quantity) AS mean,
       stddev_samp(Quantity) AS std, min(Quantity) AS min,
       quantile_cont(Quantity, 0.25) AS p25, quantile_cont(Quantity, 0.5) AS p50,
       quantile_cont(Quantity, 0.75) AS p75, max(Quantity) AS max FROM clean
UNION ALL
SELECT 'UnitPrice', count(UnitPrice), avg(UnitPrice), stddev_samp(UnitPrice), min(UnitPrice),
       quantile_cont(UnitPrice, 0.25), quantile_cont(UnitPrice, 0.5),
       quantile_cont(UnitPrice, 0.75), max(UnitPrice) FROM clean
UNION ALL
SELECT 'TotalPrice', count(TotalPrice), avg(TotalPrice), stddev_samp(TotalPrice), min(TotalPrice),
       quantile_cont(TotalPrice, 0.25), quantile_cont(TotalPrice, 0.5),
       quantile_cont(TotalPrice, 0.75), max(TotalPrice) FROM clean""", "clean"))
def q_describe(spark, sf):
    return RP.describe(sales(spark, sf), ["Quantity", "UnitPrice", "TotalPrice"])


@register("target_correlation", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), units_sold) AS correlation FROM features"
    for c in FORECAST_FEATURES) + ")", "features"))
def q_target_correlation(spark, sf):
    return RP.target_correlation(features(spark, sf), list(FORECAST_FEATURES))


@register("popular_products", sql("""
SELECT Description, sum(Quantity) AS Quantity FROM prod GROUP BY Description
ORDER BY Quantity DESC, Description LIMIT 20""", "products"))
def q_popular_products(spark, sf):
    return RP.popular_products(sales(spark, sf), 20)


@register("top_revenue_products", sql(f"""
SELECT Description, {MONEY_SUM('TotalPrice')} AS revenue FROM prod GROUP BY Description
ORDER BY revenue DESC, Description LIMIT 20""", "products"))
def q_top_revenue_products(spark, sf):
    return RP.top_revenue_products(sales(spark, sf), 20)


@register("top_n_products_set", sql("""
SELECT Description FROM prod GROUP BY Description
ORDER BY sum(Quantity) DESC, Description LIMIT 200""", "products"))
def q_top_n_products_set(spark, sf):
    return B.top_items(sales(spark, sf), "Description", 200)


@register("top_customers", sql(f"""
SELECT *, {R('revenue / orders', 2)} AS avg_order_value FROM (
  SELECT CustomerID, {MONEY_SUM('TotalPrice')} AS revenue, count(DISTINCT InvoiceNo) AS orders,
         sum(Quantity) AS units
  FROM clean WHERE CustomerID IS NOT NULL GROUP BY CustomerID
  ORDER BY revenue DESC, CustomerID LIMIT 15)""", "clean"))
def q_top_customers(spark, sf):
    return RP.top_customers(sales(spark, sf), 15)


@register("top5_product_share", sql(f"""
SELECT (SELECT sum(c) FROM (SELECT c FROM pc ORDER BY c DESC, Description LIMIT 5))
       / (SELECT sum(c) FROM pc) * 100.0 AS top_share_pct""", "products",
    extra=f"pc AS (SELECT Description, sum({CENTS('TotalPrice')}) AS c FROM prod GROUP BY Description)"))
def q_top5_product_share(spark, sf):
    return RP.top_share(sales(spark, sf), 5)


@register("rfm_scores", sql("SELECT * FROM rfm", "rfm"))
def q_rfm_scores(spark, sf):
    return scored(spark, sf)


@register("label_clusters", sql("SELECT * FROM labels", "segments"))
def q_label_clusters(spark, sf):
    return SG.label_clusters(SG.score_clusters(scored(spark, sf)))


@register("map_labels", sql("SELECT * FROM segments", "segments"))
def q_map_labels(spark, sf):
    return segmented(spark, sf)


@register("segment_sizes", sql("""
SELECT segment, count(*) AS count, count(*) / sum(count(*)) OVER () * 100.0 AS share_pct
FROM segments GROUP BY segment""", "segments"))
def q_segment_sizes(spark, sf):
    return RP.segment_sizes(segmented(spark, sf))


@register("segment_summary", sql(f"""
SELECT segment, count(DISTINCT CustomerID) AS customers, {R('avg(recency)', 1)} AS avg_recency,
       {R('avg(frequency)', 1)} AS avg_frequency, {R('avg(monetary)', 1)} AS avg_monetary
FROM segments GROUP BY segment""", "segments"))
def q_segment_summary(spark, sf):
    return RP.segment_summary(segmented(spark, sf))


@register("segment_value", sql(f"""
SELECT segment, customers, c / 100.0 AS total_monetary, c / sum(c) OVER () * 100.0 AS share_pct FROM (
  SELECT segment, count(DISTINCT CustomerID) AS customers, sum({CENTS('monetary')}) AS c
  FROM segments GROUP BY segment)""", "segments"))
def q_segment_value(spark, sf):
    return RP.segment_value(segmented(spark, sf))


@register("customers_in_segment", sql(
    "SELECT * FROM segments WHERE lower(segment) = lower('champions')", "segments"))
def q_customers_in_segment(spark, sf):
    return RP.customers_in_segment(segmented(spark, sf), "champions")


@register("join_segments", sql("""
SELECT clean.*, segments.segment FROM clean JOIN segments USING (CustomerID)""", "segments"))
def q_join_segments(spark, sf):
    return SG.join_segments(sales(spark, sf), segmented(spark, sf))


@register("top_products_by_segment", sql("""
SELECT segment, Description, Quantity FROM (
  SELECT segment, Description, sum(Quantity) AS Quantity,
         row_number() OVER (PARTITION BY segment ORDER BY sum(Quantity) DESC, Description) AS r
  FROM prod JOIN segments USING (CustomerID) GROUP BY segment, Description)
WHERE r <= 5""", "segments", "products"))
def q_top_products_by_segment(spark, sf):
    return SG.top_products_by_segment(sales(spark, sf), segmented(spark, sf), 5)


@register("churn_dataset", sql("SELECT * FROM churn", "churn"))
def q_churn_dataset(spark, sf):
    return churn(spark, sf)


@register("anti_churned", sql("""
SELECT DISTINCT CustomerID FROM bef WHERE CustomerID NOT IN (SELECT CustomerID FROM ret)""", "churn"))
def q_anti_churned(spark, sf):
    return CU.churned_customers(sales(spark, sf))


@register("broadcast_scalars", sql("""
SELECT InvoiceNo, StockCode, InvoiceDate, cutoff, InvoiceDate < cutoff AS before_cutoff
FROM cid CROSS JOIN cut""", "churn"))
def q_broadcast_scalars(spark, sf):
    s = CU.identified_only(sales(spark, sf))
    cut = CU.churn_cutoff(sales(spark, sf))
    return (with_scalars(s, cut)
             .select("InvoiceNo", "StockCode", "InvoiceDate", "cutoff",
                     (F.col("InvoiceDate") < F.col("cutoff")).alias("before_cutoff")))


@register("churn_risk_counts", sql("""
SELECT l.risk_level, coalesce(c.customers, 0) AS customers
FROM (VALUES ('High'), ('Medium'), ('Low')) l(risk_level)
LEFT JOIN (SELECT risk_level, count(*) AS customers FROM scores2 GROUP BY 1) c USING (risk_level)""",
    "churn", extra=HEURISTIC_SQL))
def q_churn_risk_counts(spark, sf):
    return RP.churn_risk_counts(heuristic_scores(spark, sf))


@register("probability_histogram", sql("""
SELECT bin, count(*) AS count, bin / 20.0 AS lower, (bin + 1) / 20.0 AS upper FROM (
  SELECT CAST(least(floor(churn_probability * 20), 19) AS INTEGER) AS bin FROM scores2)
GROUP BY bin""", "churn", extra=HEURISTIC_SQL))
def q_probability_histogram(spark, sf):
    return RP.probability_histogram(heuristic_scores(spark, sf))


@register("potential_loss", sql(f"""
SELECT coalesce(sum(CASE WHEN risk_level = 'High' THEN {CENTS('monetary')} END), 0) / 100.0
       AS potential_loss FROM scores2""", "churn", extra=HEURISTIC_SQL))
def q_potential_loss(spark, sf):
    return RP.potential_loss(heuristic_scores(spark, sf))


@register("at_risk_customers", sql("""
SELECT CustomerID, recency, frequency, monetary, churn_probability, risk_level
FROM scores2 WHERE risk_level = 'High'""", "churn", extra=HEURISTIC_SQL))
def q_at_risk_customers(spark, sf):
    return RP.at_risk_customers(heuristic_scores(spark, sf), "High")


# ---------------------------------------------------------------------------
# 2.5 windows and 2.8 scalar functions over the daily series
# ---------------------------------------------------------------------------

@register("calendar_features", sql("""
SELECT date, day_of_week, day_of_month, month, year, week_of_year, is_weekend,
       is_month_start, is_month_end FROM feat0""", "features"))
def q_calendar_features(spark, sf):
    return D.calendar_features(daily(spark, sf)).select(
        "date", "day_of_week", "day_of_month", "month", "year", "week_of_year",
        "is_weekend", "is_month_start", "is_month_end")


@register("avg_order_value", sql("SELECT date, avg_order_value FROM feat0", "features"))
def q_avg_order_value(spark, sf):
    return D.avg_order_value(daily(spark, sf)).select("date", "avg_order_value")


@register("lag_features", sql(
    "SELECT date, units_sold, lag_1, lag_7, lag_14, lag_28 FROM feat0", "features"))
def q_lag_features(spark, sf):
    return D.lag_features(daily(spark, sf)).select("date", "units_sold", "lag_1", "lag_7",
                                                    "lag_14", "lag_28")


@register("rolling_features", sql("""
SELECT date, rolling_mean_7, rolling_std_7, rolling_mean_14, rolling_std_14,
       rolling_mean_30, rolling_std_30 FROM feat0""", "features"))
def q_rolling_features(spark, sf):
    return D.rolling_features(daily(spark, sf)).select(
        "date", "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14",
        "rolling_mean_30", "rolling_std_30")


@register("daily_features", sql("SELECT * FROM features", "features"))
def q_daily_features(spark, sf):
    return features(spark, sf)


@register("daily_features_blocked", sql("SELECT * FROM features", "features"))
def q_daily_features_blocked(spark, sf):
    """The same features from blocks of a year with the rows before them."""
    return D.blocked_series(daily(spark, sf), lambda d, keys: D.daily_features(d, keys))


@register("chronological_split", sql("""
SELECT date, units_sold, CASE WHEN pos >= n - least(60, greatest(n // 5, 1)) THEN 'test'
                              ELSE 'train' END AS split
FROM (SELECT date, units_sold, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n
      FROM features)""", "features"))
def q_chronological_split(spark, sf):
    return D.chronological_split(features(spark, sf)).select("date", "units_sold", "split")


@register("walk_forward_splits", sql("""
SELECT date, fold, role FROM (
  SELECT f.date, k.fold,
         CASE WHEN pos < 90 + (k.fold - 1) * fs THEN 'train'
              WHEN pos < least(90 + (k.fold - 1) * fs + fs, n) THEN 'test' END AS role,
         nf, 90 + (k.fold - 1) * fs AS train_end, least(90 + (k.fold - 1) * fs + fs, n) AS test_end
  FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n,
               greatest((count(*) OVER () - 90) // 5, 1) AS fs FROM features) f
  CROSS JOIN (SELECT unnest(range(1, 6)) AS fold) k
  CROSS JOIN LATERAL (SELECT least(5, greatest((n - 90) // fs, 1)) AS nf)
) WHERE fold <= nf AND train_end < test_end AND role IS NOT NULL""", "features"))
def q_walk_forward_splits(spark, sf):
    return D.walk_forward_splits(features(spark, sf)).select("date", "fold", "role")


@register("last_row", sql("SELECT * FROM features ORDER BY date DESC LIMIT 1", "features"))
def q_last_row(spark, sf):
    return D.last_row(features(spark, sf))


# ---------------------------------------------------------------------------
# 2.9 market baskets
# ---------------------------------------------------------------------------

def item_itemsets(spark, sf):
    return staged(spark, sf, "itemsets", lambda lines: B.frequent_itemsets(B.build_baskets(lines, "ItemType", None)))


def product_baskets(spark, sf):
    return B.build_baskets(sales(spark, sf), "Description", 200)


def rules_sql(baskets: str, support: float, confidence: float) -> str:
    """Itemsets (``fi``) and rules (``rules``) of the table ``ib`` that
    ``baskets`` defines, from all subsets of every basket."""
    return f"""
ib AS ({baskets}),
nb AS (SELECT count(*) AS n FROM ib),
subs AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items
         FROM (SELECT items, unnest(range(1, (1 << len(items)))) AS m FROM ib)),
fi AS (SELECT items, count(*) AS freq, count(*) / (SELECT n FROM nb) AS support FROM subs
       GROUP BY items HAVING count(*) / (SELECT n FROM nb) >= {support}),
sp AS (SELECT items, support, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS a,
              list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS c
       FROM (SELECT items, support, unnest(range(1, (1 << len(items)) - 1)) AS m FROM fi
             WHERE len(items) >= 2)),
rules AS (SELECT array_to_string(sp.a, ', ') AS antecedents, array_to_string(sp.c, ', ') AS consequents,
                 sp.support, sp.support / fa.support AS confidence,
                 sp.support / fa.support / fc.support AS lift
          FROM sp JOIN fi fa ON fa.items = sp.a JOIN fi fc ON fc.items = sp.c
          WHERE sp.support / fa.support >= {confidence})"""


BASKETS_SQL = rules_sql("""
SELECT InvoiceNo, list_sort(list_distinct(list(ItemType))) AS items FROM clean
WHERE ItemType IS NOT NULL AND InvoiceNo IS NOT NULL GROUP BY InvoiceNo
HAVING len(list_distinct(list(ItemType))) > 1""", 0.01, 0.2)

PRODUCT_BASKETS_SQL = """
SELECT InvoiceNo, list_sort(list_distinct(list(Description))) AS items FROM prod
WHERE Description IN (SELECT Description FROM prod GROUP BY Description
                      ORDER BY sum(Quantity) DESC, Description LIMIT 200)
  AND InvoiceNo IS NOT NULL
GROUP BY InvoiceNo HAVING len(list_distinct(list(Description))) > 1"""

# Products are bought together a few times at most in the test tables, so that
# only single ones reach the usual support of 0.01.
RARE_SUPPORT, RARE_CONFIDENCE = 0.0005, 0.05


@register("build_baskets", sql(PRODUCT_BASKETS_SQL, "products"))
def q_build_baskets(spark, sf):
    return product_baskets(spark, sf)


@register("product_itemsets", sql("SELECT items, freq, support FROM fi", "products", extra=rules_sql(PRODUCT_BASKETS_SQL, 0.01, 0.2)))
def q_product_itemsets(spark, sf):
    return staged(spark, sf, "product itemsets", lambda lines: B.frequent_itemsets(B.build_baskets(lines, "Description", 200)))


@register("product_rules", sql("SELECT * FROM rules", "products", extra=rules_sql(PRODUCT_BASKETS_SQL, RARE_SUPPORT, RARE_CONFIDENCE)))
def q_product_rules(spark, sf):
    """Rules over the 200 top products, at a support that their baskets reach."""
    return B.association_rules(staged(spark, sf, "rare itemsets", lambda lines: B.frequent_itemsets(
        B.build_baskets(lines, "Description", 200), RARE_SUPPORT)), RARE_CONFIDENCE)


@register("frequent_itemsets", sql("SELECT items, freq, support FROM fi", "clean", extra=BASKETS_SQL))
def q_frequent_itemsets(spark, sf):
    return item_itemsets(spark, sf)


@register("association_rules", sql("SELECT * FROM rules", "clean", extra=BASKETS_SQL))
def q_association_rules(spark, sf):
    return B.association_rules(item_itemsets(spark, sf))


@register("filter_rules", sql("SELECT * FROM rules WHERE confidence >= 0.5", "clean", extra=BASKETS_SQL))
def q_filter_rules(spark, sf):
    return B.filter_rules(B.association_rules(item_itemsets(spark, sf)), 0.5)


# ---------------------------------------------------------------------------
# 2.1 sources and sinks (data derived from the test tables by Spark)
# ---------------------------------------------------------------------------

@register("scan_transactions", sql("""
SELECT * REPLACE (Description || ', "LEIS",' || chr(10) || 'RED' AS Description) FROM retail_raw""", "raw"))
def q_scan_transactions(spark, sf):
    """Export the raw view as two Latin-1 CSV folders with header variants,
    another column order, and quotes, commas and line breaks inside the
    descriptions, then read both through the CSV source."""
    export = raw(spark, sf).withColumnsRenamed(
        {"InvoiceNo": "Invoice", "UnitPrice": "Price", "CustomerID": "Customer ID"}).withColumn(
        "Description", F.concat("Description", F.lit(', "LEIS",\nRED')))
    path = FS.fresh_path(spark, "raw_csv")
    early = F.year("InvoiceDate") < 1998
    for name, part in (("early", export.filter(early)),
                       ("late", export.filter(~early).select(*reversed(export.columns)))):
        (part.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
             .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{path}/{name}"))
    return C.convert_types(FS.read_transactions(spark, [f"{path}/early", f"{path}/late"])).select(
        "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
        "CustomerID", "Country", "ItemType")


@register("normalize_columns", sql("SELECT * FROM retail_raw", "raw"))
def q_normalize_columns(spark, sf):
    messy = raw(spark, sf).withColumnsRenamed(
        {"InvoiceNo": " Invoice ", "UnitPrice": "PRICE", "CustomerID": "customer id",
         "StockCode": "stockcode", "InvoiceDate": "InvoiceDate "})
    return FS.check_columns(FS.normalize_columns(messy))


@register("union_sources", sql("""
SELECT * REPLACE (CASE WHEN year(InvoiceDate) < 1998 THEN ItemType END AS ItemType)
FROM retail_raw""", "raw"))
def q_union_sources(spark, sf):
    r = raw(spark, sf)
    early = r.filter(F.year("InvoiceDate") < 1998)
    late = r.filter(F.year("InvoiceDate") >= 1998).drop("ItemType")
    late = late.select(*reversed(late.columns))
    return FS.union_sources([early, late])


@register("write_stage", sql("SELECT *, strftime(InvoiceDate, '%Y-%m') AS InvoiceMonth FROM clean", "clean"))
def q_write_stage(spark, sf):
    path = FS.fresh_path(spark, "sales_by_month")
    staged = sales(spark, sf).withColumn("InvoiceMonth", F.date_format("InvoiceDate", "yyyy-MM"))
    FS.write_stage(staged, path, by=["InvoiceMonth"], sort_by=["InvoiceDate"])
    return FS.read_stage(spark, path).withColumn("InvoiceMonth", F.col("InvoiceMonth").cast("string"))


# ---------------------------------------------------------------------------
# 2.10 forecasting, 2.11 attribution (MLlib fits: rows-only checks, except
# the metric operators, checked on a fit-free seasonal-naive prediction)
# ---------------------------------------------------------------------------

from tillsight.ml import attribution as AT  # noqa: E402
from tillsight.ml import forecast as FC  # noqa: E402
from tillsight.ml.parallel import fit_all  # noqa: E402
from tillsight.operators import metrics as M  # noqa: E402

# Models have the reference's sizes (300 trees, 400 rounds). Each is fitted
# once a session and source, and shared by the queries that need it.
MODELS = FC.default_models()


def split_features(spark, sf):
    return FC.spread(FC.feature_vector(D.chronological_split(features(spark, sf))))


@register("regression_metrics", sql(f"""
SELECT {R('1 - sum((units_sold - lag_7) ^ 2) / (var_pop(units_sold) * count(*))', 4)} AS R2,
       {R('sqrt(sum((units_sold - lag_7) ^ 2) / count(*))', 2)} AS RMSE,
       {R('avg(abs(units_sold - lag_7))', 2)} AS MAE
FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM features)
WHERE pos >= n - least(60, greatest(n // 5, 1))""", "features"))
def q_regression_metrics(spark, sf):
    """Seasonal-naive forecast (same weekday-lag a week earlier) on the test split."""
    t = D.chronological_split(features(spark, sf)).filter(F.col("split") == "test")
    return M.regression_metrics(t.withColumn("prediction", F.col("lag_7")))


def split_table(spark, sf):
    return once(spark, sf, "split features", lambda: materialize(split_features(spark, sf)))


def fitted(spark, sf, name):
    """The named model on the training days."""
    train = split_table(spark, sf).filter(F.col("split") == "train")
    return once(spark, sf, f"model {name}", lambda: MODELS[name](train))


def test_days(spark, sf):
    return split_table(spark, sf).filter(F.col("split") == "test")


def predictions(model, days):
    return model.transform(days).select("date", "units_sold", F.col("prediction").cast("double").alias("prediction"))


_SPLIT_SQL = """
SELECT date, {} FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM features)
"""
_TEST_DAYS = " WHERE pos >= n - least(60, greatest(n // 5, 1))"


@register("feature_vector", sql(_SPLIT_SQL.format(
    "CASE WHEN pos >= n - least(60, greatest(n // 5, 1)) THEN 'test' ELSE 'train' END AS split, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FORECAST_FEATURES)), "features"))
def q_feature_vector(spark, sf):
    parts = vector_to_array("features")
    return split_features(spark, sf).select("date", "split", *[parts[i].alias(c) for i, c in enumerate(FORECAST_FEATURES)])


@register("forecast_linear")
def q_forecast_linear(spark, sf):
    return predictions(fitted(spark, sf, "Linear Regression"), test_days(spark, sf))


@register("forecast_forest")
def q_forecast_forest(spark, sf):
    return predictions(fitted(spark, sf, "Random Forest"), test_days(spark, sf))


@register("forecast_boosted")
def q_forecast_boosted(spark, sf):
    return predictions(fitted(spark, sf, "Boosted Trees"), test_days(spark, sf))


@register("forecast_boosted_no_sampling")
def q_forecast_boosted_plain(spark, sf):
    return predictions(fitted(spark, sf, "Boosted Trees (no sampling)"), test_days(spark, sf))


def comparison(spark, sf):
    split_table(spark, sf)  # before the fits ask for it side by side
    return once(spark, sf, "comparison", lambda: materialize(FC.model_comparison(
        features(spark, sf), {name: lambda _, name=name: fitted(spark, sf, name) for name in MODELS})[0]))


def winner(spark, sf) -> str:
    return once(spark, sf, "winner", lambda: FC.best_model(comparison(spark, sf)).first()["model"])


def validation(spark, sf):
    """Walk-forward folds of the winner."""
    return once(spark, sf, "validation", lambda: materialize(
        FC.walk_forward_cv(features(spark, sf), MODELS[winner(spark, sf)])))


def reloaded(spark, sf):
    """The winner, saved with its metadata and loaded again."""
    def make():
        name, path = winner(spark, sf), FS.fresh_path(spark, "models/best")
        FC.save_model(fitted(spark, sf, name), path, {"best_model": name, "feature_cols": list(FORECAST_FEATURES)})
        return FC.load_model(path), FC.load_meta(spark, path)

    return once(spark, sf, "reloaded", make)


@register("model_comparison")
def q_model_comparison(spark, sf):
    return comparison(spark, sf).orderBy(F.desc("R2"), F.asc("model"))


@register("best_model")
def q_best_model(spark, sf):
    return FC.best_model(comparison(spark, sf))


@register("walk_forward_cv")
def q_walk_forward_cv(spark, sf):
    return validation(spark, sf)


@register("walk_forward_cv_days", sql("""
SELECT CAST(k.fold AS INTEGER) AS fold, 90 + (k.fold - 1) * fs AS train_days,
       least(90 + k.fold * fs, n) - (90 + (k.fold - 1) * fs) AS test_days
FROM (SELECT count(*) AS n, greatest((count(*) - 90) // 5, 1) AS fs FROM features)
CROSS JOIN (SELECT unnest(range(1, 6)) AS fold) k
WHERE 90 + (k.fold - 1) * fs < n""", "features"))
def q_walk_forward_cv_days(spark, sf):
    """The part of the folds that does not depend on the fit."""
    return validation(spark, sf).select("fold", "train_days", "test_days")


@register("what_if")
def q_what_if(spark, sf):
    return FC.what_if(reloaded(spark, sf)[0], features(spark, sf))


@register("what_if_cases", sql("""
SELECT CAST(d AS INTEGER) AS day_of_week, CAST(d >= 5 AS INTEGER) AS is_weekend, CAST(s AS INTEGER) AS is_month_start,
       CAST(e AS INTEGER) AS is_month_end, units_sold AS last_units_sold, TRUE AS delta_fits
FROM (SELECT unnest(range(7)) AS d) CROSS JOIN (SELECT unnest(range(2)) AS s) CROSS JOIN (SELECT unnest(range(2)) AS e)
CROSS JOIN (SELECT units_sold FROM features ORDER BY date DESC LIMIT 1)""", "features"))
def q_what_if_cases(spark, sf):
    """The cases and the last day behind ``what_if``, whatever the model."""
    fits = F.col("delta") == F.col("predicted_units_sold") - F.col("last_units_sold")
    return q_what_if(spark, sf).select(*FC.SCENARIO_COLS, "last_units_sold", fits.alias("delta_fits"))


@register("save_load_model")
def q_save_load_model(spark, sf):
    return predictions(reloaded(spark, sf)[0], test_days(spark, sf))


@register("save_load_model_same", sql(_SPLIT_SQL.format("units_sold, TRUE AS same_prediction") + _TEST_DAYS, "features"))
def q_save_load_model_same(spark, sf):
    """Does the reloaded model, named by its metadata, predict what the fitted
    one does?"""
    model, meta = reloaded(spark, sf)
    before = predictions(fitted(spark, sf, meta["best_model"]), test_days(spark, sf)).select(
        "date", F.col("prediction").alias("_before"))
    return predictions(model, test_days(spark, sf)).join(before, "date").select(
        "date", "units_sold", (F.col("prediction") == F.col("_before")).alias("same_prediction"))


def _tree_attr(spark, sf):
    return once(spark, sf, "tree attributions", lambda: materialize(
        AT.shap_tree(fitted(spark, sf, "Boosted Trees"), test_days(spark, sf))))


def _linear_attr(spark, sf):
    return AT.shap_linear(fitted(spark, sf, "Linear Regression"), test_days(spark, sf),
                          split_table(spark, sf).filter(F.col("split") == "train"))


def _adds_up(attr, predicted):
    """Do base value and attributions add up to the model's own prediction?"""
    total = sum((F.col(c) for c in FORECAST_FEATURES), F.col("base_value"))
    want = predicted.select("date", F.col("prediction").alias("_model"))
    off = F.abs(total - F.col("_model")) / F.greatest(F.abs("_model"), F.lit(1.0))
    return attr.join(want, "date").select("date", (off < 1e-6).alias("adds_up"))


@register("shap_tree")
def q_shap_tree(spark, sf):
    return _tree_attr(spark, sf)


@register("shap_tree_adds_up", sql(_SPLIT_SQL.format("TRUE AS adds_up") + _TEST_DAYS, "features"))
def q_shap_tree_adds_up(spark, sf):
    return _adds_up(_tree_attr(spark, sf), q_forecast_boosted(spark, sf))


@register("shap_linear")
def q_shap_linear(spark, sf):
    return _linear_attr(spark, sf)


@register("shap_linear_adds_up", sql(_SPLIT_SQL.format("TRUE AS adds_up") + _TEST_DAYS, "features"))
def q_shap_linear_adds_up(spark, sf):
    return _adds_up(_linear_attr(spark, sf), q_forecast_linear(spark, sf))


@register("shap_importance")
def q_shap_importance(spark, sf):
    return AT.shap_importance(_tree_attr(spark, sf))


@register("explain_one_row")
def q_explain_one_row(spark, sf):
    return AT.explain_one_row(_tree_attr(spark, sf))


# ---------------------------------------------------------------------------
# 2.12 segmentation and churn
# ---------------------------------------------------------------------------

from tillsight.ml import churn as CH  # noqa: E402
from tillsight.ml import segments as KS  # noqa: E402
from tillsight.ml.silhouette import silhouette  # noqa: E402

_RFM_Z = ["recency_z", "frequency_z", "monetary_z"]


@register("standardize", sql("""
SELECT CustomerID,
       (recency - avg(recency) OVER ()) / nullif(stddev_pop(recency) OVER (), 0) AS recency_z,
       (frequency - avg(frequency) OVER ()) / nullif(stddev_pop(frequency) OVER (), 0) AS frequency_z,
       (monetary - avg(monetary) OVER ()) / nullif(stddev_pop(monetary) OVER (), 0) AS monetary_z
FROM customer_features""", "customers"))
def q_standardize(spark, sf):
    return M.standardize(customers(spark, sf), ["recency", "frequency", "monetary"]).select(
        "CustomerID", "recency_z", "frequency_z", "monetary_z")


@register("balanced_weights", sql("""
SELECT churned, (SELECT count(*) FROM churn) / (2.0 * count(*)) AS weight
FROM churn GROUP BY churned""", "churn"))
def q_balanced_weights(spark, sf):
    return M.class_weights(churn(spark, sf), "churned")


@register("binary_metrics", sql(f"""
SELECT {R('(tp + tn) / nrows', 4)} AS Accuracy,
       {R('coalesce(tp / nullif(tp + fp, 0), 0.0)', 4)} AS Precision,
       {R('coalesce(tp / nullif(tp + fn, 0), 0.0)', 4)} AS Recall,
       {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)', 4)} AS F1,
       {R('u / (P * N)', 4)} AS ROC_AUC
FROM (SELECT count(*) AS nrows,
             sum(CASE WHEN churned = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
             sum(CASE WHEN churned = 0 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
             sum(CASE WHEN churned = 1 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
             sum(CASE WHEN churned = 0 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
      FROM scores2)
CROSS JOIN (SELECT sum(pos * (negb + neg * 0.5)) AS u, sum(pos)::DOUBLE AS P, sum(neg)::DOUBLE AS N FROM (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS negb
  FROM (SELECT churn_probability AS s, sum(churned) AS pos, sum(1 - churned) AS neg
        FROM scores2 GROUP BY 1)))""", "churn", extra=HEURISTIC_SQL))
def q_binary_metrics(spark, sf):
    s = heuristic_scores(spark, sf)
    return M.binary_metrics(s, label="churned", prediction="prediction", score="churn_probability")


@register("stratified_split", sql("""
SELECT CustomerID, churned, CASE WHEN row_number() OVER (PARTITION BY churned ORDER BY u, CustomerID)
         <= floor(0.75 * count(*) OVER (PARTITION BY churned) + 0.5) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, ('0x' || substr(md5(CustomerID || ':42'), 1, 9))::BIGINT AS u FROM churn)""", "churn"))
def q_stratified_split(spark, sf):
    return CH.stratified_split(churn(spark, sf)).select("CustomerID", "churned", "split")


def _churn_fit(spark, sf):
    """(comparison, models, prepared customers), fitted once."""
    return once(spark, sf, "churn models", lambda: CH.churn_comparison(churn(spark, sf)))


def _churn_winner(spark, sf):
    table, models, data = _churn_fit(spark, sf)
    return models[once(spark, sf, "churn winner", lambda: table.first()["model"])], data


@register("churn_logistic")
def q_churn_logistic(spark, sf):
    _, models, data = _churn_fit(spark, sf)
    return CH.churn_score(models["Logistic Regression"], data)


@register("churn_forest")
def q_churn_forest(spark, sf):
    _, models, data = _churn_fit(spark, sf)
    return CH.churn_score(models["Random Forest"], data)


@register("churn_comparison")
def q_churn_comparison(spark, sf):
    return _churn_fit(spark, sf)[0]


@register("churn_score")
def q_churn_score(spark, sf):
    return CH.churn_score(*_churn_winner(spark, sf))


@register("churn_score_levels", sql("""
SELECT CustomerID, recency, frequency, monetary, avg_basket_size, purchase_frequency_per_month, churned,
       TRUE AS level_fits FROM churn""", "churn"))
def q_churn_score_levels(spark, sf):
    """The scored customers, and whether each risk level follows from the
    probability."""
    p = F.col("churn_probability")
    level = F.when(p <= 0.3, "Low").when(p <= 0.6, "Medium").otherwise("High")
    fits = p.between(0, 1) & (F.col("risk_level") == level)
    return q_churn_score(spark, sf).select("CustomerID", "recency", "frequency", "monetary", "avg_basket_size",
                                           "purchase_frequency_per_month", "churned", fits.alias("level_fits"))


@register("sorted_predictions")
def q_sorted_predictions(spark, sf):
    return CH.churn_score(*_churn_winner(spark, sf)).select(
        "CustomerID", "churn_probability", "risk_level")


@register("churn_importance")
def q_churn_importance(spark, sf):
    return CH.churn_importance(_churn_winner(spark, sf)[0])


def _churn_chain(spark, sf):
    """The winner's scoring chain as fitted, and saved and loaded again."""
    def make():
        chain, path = CH.churn_pipeline(*_churn_winner(spark, sf)), FS.fresh_path(spark, "models/churn")
        return chain, FC.load_model(FC.save_model(chain, path))

    return once(spark, sf, "churn chain", make)


@register("save_load_churn")
def q_save_load_churn(spark, sf):
    """Every customer as of the last day, scored by the reloaded chain. The fit
    saw the customers before the cutoff only, with the features of that day."""
    return CH.score_customers(_churn_chain(spark, sf)[1], customers(spark, sf))


@register("save_load_churn_same", sql("""
SELECT CustomerID, recency, frequency, monetary, avg_basket_size, purchase_frequency_per_month, TRUE AS same_score
FROM customer_features""", "customers"))
def q_save_load_churn_same(spark, sf):
    """Does the reloaded chain score unseen customers as the fitted one does?"""
    before = CH.score_customers(_churn_chain(spark, sf)[0], customers(spark, sf)).select(
        "CustomerID", F.col("churn_probability").alias("_p"), F.col("risk_level").alias("_level"))
    same = (F.col("churn_probability") == F.col("_p")) & (F.col("risk_level") == F.col("_level")) & F.col("_p").between(0, 1)
    return q_save_load_churn(spark, sf).join(before, "CustomerID").withColumn("same_score", same).drop(
        "churn_probability", "risk_level", "_p", "_level")


def _segment_fit(spark, sf):
    """(segments, model, reloaded chain), fitted once."""
    def make():
        seg, model = KS.kmeans_segments(scored(spark, sf), k=5)
        seg, path = materialize(seg), FS.fresh_path(spark, "models/segments")
        return seg, model, FC.load_model(FC.save_model(KS.segment_pipeline(seg, model), path))

    return once(spark, sf, "segments", make)


@register("kmeans_segments")
def q_kmeans_segments(spark, sf):
    return _segment_fit(spark, sf)[0]


@register("kmeans_segments_nearest", sql("""
SELECT CustomerID, recency, frequency, monetary, TRUE AS nearest, TRUE AS named FROM customer_features""", "customers"))
def q_kmeans_segments_nearest(spark, sf):
    """Is each customer in the cluster of its nearest centre, and does each
    cluster have one name?"""
    seg, model, _ = _segment_fit(spark, sf)
    z = M.standardize(seg, ["recency", "frequency", "monetary"])
    square = [sum((F.col(f"{c}_z") - F.lit(float(x))) ** 2 for c, x in zip(["recency", "frequency", "monetary"], centre))
              for centre in model.clusterCenters()]
    own = F.element_at(F.array(*square), F.col("cluster") + 1)
    names = seg.groupBy("cluster").agg(F.count_distinct("segment").alias("_names"))
    return z.join(F.broadcast(names), "cluster").select(
        "CustomerID", "recency", "frequency", "monetary", (own <= F.least(*square) * (1 + 1e-9) + 1e-12).alias("nearest"),
        ((F.col("_names") == 1) & F.col("segment").isNotNull()).alias("named"))


@register("save_load_segments_same", sql("SELECT CustomerID, recency, frequency, monetary, TRUE AS same_segment FROM customer_features", "customers"))
def q_save_load_segments_same(spark, sf):
    """Does the reloaded chain (scaler, centres, names) give every customer the
    segment of the fit?"""
    seg, _, chain = _segment_fit(spark, sf)
    again = KS.assign_segments(chain, customers(spark, sf)).select(
        "CustomerID", "recency", "frequency", "monetary", F.col("cluster").alias("_c"), F.col("segment").alias("_s"))
    return again.join(seg.select("CustomerID", "cluster", "segment"), "CustomerID").select(
        "CustomerID", "recency", "frequency", "monetary", ((F.col("_c") == F.col("cluster")) & (F.col("_s") == F.col("segment"))).alias("same_segment"))


@register("k_sweep")
def q_k_sweep(spark, sf):
    return KS.k_sweep(scored(spark, sf), range(2, 9))


@register("segment_silhouette", sql("""
SELECT (SELECT count(*) FROM z) AS customers, round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette
FROM (SELECT CustomerID, max(n) AS n, max(CASE WHEN own THEN total / greatest(size - 1, 1) END) AS a,
             min(CASE WHEN NOT own THEN total / size END) AS b
      FROM (SELECT *, CASE WHEN own THEN size END AS n FROM sums) GROUP BY CustomerID)""", "segments", extra="""
z AS (
  SELECT CustomerID, cluster, (recency - avg(recency) OVER ()) / nullif(stddev_pop(recency) OVER (), 0) AS r,
         (frequency - avg(frequency) OVER ()) / nullif(stddev_pop(frequency) OVER (), 0) AS f,
         (monetary - avg(monetary) OVER ()) / nullif(stddev_pop(monetary) OVER (), 0) AS m
  FROM segments
),
sums AS (
  SELECT x.CustomerID, x.cluster = y.cluster AS own, count(*) AS size,
         sum(sqrt((x.r - y.r) ** 2 + (x.f - y.f) ** 2 + (x.m - y.m) ** 2)) AS total
  FROM z AS x CROSS JOIN z AS y GROUP BY x.CustomerID, x.cluster, y.cluster
)"""))
def q_segment_silhouette(spark, sf):
    """Mean Euclidean silhouette of the rule clusters on standardized R/F/M."""
    data = materialize(KS.scaled_rfm(segmented(spark, sf)).select("CustomerID", "cluster", *_RFM_Z))
    value, _ = silhouette(data, _RFM_Z)
    return data.agg(F.count(F.lit(1)).alias("customers")).withColumn("silhouette", F.round(F.lit(value), 4))


# ---------------------------------------------------------------------------
# 2.3 report figures (fit-free part; model figures come from model_comparison
# and walk_forward_cv)
# ---------------------------------------------------------------------------

@register("report_figures", sql(f"""
SELECT d.total_revenue, d.total_units, d.date_start, d.date_end,
       (SELECT count(DISTINCT CustomerID) FROM segments) AS customers,
       (SELECT count(DISTINCT Country) FROM clean) AS countries,
       t.segment AS top_segment, t.customers AS top_segment_customers,
       t.c / (SELECT sum({CENTS('monetary')}) FROM segments) * 100.0 AS top_segment_share_pct,
       coalesce((SELECT count(*) FROM segments WHERE segment = 'At Risk'), 0) AS at_risk_customers,
       coalesce((SELECT sum({CENTS('monetary')}) FROM segments WHERE segment = 'At Risk'), 0) / 100.0
         AS at_risk_monetary,
       (SELECT count(*) FROM rules) AS n_rules,
       (SELECT sum(c) FROM (SELECT c FROM pc ORDER BY c DESC, Description LIMIT 5))
         / (SELECT sum(c) FROM pc) * 100.0 AS top_share_pct
FROM (SELECT {MONEY_SUM('revenue')} AS total_revenue, sum(units_sold) AS total_units,
             min(date) AS date_start, max(date) AS date_end FROM daily) d
CROSS JOIN (SELECT segment, count(DISTINCT CustomerID) AS customers, sum({CENTS('monetary')}) AS c
            FROM segments GROUP BY segment ORDER BY c DESC, segment LIMIT 1) t""",
    "segments", "daily", "products", extra=BASKETS_SQL + f""",
pc AS (SELECT Description, sum({CENTS('TotalPrice')}) AS c FROM prod GROUP BY Description)"""))
def q_report_figures(spark, sf):
    rules = B.association_rules(item_itemsets(spark, sf))
    return RP.report_figures(daily(spark, sf), sales(spark, sf), segmented(spark, sf), rules)


def make_report_tables(spark, sf) -> None:
    """The session's tables behind the report. Most of the time that the fits
    take is scheduling of small jobs, which leaves cores to the itemsets and
    the customers: these are made meanwhile."""
    split_table(spark, sf)  # with lines and daily totals, which all three start from
    with bounded_tasks(spark, table(spark, sf, "lineitem").count()):  # once for all: the threads change no setting
        fit_all(lambda make: make(spark, sf), (validation, item_itemsets, customers))


@register("report_figures_models")
def q_report_figures_models(spark, sf):
    """The whole report row: the figures above, the best model with R2 and
    MAE, and mean and deviation of its folds."""
    make_report_tables(spark, sf)
    best = FC.best_model(comparison(spark, sf)).select(
        F.col("model").alias("best_model"), F.col("R2").alias("best_r2"), F.col("MAE").alias("best_mae"))
    return with_scalars(with_scalars(q_report_figures(spark, sf), best), FC.cv_summary(validation(spark, sf)))


# ---------------------------------------------------------------------------
# 2.14 streaming (events table through Structured Streaming)
# ---------------------------------------------------------------------------

from tillsight.streaming import events as ST  # noqa: E402
import os as _os  # noqa: E402
from tillsight.functions.scalars import with_scalars


def _events_stream(spark, sf):
    return ST.read_events(spark, _os.path.join(sf, "events.parquet"))


@register("stream_daily_totals", """
SELECT CAST(ts AS DATE) AS date, count(*) AS events,
       CAST(sum(CAST(round_even(value * 100.0, 0) AS BIGINT)) AS DOUBLE) / 100.0 AS value,
       count(DISTINCT user_id) AS users
FROM events
WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)
GROUP BY 1""")
def q_stream_daily_totals(spark, sf):
    out = ST.run_available(ST.stream_daily_totals(_events_stream(spark, sf)), "daily_totals")
    return spark.read.parquet(out)


@register("stream_dedupe", "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events")
def q_stream_dedupe(spark, sf):
    """Every event arrives once, every third one again."""
    copies = F.sequence(F.lit(1), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1))
    twice = _events_stream(spark, sf).withColumn("_copy", F.explode(copies)).drop("_copy")
    out = ST.run_available(ST.stream_dedupe(twice), "dedupe")
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_customer_rfm", """
SELECT user_id, count(*) AS frequency,
       CAST(sum(CAST(round_even(value * 100.0, 0) AS BIGINT)) AS DOUBLE) / 100.0 AS monetary,
       max(ts) AS last_event
FROM events GROUP BY user_id""")
def q_stream_customer_rfm(spark, sf):
    table = ST.stream_customer_rfm(_events_stream(spark, sf))
    return ST.latest_profiles(spark, table).withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))


# ---------------------------------------------------------------------------
# additions: semi join on the top-N set, country panels, CV summary
# ---------------------------------------------------------------------------

@register("semi_top_products", sql("""
SELECT * FROM prod WHERE Description IN (
  SELECT Description FROM prod GROUP BY Description ORDER BY sum(Quantity) DESC, Description LIMIT 200)""",
    "products"))
def q_semi_top_products(spark, sf):
    s = RP.products(sales(spark, sf))
    return B.keep_top_items(s, B.top_items(s, "Description", 200), "Description")


_PANEL_SQL = f"""
dailyc AS (
  SELECT Country, CAST(InvoiceDate AS DATE) AS date, sum(Quantity) AS units_sold,
         {MONEY_SUM('TotalPrice')} AS revenue,
         count(DISTINCT InvoiceNo) AS num_invoices, count(DISTINCT CustomerID) AS num_customers
  FROM clean GROUP BY 1, 2
),
featc AS (
  SELECT Country, date, units_sold,
    lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 7) OVER w AS lag_7,
    lag(units_sold, 14) OVER w AS lag_14, lag(units_sold, 28) OVER w AS lag_28,
    CASE WHEN count(units_sold) OVER w7 = 7 THEN avg(units_sold) OVER w7 END AS rolling_mean_7,
    CASE WHEN count(units_sold) OVER w7 = 7 THEN stddev_samp(units_sold) OVER w7 END AS rolling_std_7,
    CASE WHEN count(units_sold) OVER w30 = 30 THEN avg(units_sold) OVER w30 END AS rolling_mean_30,
    CASE WHEN count(units_sold) OVER w30 = 30 THEN stddev_samp(units_sold) OVER w30 END AS rolling_std_30
  FROM dailyc
  WINDOW w AS (PARTITION BY Country ORDER BY date),
         w7 AS (PARTITION BY Country ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w30 AS (PARTITION BY Country ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
)"""


@register("daily_totals_by_country", sql("SELECT * FROM dailyc", "clean", extra=_PANEL_SQL))
def q_daily_totals_by_country(spark, sf):
    return daily_by_country(spark, sf)


@register("panel_features_by_country", sql("""
SELECT * FROM featc WHERE lag_28 IS NOT NULL AND rolling_std_30 IS NOT NULL AND rolling_std_7 IS NOT NULL""",
    "clean", extra=_PANEL_SQL))
def q_panel_features_by_country(spark, sf):
    """Lags and rolling stats per country series (windows partitioned by the
    key, so the work spreads over tasks)."""
    d = daily_by_country(spark, sf)
    out = D.rolling_features(D.lag_features(d, keys=("Country",)), windows=(7, 30), keys=("Country",))
    return out.select("Country", "date", "units_sold", "lag_1", "lag_7", "lag_14", "lag_28",
                      "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30").dropna()


@register("cv_summary")
def q_cv_summary(spark, sf):
    return FC.cv_summary(validation(spark, sf))
