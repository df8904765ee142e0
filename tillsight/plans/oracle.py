"""Independent DuckDB SQL for the correctness gate.

Each query is written from the definition of the operator, as plain SQL over
the pre-registered test tables (``lineitem``, ``orders``, ...). Shared stages
are named CTEs with declared dependencies; ``sql(body, *stages)`` assembles a
self-contained statement with every stage it needs, in dependency order.
"""

from __future__ import annotations


def R(expr: str, d: int) -> str:
    """Round half-even at d places the numpy way: rint(x * 10^d) / 10^d."""
    s = float(10 ** d)
    return f"(round_even(CAST({expr} AS DOUBLE) * {s}::DOUBLE, 0) / {s}::DOUBLE)"


def CENTS(expr: str) -> str:
    return f"CAST(round_even(CAST({expr} AS DOUBLE) * 100.0::DOUBLE, 0) AS BIGINT)"


def MONEY_SUM(expr: str) -> str:
    return f"(CAST(sum({CENTS(expr)}) AS DOUBLE) / 100.0::DOUBLE)"


def DAYS(a: str, b: str) -> str:
    """Whole elapsed 24-hour days from a to b."""
    return f"date_sub('day', {a}, {b})"


STAGES: dict[str, tuple[tuple[str, ...], str]] = {}


def stage(name: str, deps: tuple[str, ...], body: str) -> None:
    STAGES[name] = (deps, body)


stage("raw", (), f"""
raw_base AS (
  SELECT CASE WHEN l_returnflag = 'R' AND l_orderkey % 10 = 0 THEN 'C' ELSE '' END
           || CAST(l_orderkey AS VARCHAR)                                   AS InvoiceNo,
         CAST(l_partkey AS VARCHAR)                                         AS StockCode,
         CASE WHEN (l_orderkey + l_partkey) % 53 = 0 THEN NULL
              WHEN l_linenumber = 1 THEN '  ' || p_name || ' ' || p_brand || ' '
              ELSE p_name || ' ' || p_brand END                             AS Description,
         CASE WHEN l_orderkey % 97 = 0 THEN -l_quantity ELSE l_quantity END AS Quantity,
         CAST(o_orderdate AS TIMESTAMP)
           + to_seconds(CAST((l_orderkey * 7919) % 43200 + 28800 + l_linenumber * 60 AS BIGINT))
                                                                            AS InvoiceDate,
         CASE WHEN l_orderkey % 89 = 0 THEN CAST(0 AS DOUBLE)
              ELSE l_extendedprice / l_quantity END                         AS UnitPrice,
         CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE o_custkey END         AS CustomerID,
         n_name AS Country,
         p_type AS ItemType,
         l_partkey AS _pk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey
),
retail_raw AS (
  SELECT * EXCLUDE (_pk) FROM raw_base
  UNION ALL
  SELECT * EXCLUDE (_pk) FROM raw_base WHERE _pk % 50 = 0
)""")

stage("dedup", ("raw",), "dedup AS (SELECT DISTINCT * FROM retail_raw)")
stage("nodesc", ("dedup",), r"""
nodesc AS (
  SELECT * REPLACE (regexp_replace(Description, '^\s+|\s+$', '', 'g') AS Description)
  FROM dedup WHERE Description IS NOT NULL
)""")
stage("nocancel", ("nodesc",), """
nocancel AS (SELECT * FROM nodesc WHERE InvoiceNo IS NULL OR NOT starts_with(InvoiceNo, 'C'))""")
stage("qtyok", ("nocancel",), "qtyok AS (SELECT * FROM nocancel WHERE Quantity > 0)")
stage("priceok", ("qtyok",), "priceok AS (SELECT * FROM qtyok WHERE UnitPrice > 0)")
stage("bounds", ("priceok",), """
bounds AS (
  SELECT quantile_cont(Quantity, 0.01) AS q_lo, quantile_cont(Quantity, 0.99) AS q_hi,
         quantile_cont(UnitPrice, 0.01) AS p_lo, quantile_cont(UnitPrice, 0.99) AS p_hi
  FROM priceok
)""")
stage("clean", ("bounds",), f"""
capped AS (
  SELECT InvoiceNo, StockCode, Description,
         least(greatest(Quantity, q_lo), q_hi) AS Quantity,
         InvoiceDate,
         least(greatest(UnitPrice, p_lo), p_hi) AS UnitPrice,
         CustomerID, Country, ItemType
  FROM priceok CROSS JOIN bounds
),
clean AS (SELECT *, {R('Quantity * UnitPrice', 2)} AS TotalPrice FROM capped)""")

stage("daily", ("clean",), f"""
daily AS (
  SELECT CAST(InvoiceDate AS DATE) AS date,
         sum(Quantity) AS units_sold,
         {MONEY_SUM('TotalPrice')} AS revenue,
         count(DISTINCT InvoiceNo) AS num_invoices,
         count(DISTINCT CustomerID) AS num_customers
  FROM clean GROUP BY 1
)""")

stage("features", ("daily",), f"""
feat0 AS (
  SELECT *,
    CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
    CAST(day(date) AS INTEGER) AS day_of_month,
    CAST(month(date) AS INTEGER) AS month,
    CAST(year(date) AS INTEGER) AS year,
    CAST(weekofyear(date) AS INTEGER) AS week_of_year,
    CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
    CAST(day(date) = 1 AS INTEGER) AS is_month_start,
    CAST(date = last_day(date) AS INTEGER) AS is_month_end,
    coalesce({R('revenue / nullif(num_invoices, 0)', 2)}, 0.0) AS avg_order_value,
    lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 7) OVER w AS lag_7,
    lag(units_sold, 14) OVER w AS lag_14, lag(units_sold, 28) OVER w AS lag_28,
    CASE WHEN count(units_sold) OVER w7 = 7 THEN avg(units_sold) OVER w7 END AS rolling_mean_7,
    CASE WHEN count(units_sold) OVER w7 = 7 THEN stddev_samp(units_sold) OVER w7 END AS rolling_std_7,
    CASE WHEN count(units_sold) OVER w14 = 14 THEN avg(units_sold) OVER w14 END AS rolling_mean_14,
    CASE WHEN count(units_sold) OVER w14 = 14 THEN stddev_samp(units_sold) OVER w14 END AS rolling_std_14,
    CASE WHEN count(units_sold) OVER w30 = 30 THEN avg(units_sold) OVER w30 END AS rolling_mean_30,
    CASE WHEN count(units_sold) OVER w30 = 30 THEN stddev_samp(units_sold) OVER w30 END AS rolling_std_30
  FROM daily
  WINDOW w AS (ORDER BY date),
         w7 AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w14 AS (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
         w30 AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
),
features AS (
  SELECT * FROM feat0
  WHERE lag_28 IS NOT NULL AND rolling_std_30 IS NOT NULL AND rolling_std_14 IS NOT NULL
    AND rolling_std_7 IS NOT NULL AND lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
)""")

_INV = """
  SELECT CustomerID, InvoiceNo, min(InvoiceDate) AS invoice_date, max(InvoiceDate) AS last_line,
         sum({cents}) AS value_cents, count(DISTINCT StockCode) AS basket_size
  FROM {src} GROUP BY CustomerID, InvoiceNo"""
_CAGG = """
  SELECT CustomerID,
         max(CASE WHEN InvoiceNo IS NOT NULL THEN invoice_date END) AS last_invoice,
         min(invoice_date) AS first_line, max(last_line) AS last_line,
         count(InvoiceNo) AS frequency,
         sum(CASE WHEN InvoiceNo IS NOT NULL THEN value_cents END) AS value_cents,
         avg(CASE WHEN InvoiceNo IS NOT NULL THEN basket_size END) AS avg_basket
  FROM {src} GROUP BY CustomerID"""

stage("customers", ("clean",), f"""
ident AS (SELECT * FROM clean WHERE CustomerID IS NOT NULL AND CustomerID <> 0),
snap AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snap FROM ident),
inv AS ({_INV.format(cents=CENTS('TotalPrice'), src='ident')}),
cagg AS ({_CAGG.format(src='inv')}),
cust0 AS (
  SELECT CustomerID, {DAYS('last_invoice', 'snap')} AS recency, frequency,
         {R('value_cents / 100.0', 2)} AS monetary,
         {R('avg_basket', 1)} AS avg_basket_size,
         {R(f"greatest({DAYS('first_line', 'last_line')} / 30.0, 1.0)", 1)} AS active_months
  FROM cagg CROSS JOIN snap
),
cust1 AS (SELECT *, {R('frequency / active_months', 2)} AS purchase_frequency_per_month FROM cust0),
customer_features AS (
  SELECT *, {R(f"{R('monetary / frequency', 2)} * purchase_frequency_per_month * active_months", 2)}
            AS clv_simple
  FROM cust1
)""")

stage("rfm", ("customers",), """
rk AS (
  SELECT *, row_number() OVER (ORDER BY recency, CustomerID) AS rr,
            row_number() OVER (ORDER BY frequency, CustomerID) AS rf,
            row_number() OVER (ORDER BY monetary, CustomerID) AS rm,
            greatest(count(*) OVER () - 1, 1) AS nm1
  FROM customer_features
),
rfm0 AS (
  SELECT * EXCLUDE (rr, rf, rm, nm1),
    CAST(6 - greatest(1, (5 * (rr - 1) + nm1 - 1) // nm1) AS INTEGER) AS R_score,
    CAST(greatest(1, (5 * (rf - 1) + nm1 - 1) // nm1) AS INTEGER) AS F_score,
    CAST(greatest(1, (5 * (rm - 1) + nm1 - 1) // nm1) AS INTEGER) AS M_score
  FROM rk
),
rfm AS (SELECT *, CAST(R_score + F_score + M_score AS INTEGER) AS RFM_score FROM rfm0)""")

stage("segments", ("rfm",), """
seg0 AS (SELECT *, CAST(R_score - 1 AS INTEGER) AS cluster FROM rfm),
cmeans AS (SELECT cluster, avg(RFM_score) AS m FROM seg0 GROUP BY cluster),
crank AS (SELECT cluster, row_number() OVER (ORDER BY m DESC, cluster) - 1 AS i,
                 count(*) OVER () AS n FROM cmeans),
cnames AS (SELECT * FROM (VALUES (0, 'Champions'), (1, 'Loyal Customers'), (2, 'Big Spenders'),
                                 (3, 'Potential Loyalists'), (4, 'At Risk'), (5, 'Lost Customers'))
           t(i, name)),
labels AS (SELECT cluster, CASE WHEN n <= 6 THEN name ELSE 'Segment ' || CAST(i AS VARCHAR) END
                  AS segment FROM crank LEFT JOIN cnames USING (i)),
segments AS (SELECT seg0.*, labels.segment FROM seg0 LEFT JOIN labels USING (cluster))""")

stage("churn", ("clean",), f"""
cid AS (SELECT * FROM clean WHERE CustomerID IS NOT NULL),
cut AS (SELECT max(InvoiceDate) - INTERVAL 90 DAY AS cutoff FROM cid),
bef AS (SELECT cid.* FROM cid CROSS JOIN cut WHERE InvoiceDate < cutoff),
ret AS (SELECT DISTINCT CustomerID FROM cid CROSS JOIN cut WHERE InvoiceDate >= cutoff),
binv AS ({_INV.format(cents=CENTS('TotalPrice'), src='bef')}),
bagg AS ({_CAGG.format(src='binv')}),
churn AS (
  SELECT CustomerID, {DAYS('last_invoice', 'cutoff')} AS recency, frequency,
         {R('value_cents / 100.0', 2)} AS monetary,
         {R('avg_basket', 1)} AS avg_basket_size,
         {R(f"frequency / greatest({DAYS('first_line', 'last_line')} / 30.0, 1.0)", 2)}
           AS purchase_frequency_per_month,
         CASE WHEN CustomerID IN (SELECT CustomerID FROM ret) THEN 0 ELSE 1 END AS churned
  FROM bagg CROSS JOIN cut
)""")

stage("cohorts", ("clean",), f"""
pairs AS (SELECT DISTINCT CustomerID, CAST(date_trunc('month', InvoiceDate) AS DATE) AS order_month
          FROM clean WHERE CustomerID IS NOT NULL),
coh AS (SELECT *, min(order_month) OVER (PARTITION BY CustomerID) AS cohort FROM pairs),
cl AS (SELECT strftime(cohort, '%Y-%m') AS cohort_month,
              CAST((year(order_month) * 12 + month(order_month))
                   - (year(cohort) * 12 + month(cohort)) AS INTEGER) AS period_number,
              count(*) AS customers
       FROM coh GROUP BY ALL),
cohort_long AS (
  SELECT *, {R('customers / max(CASE WHEN period_number = 0 THEN customers END) OVER (PARTITION BY cohort_month)', 4)}
            * 100.0 AS retention
  FROM cl
)""")

stage("products", ("clean",), r"""
prod AS (SELECT * FROM clean WHERE Description IS NOT NULL
         AND regexp_replace(Description, '^\s+|\s+$', '', 'g') <> '')""")


def _resolve(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in STAGES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *stages: str, extra: str = "") -> str:
    """A full statement: WITH <stages in dependency order> [, extra] <body>."""
    parts = [STAGES[s][1].strip() for s in _resolve(stages)]
    if extra:
        parts.append(extra.strip())
    return ("WITH " + ",\n".join(parts) + "\n" + body.strip()) if parts else body.strip()


def with_stages(upto: str, body: str, extra: str = "") -> str:
    return sql(body, upto, extra=extra)
