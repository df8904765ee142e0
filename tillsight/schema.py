"""Declared schemas and fixed values of the transaction model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: canonical column names and accepted header aliases -------
# Keys are the header text after strip + lowercase; values are canonical names.
COLUMN_ALIASES = {
    "invoice": "InvoiceNo",
    "invoiceno": "InvoiceNo",
    "stockcode": "StockCode",
    "description": "Description",
    "quantity": "Quantity",
    "invoicedate": "InvoiceDate",
    "price": "UnitPrice",
    "unitprice": "UnitPrice",
    "customerid": "CustomerID",
    "customer id": "CustomerID",
    "country": "Country",
}

REQUIRED_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity",
                    "InvoiceDate", "UnitPrice", "CustomerID", "Country")

# --- fixed values: model parameters of the analyses --------------------------
LAGS = (1, 7, 14, 28)
ROLLING_WINDOWS = (7, 14, 30)
TEST_DAYS = 60
HOLDOUT_DAYS = 90
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.2
TOP_N = 20
TOP_N_PRODUCTS_FOR_RULES = 200
SEGMENT_LABELS = ("Champions", "Loyal Customers", "Big Spenders",
                  "Potential Loyalists", "At Risk", "Lost Customers")
RISK_BINS = ((-0.01, 0.3, "Low"), (0.3, 0.6, "Medium"), (0.6, 1.0, "High"))
RFM_COLS = ("recency", "frequency", "monetary")
CHURN_FEATURES = ("recency", "frequency", "monetary", "avg_basket_size",
                  "purchase_frequency_per_month")
FORECAST_FEATURES = (
    "day_of_week", "day_of_month", "month", "year", "week_of_year",
    "is_weekend", "is_month_start", "is_month_end",
    "lag_1", "lag_7", "lag_14", "lag_28",
    "rolling_mean_7", "rolling_std_7",
    "rolling_mean_14", "rolling_std_14",
    "rolling_mean_30", "rolling_std_30",
)
TARGET = "units_sold"

# --- declared target schema of a transaction line ----------------------------
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), True),
    T.StructField("StockCode", T.StringType(), True),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.DoubleType(), True),
    T.StructField("InvoiceDate", T.TimestampNTZType(), True),
    T.StructField("UnitPrice", T.DoubleType(), True),
    T.StructField("CustomerID", T.LongType(), True),
    T.StructField("Country", T.StringType(), True),
])

# Texts that a CSV field may hold for null (fixed values of the pandas reader).
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
