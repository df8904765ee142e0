"""Cleaning rules on hand-made edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillsight.operators import clean as C
from tillsight.sources import files as FS


def test_missing_description_and_strip(tx):
    df = tx([("1", "A", None, 1, "2020-01-01 10:00", 1.0, 1, "X"),
             ("2", "A", "\t  padded\t", 1, "2020-01-01 10:00", 1.0, 1, "X"),
             ("3", "A", " \t ", 1, "2020-01-01 10:00", 1.0, 1, "X")])
    out = {r.InvoiceNo: r.Description for r in C.drop_missing_description(df).collect()}
    assert out == {"2": "padded", "3": ""}


def test_cancelled_is_case_sensitive_and_keeps_null(tx):
    df = tx([("C1", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X"),
             ("c2", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X"),
             (None, "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X")])
    kept = sorted(str(r.InvoiceNo) for r in C.drop_cancelled(df).collect())
    assert kept == ["None", "c2"]


def test_quantity_price_filters_drop_nulls(tx):
    df = tx([("1", "A", "a", 0, "2020-01-01 10:00", 1.0, 1, "X"),
             ("2", "A", "a", None, "2020-01-01 10:00", 1.0, 1, "X"),
             ("3", "A", "a", 2, "2020-01-01 10:00", None, 1, "X"),
             ("4", "A", "a", 2, "2020-01-01 10:00", 0.5, 1, "X")])
    out = df.transform(C.drop_invalid_quantity).transform(C.drop_invalid_price)
    assert [r.InvoiceNo for r in out.collect()] == ["4"]


def test_duplicates_null_equals_null(tx):
    row = ("1", "A", None, 1, "2020-01-01 10:00", 1.0, None, "X")
    df = tx([row, row, ("1", "A", None, 1, "2020-01-01 10:00", 1.0, 7, "X")])
    assert C.drop_duplicates(df).count() == 2


def test_convert_types_from_text(spark):
    df = spark.createDataFrame(
        [("1", 5, "a", 1.0, "2010-12-01 08:26:00", 2.5, "12345.0", "UK"),
         ("2", 6, "b", 1.0, "12/1/2010 8:26", 2.5, "abc", "UK")],
        "InvoiceNo string, StockCode int, Description string, Quantity double, "
        "InvoiceDate string, UnitPrice double, CustomerID string, Country string")
    out = C.convert_types(df).collect()
    assert out[0].CustomerID == 12345 and out[1].CustomerID is None
    assert out[0].StockCode == "5"
    assert str(out[0].InvoiceDate) == "2010-12-01 08:26:00" == str(out[1].InvoiceDate)


def test_winsorize_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    vals = [float(x) for x in np.random.default_rng(1).integers(-50, 500, 333)]
    df = spark.createDataFrame([(v, v * 2) for v in vals], "Quantity double, UnitPrice double")
    got = sorted(r.Quantity for r in C.winsorize(df).collect())
    s = pd.Series(vals)
    lo, hi = s.quantile([0.01, 0.99])
    assert got == sorted(s.clip(lo, hi).tolist())


def test_total_price_half_even(spark):
    df = spark.createDataFrame([(1.0, 0.125), (1.0, 0.135), (3.0, 1.005)], "Quantity double, UnitPrice double")
    got = [r.TotalPrice for r in C.add_total_price(df).collect()]
    import numpy as np
    assert got == [float(np.round(q * p, 2)) for q, p in [(1.0, 0.125), (1.0, 0.135), (3.0, 1.005)]]


def test_audit_counts_first_failed_rule(tx):
    dup = ("1", "A", "a", 1, "2020-01-01 10:00", 1.0, 1, "X")
    df = tx([dup, dup, dup,
             ("2", "A", None, -1, "2020-01-01 10:00", 0.0, 1, "X"),   # description first
             ("C3", "A", "a", -1, "2020-01-01 10:00", 1.0, 1, "X"),   # cancelled first
             ("4", "A", "a", 1, "2020-01-01 10:00", 0.0, 1, "X")])    # price
    got = {r.rule: r.rows for r in C.cleaning_audit(df).collect()}
    assert got == {"duplicate": 2, "missing_description": 1, "cancelled": 1, "invalid_price": 1,
                   "kept": 1}


def test_normalize_columns_aliases_and_unknown(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7, 8, 9)],
                               ["Invoice", " StockCode", "Description", "Quantity", "InvoiceDate",
                                "Price", "Customer ID", "COUNTRY", " extra "])
    out = FS.normalize_columns(df).columns
    assert out == ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
                   "CustomerID", "Country", "extra"]
    with pytest.raises(ValueError, match="missing"):
        FS.check_columns(df.drop("Price"))


def test_csv_round_trip_latin1(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_bytes("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
                  "536365,85123A,CAFÉ MUG ,6,2010-12-01 08:26:00,2.50,17850.0,France\n"
                  "536365,85123A,CAFÉ MUG ,6,2010-12-01 08:26:00,2.5,17850,France\n"
                  .encode("latin-1"))
    raw = FS.read_transactions(spark, str(p))
    rows = C.drop_duplicates(raw).collect()
    assert len(rows) == 1          # numbers are typed before the dedupe
    r = rows[0]
    assert r.Description == "CAFÉ MUG " and r.UnitPrice == 2.5 and r.CustomerID == 17850
    assert C.clean_sales(raw).select(F.col("Description")).first()[0] == "CAFÉ MUG"


def test_staged_and_checkpointed_sales_equal_clean_sales(spark):
    """The split chain (rows written once, bounds from the written rows,
    clip on read) gives the same table as the one-plan ``clean_sales``."""
    from conftest import SF_SMALL

    from tillsight.plans import queries as Q

    cols = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
            "CustomerID", "Country", "ItemType", "TotalPrice"]
    want = C.clean_sales(Q.raw(spark, SF_SMALL)).select(*cols)
    for got in (Q.sales(spark, SF_SMALL).select(*cols), Q.sales(spark, SF_SMALL).select(*cols)):
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stage_scan_is_pruned(spark):
    from conftest import SF_SMALL

    from tillsight.operators import reporting as RP
    from tillsight.plans import queries as Q

    def plan(df):
        spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
        try:
            return df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.maxMetadataStringLength")

    p = plan(Q.QUERIES["filter_transactions"](spark, SF_SMALL))
    assert "FileScan parquet" in p and "EqualTo(Country,NATION_7)" in p and "GreaterThanOrEqual(InvoiceDate" in p
    assert "ReadSchema: struct<Country:string>" in plan(RP.country_list(Q.sales(spark, SF_SMALL)))


def test_read_transactions_quotes_breaks_orders_and_null_words(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes(b'Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\r\n'
                  b'1,10,"ASSORTED ""LEIS"", RED",6,2010-12-01T08:26:00,2.5,17850.0,UK\r\n'
                  b'2,11,"TWO\nLINES",1,01-Dec-2010 08:26,1.0,NA,UK\r\n')
    b.write_bytes(b'StockCode,Invoice,Price,Quantity,Description,InvoiceDate,Customer ID,Country\n'
                  b'12,3,4.5,2,NA,2010-12-01 08:26:00.250,null,UK\n')
    got = {r.InvoiceNo: r for r in C.convert_types(FS.read_transactions(spark, [str(a), str(b)])).collect()}
    assert got["1"].Description == 'ASSORTED "LEIS", RED' and got["1"].Quantity == 6 and got["1"].CustomerID == 17850
    assert got["2"].Description == "TWO\nLINES" and got["2"].CustomerID is None
    assert (got["3"].StockCode, got["3"].UnitPrice, got["3"].Quantity, got["3"].Description) == ("12", 4.5, 2, None)
    at = dt.datetime(2010, 12, 1, 8, 26)
    assert [got[i].InvoiceDate for i in "123"] == [at, at, at + dt.timedelta(milliseconds=250)]


def test_dates_that_do_not_parse(spark):
    rows = spark.createDataFrame([("1", "7", "12/1/2010 8:26"), ("1", "7", " "), ("1", "7", None)],
                                 "StockCode string, CustomerID string, InvoiceDate string")
    at = dt.datetime(2010, 12, 1, 8, 26)
    assert [r.InvoiceDate for r in C.convert_types(rows).collect()] == [at, None, None]
    bad = rows.limit(1).withColumn("InvoiceDate", F.lit("soon"))
    assert C.convert_types(bad, strict_dates=False).first().InvoiceDate is None
    with pytest.raises(Exception, match="InvoiceDate is no date: soon"):
        C.convert_types(bad).collect()
