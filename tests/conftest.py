import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tillsight.session import BASE_CONF

    b = (SparkSession.builder.master("local[*]").appName("tillsight-tests")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(autouse=True, scope="session")
def small_models():
    """What the suite checks about fitted models (folds, reloads, sums of
    attributions) holds at any size; the registered sizes take minutes."""
    from tillsight.ml import forecast as FC
    from tillsight.plans import queries as Q

    Q.MODELS.update(FC.default_models(trees=20, rounds=5))


TX_SCHEMA = ("InvoiceNo string, StockCode string, Description string, Quantity double, "
             "InvoiceDate timestamp_ntz, UnitPrice double, CustomerID long, Country string")


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def tx(spark):
    """Build a typed transaction frame from tuples
    (invoice, stock, desc, qty, 'YYYY-mm-dd HH:MM', price, customer, country)."""
    def make(rows):
        return spark.createDataFrame(
            [(r[0], r[1], r[2], float(r[3]) if r[3] is not None else None, ts(r[4]),
              float(r[5]) if r[5] is not None else None, r[6], r[7]) for r in rows], TX_SCHEMA)
    return make
