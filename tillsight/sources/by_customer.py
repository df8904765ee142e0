"""Transactions staged by customer, so that customer work needs no shuffle of
the lines.

Buckets alone would read a hot customer's lines in one task. So customers with
more lines than an even bucket has, fewer of them than buckets, are kept in a
plain table beside the bucketed one. Work on single customers runs on both and
is united: without an exchange on the bucketed side, and with lines combined
before a small shuffle on the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.scalars import with_scalars
from tillsight.session import materialize
from tillsight.sources.files import folder_names

KEY = "CustomerID"


@dataclass
class ByCustomer:
    """``light``: bucketed by customer. ``heavy``: the lines of hot customers."""
    light: DataFrame
    heavy: DataFrame

    def all(self) -> DataFrame:
        return self.light.unionByName(self.heavy)

    def apply(self, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``op`` on both tables, united. It must treat customers one by one:
        what it needs of all lines (a snapshot, a cutoff) comes from ``all``."""
        return op(self.light).unionByName(op(self.heavy))


def heavy_customers(df: DataFrame, buckets: int) -> DataFrame:
    """Customers with more than 1/buckets of all lines, hence fewer than
    ``buckets`` of them."""
    counts = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return with_scalars(counts, total).filter(F.col("_n") * buckets > F.col("_total")).select(KEY)


def write_by_customer(df: DataFrame, path: str, buckets: int | None = None) -> ByCustomer:
    """Stage the identified lines of ``df`` below ``path`` (a new folder), one
    file a bucket. ``buckets`` (default: the shuffle partitions) should give
    buckets of some hundred MB."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = df.filter(F.col(KEY).isNotNull())
    hot = F.broadcast(materialize(heavy_customers(lines, buckets)))
    lines.join(hot, KEY, "left_semi").select(df.columns).write.parquet(f"{path}/heavy")
    (lines.join(hot, KEY, "left_anti").select(df.columns).repartition(buckets, KEY)
     .write.option("path", f"{path}/light-{buckets}").bucketBy(buckets, KEY).saveAsTable(_table_name()))
    return read_by_customer(spark, path)


def read_by_customer(spark: SparkSession, path: str) -> ByCustomer:
    """The tables of ``write_by_customer``, in any session: the bucketed one is
    entered into the session's catalog by its folder."""
    heavy = spark.read.parquet(f"{path}/heavy")
    folder = next(n for n in folder_names(spark, path) if n.startswith("light-"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heavy.schema)
    name = _table_name()
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) "
              f"INTO {folder.removeprefix('light-')} BUCKETS LOCATION '{path}/{folder}'")
    return ByCustomer(spark.table(name), heavy)


def _table_name() -> str:
    return f"by_customer_{uuid.uuid4().hex}"
