"""Segment labelling and per-segment product rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.operators.reporting import products
from tillsight.schema import SEGMENT_LABELS
from tillsight.session import materialize


def score_clusters(scored: DataFrame) -> DataFrame:
    """Deterministic clusters from the R score (cluster = R_score - 1).

    A rule-based segmentation that needs no fit; it is also the fixed input
    the SQL oracle uses to check the labelling and segment operators without
    depending on a k-means run."""
    return scored.withColumn("cluster", (F.col("R_score") - 1).cast("int"))


def label_clusters(df: DataFrame, labels=SEGMENT_LABELS) -> DataFrame:
    """Cluster -> name table: clusters ranked by mean RFM_score (best first,
    ties by cluster id) take names from ``labels`` in order; with more
    clusters than names every cluster is 'Segment i' (i = rank - 1).

    The table has one row per cluster; it is built by an aggregate plus a
    window over that small aggregate."""
    spark = df.sparkSession
    means = df.groupBy("cluster").agg(F.avg("RFM_score").alias("_m"))
    ranked = means.withColumn("_i", F.row_number().over(
        Window.orderBy(F.desc("_m"), F.asc("cluster"))) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    names = spark.createDataFrame(list(enumerate(labels)), "_i int, _name string")
    return (ranked.withColumn("_n", n).join(F.broadcast(names), "_i", "left")
                  .select("cluster", F.when(F.col("_n") <= len(labels), F.col("_name"))
                                      .otherwise(F.concat(F.lit("Segment "), F.col("_i").cast("string")))
                                      .alias("segment")))


def map_labels(df: DataFrame, label_table: DataFrame) -> DataFrame:
    """Attach the segment name by cluster id (the label table is one row per
    cluster, a bounded broadcast)."""
    return df.join(F.broadcast(label_table), "cluster", "left")


def segment_customers(scored: DataFrame) -> DataFrame:
    """Scored customers with a rule cluster and its name. The scores are read
    twice (label means, join), so they are written first: their ranks run once."""
    clustered = materialize(score_clusters(scored))
    return map_labels(clustered, label_clusters(clustered))


def join_segments(df: DataFrame, seg: DataFrame) -> DataFrame:
    """Transactions of segmented customers with their segment (inner join).

    The customer table grows with the data, so no broadcast hint: the
    planner broadcasts it only under the size threshold and otherwise uses a
    shuffled join (AQE can still switch at run time)."""
    return df.join(seg.select("CustomerID", "segment"), "CustomerID", "inner")


def top_products_by_segment(df: DataFrame, seg: DataFrame, n: int = 5) -> DataFrame:
    """Best ``n`` products by units in each segment.

    Units are summed per (customer, product) before the join, so a customer
    holding a third of all lines reaches the join as #products rows; after
    the join they are summed per (segment, product) and the per-segment
    window runs over #products rows (Spark adds a partial
    ``WindowGroupLimit`` before its shuffle)."""
    per_cust = products(df).groupBy("CustomerID", "Description").agg(F.sum("Quantity").alias("_q"))
    per = (join_segments(per_cust, seg)
           .groupBy("segment", "Description").agg(F.sum("_q").alias("Quantity")))
    w = Window.partitionBy("segment").orderBy(F.desc("Quantity"), F.asc("Description"))
    return per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
