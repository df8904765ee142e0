"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Every query runs from the parquet test tables (no shared cache between
queries) and is executed in full with the ``noop`` sink, so the timing is the
whole plan and not a ``collect`` of its result. The fit entries use the
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tillsight.plans import queries as Q  # noqa: E402
from tillsight.session import get_session, materialize  # noqa: E402

HEADLINE = [
    "daily_totals", "daily_features", "customer_features", "rfm_scores",
    "cohort_retention", "churn_dataset", "kpis", "revenue_by_country", "popular_products",
    "top_customers", "top_products_by_segment", "build_baskets", "association_rules",
    "binary_metrics", "regression_metrics", "stream_daily_totals",
]


def fit_queries():
    """
    depth 8; boosted 40 rounds depth 5; k-means k=5 + silhouette)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    from tillsight.ml import forecast as FC
    from tillsight.ml import segments as KS

    def train(spark, sf):
        return materialize(Q.split_features(spark, sf).filter(F.col("split") == "train"))

    def lin(spark, sf):
        m = FC.forecast_linear(train(spark, sf))
        return spark.createDataFrame([(float(m.intercept),)], "x double")

    def forest(spark, sf):
        m = FC.forecast_forest(train(spark, sf), trees=300, depth=8)
        return spark.createDataFrame([(m.getNumTrees,)], "x int")

    def boosted(spark, sf):
        m = FC.forecast_boosted(train(spark, sf), rounds=40, depth=5)
        return spark.createDataFrame([(len(m.trees),)], "x int")

    def kmeans(spark, sf):
        data = materialize(KS.scaled_rfm(Q.customers(spark, sf)))
        m = KMeans(k=5, seed=42, featuresCol="features", predictionCol="cluster").fit(data)
        s = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(m.transform(data))
        return spark.createDataFrame([(float(s),)], "x double")

    def folds(spark, sf):
        return FC.walk_forward_cv(Q.features(spark, sf), FC.forecast_linear)

    return {"walk_forward_cv": folds, "fit_linear": lin, "fit_forest_300": forest, "fit_boosted_40": boosted,
            "fit_kmeans_k5_silhouette": kmeans}


def run(spark, fn, sf):
    t = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session()
    # warm the JVM (class loading, codegen caches) on the smallest tables
    smoke = "/root/testdata/sf0.001"
    if os.path.isdir(smoke):
        run(spark, Q.QUERIES["daily_totals"], smoke)
    times = {}
    # The cleaning chain runs once and is written as a Parquet stage (the
    # reference hands stages over as files too); the analytics read it.
    t = time.perf_counter()
    Q.stage_sales(spark, sf)
    times["stage_sales_clean"] = round(time.perf_counter() - t, 3)
    todo = [(n, Q.QUERIES[n]) for n in HEADLINE] + list(fit_queries().items())
    for name, fn in todo:
        try:
            times[name] = round(run(spark, fn, sf), 3)
        except Exception as e:  # keep going; report the failure
            print(f"{name} failed: {type(e).__name__}: {e}", file=sys.stderr)
            times[name] = None
        spark.catalog.clearCache()
    done = [v for v in times.values() if v is not None]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(done), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))


if __name__ == "__main__":
    main()
