"""Market-basket analysis: baskets, frequent itemsets, association rules.

Frequent itemsets come from MLlib's parallel FP-growth. Rules are generated
as DataFrame jobs that grow consequents item by item, and the two supports are
looked up by joining on the sorted item array. This yields
rules with multi-item consequents too, which ``FPGrowthModel.associationRules``
does not.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.operators.reporting import products
from tillsight.schema import MIN_CONFIDENCE, MIN_SUPPORT, TOP_N_PRODUCTS_FOR_RULES
from tillsight.session import materialize


def top_items(df: DataFrame, item: str = "Description", n: int = TOP_N_PRODUCTS_FOR_RULES) -> DataFrame:
    """The ``n`` items with the most units (ties by name). At most n rows."""
    return (products(df) if item == "Description" else df.filter(F.col(item).isNotNull())) \
        .groupBy(item).agg(F.sum("Quantity").alias("_q")) \
        .orderBy(F.desc("_q"), F.asc(item)).limit(n).select(item)


def keep_top_items(df: DataFrame, top: DataFrame, item: str = "Description") -> DataFrame:
    """Rows whose item is in ``top`` (a left semi join; ``top`` has at most
    n rows, a proven bound, so it is broadcast)."""
    return df.join(F.broadcast(top), item, "left_semi")


def build_baskets(df: DataFrame, item: str = "Description",
                  top_n: int | None = TOP_N_PRODUCTS_FOR_RULES) -> DataFrame:
    """One row per invoice: sorted distinct items, only baskets with more
    than one item. Each basket holds at most ``top_n`` distinct items."""
    src = products(df) if item == "Description" else df.filter(F.col(item).isNotNull())
    if top_n is not None:
        src = keep_top_items(src, top_items(df, item, top_n), item)
    return (src.filter(F.col("InvoiceNo").isNotNull())
               .groupBy("InvoiceNo").agg(F.array_sort(F.collect_set(item)).alias("items"))
               .filter(F.size("items") > 1))


def _min_count(n: int, min_support: float) -> int:
    """Smallest count c with c / n >= min_support in double arithmetic."""
    c = max(int(math.floor(min_support * n)) - 1, 0)
    while n and c / n < min_support:
        c += 1
    return c


def frequent_itemsets(baskets: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(items sorted, freq, support) of every itemset with support >=
    min_support of the given baskets.

    FP-growth's own threshold is ceil(minSupport * n), which rounding can
    push one above the exact one; it is run with a threshold just below and
    the exact test is applied afterwards. The baskets are written once, so
    the count and the FP-growth passes do not rebuild them from the
    transactions, and no executor storage is held afterwards."""
    baskets = materialize(baskets)
    n = baskets.count()
    schema = "items array<string>, freq bigint, support double"
    if n == 0:
        return baskets.sparkSession.createDataFrame([], schema)
    c = max(_min_count(n, min_support), 1)
    model = FPGrowth(itemsCol="items", minSupport=(c - 0.5) / n, minConfidence=1.0).fit(baskets)
    return (model.freqItemsets
            .select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
            .withColumn("support", F.col("freq") / F.lit(float(n)))
            .filter(F.col("support") >= F.lit(min_support)))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedents, consequents ("a, b" text), support, confidence, lift for
    every split of every frequent itemset with confidence >= threshold.

    support = supp(A u C), confidence = supp(A u C) / supp(A),
    lift = confidence / supp(C). No itemsets -> empty table. Sorted by falling
    confidence, then support (ties by the two texts).

    Consequents grow item by item: confidence cannot rise as items move from
    the antecedent to the consequent, so only consequents that reach the
    threshold are extended, and the work follows the rules found instead of
    the 2^k splits of a large itemset."""
    sup = itemsets.select("items", "support")
    ante = sup.withColumnsRenamed({"items": "_a", "support": "_sa"})

    def confident(splits):
        return (splits.withColumn("_a", F.array_except("items", "_c")).filter(F.size("_a") > 0).join(ante, "_a")
                .withColumn("confidence", F.col("support") / F.col("_sa")).filter(F.col("confidence") >= F.lit(min_confidence)))

    cols = ["items", "support", "_c", "_last", "_a", "confidence"]
    multi = itemsets.filter(F.size("items") >= 2).select("items", "support")
    found = [materialize(confident(multi.select("*", F.posexplode("items").alias("_last", "_i"))
                                   .withColumn("_c", F.array("_i"))).select(cols))]
    while not found[-1].isEmpty():
        longer = found[-1].select("items", "support", "_c", F.col("_last").alias("_before")).select(
            "*", F.posexplode("items").alias("_last", "_i")).filter("_last > _before")
        found.append(materialize(confident(longer.withColumn("_c", F.array_append("_c", F.col("_i")))).select(cols)))
    rules = found[0]
    for more in found[1:-1]:
        rules = rules.unionByName(more)
    rules = (rules.join(sup.withColumnsRenamed({"items": "_c", "support": "_sc"}), "_c")
                  .withColumn("lift", F.col("confidence") / F.col("_sc")))
    return rules.select(F.array_join("_a", ", ").alias("antecedents"),
                        F.array_join("_c", ", ").alias("consequents"),
                        "support", "confidence", "lift").orderBy(
        F.desc("confidence"), F.desc("support"), "antecedents", "consequents")


def filter_rules(rules: DataFrame, min_confidence: float) -> DataFrame:
    return rules.filter(F.col("confidence") >= F.lit(min_confidence))
