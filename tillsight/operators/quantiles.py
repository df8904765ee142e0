"""Exact quantiles (linear interpolation) as one distributed plan.

Spark's ``percentile`` is exact but merges a value->count map of every
distinct value in a single task, which fails on a high-cardinality column at
scale. Here:

1. rows are reduced to (value, count) per distinct value (hash aggregate
   with map-side combine - a hot value is one row);
2. approximate quantile edges of the distinct values (a bounded sketch, one
   row) split them into ~``buckets`` ranges; a value's bucket is the number
   of edges <= value;
3. per-bucket counts (one row per bucket) give each bucket's rank offset by
   a running sum over that small table;
4. only the buckets holding a target rank are ordered (a window per bucket,
   about distinct/buckets rows each) to find the exact order statistics;
5. quantile = lo + (hi - lo) * frac at position (n - 1) * p, as pandas,
   DuckDB ``quantile_cont`` and Spark ``percentile`` define it.

Nothing is collected to the driver; every intermediate that meets a join is
bounded by the bucket count or the number of probabilities. The
(value, count) table of step 1 is checkpointed, so the input rows are read
once, not once per branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tillsight.functions.scalars import with_scalars
from tillsight.session import materialize


def upper_bound(df: DataFrame, edges: str, value: str, out: str, n_edges: int) -> DataFrame:
    """``out`` = number of elements of the sorted array ``edges`` that are
    <= ``value``: a binary search unrolled into log2(n) projections of
    built-in expressions (codegen'd, no lambda, O(log n) per row)."""
    step = 1
    while step * 2 <= max(n_edges, 1):
        step *= 2
    res = df.withColumn(out, F.lit(0))
    while step >= 1:
        nxt = F.col(out) + step
        res = res.withColumn(out, F.when(
            (nxt <= F.size(edges)) & (F.try_element_at(edges, nxt) <= F.col(value)), nxt)
            .otherwise(F.col(out)))
        step //= 2
    return res


def exact_quantiles(df: DataFrame, cols, probs: Sequence[float], buckets: int = 256,
                    prefix: str | None = None) -> DataFrame:
    """One-row frame of exact quantiles. ``cols`` is one column name or a
    list; the result has ``{col}{prefix}{i}`` (default prefix ``_q``) = the
    ``probs[i]`` quantile of each column (nulls and NaN ignored; null when a
    column has no values). All columns share one plan: values are tagged with
    their column index ``_k`` and every step is keyed by it.

    One plan at every size: distinct values with their counts, range buckets
    by approximate edges, bucket offsets, and an ordering of only those
    buckets that hold a target rank. No task holds all distinct values."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    prefix = "_q" if prefix is None else prefix
    probs = [float(p) for p in probs]
    tagged = df.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("_k"), F.col(c).cast("double").alias("_v")) for k, c in enumerate(cols)])))
    # (column, value, count): one row per distinct value. Every later step
    # reads it two or three times, so it is written once to the shared
    # checkpoint folder; otherwise each branch would re-run the whole input
    # plan (scan, joins, dedupe shuffle) up to this aggregate.
    vc = materialize(tagged.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
                           .groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    cuts = [i / buckets for i in range(1, buckets)]
    sketch = vc.groupBy("_k").agg(F.percentile_approx("_v", cuts, 10 * buckets).alias("_e"),
                                  F.sum("_c").alias("_n"))
    # the sketch has one row per column: a proven-small broadcast
    bucketed = upper_bound(vc.join(F.broadcast(sketch.select("_k", "_e")), "_k"), "_e", "_v", "_b",
                           buckets - 1).drop("_e")
    totals = bucketed.groupBy("_k", "_b").agg(F.sum("_c").alias("_t"))
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(
        Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # target ranks (0-based): floor and ceil of (n - 1) * p for each p
    targets = sketch.select("_k", "_n", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(p).alias("_p")) for i, p in enumerate(probs)])))
    targets = (targets.withColumn("_h", (F.col("_n") - 1) * F.col("_p"))
               .select("_k", "_i", "_h", F.inline(F.array(
                   F.struct(F.lit(0).alias("_side"), F.floor("_h").cast("long").alias("_r")),
                   F.struct(F.lit(1).alias("_side"), F.ceil("_h").cast("long").alias("_r"))))))
    # offsets: one row per (column, bucket) - bounded by buckets x columns
    hit_buckets = (targets.join(F.broadcast(offsets), "_k")
                   .filter((F.col("_o") <= F.col("_r")) & (F.col("_r") < F.col("_o") + F.col("_t")))
                   .select("_k", "_i", "_h", "_side", "_r", "_b", "_o"))
    in_bucket = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    cand = (bucketed.join(F.broadcast(hit_buckets.select("_k", "_b").distinct()), ["_k", "_b"], "left_semi")
                    .withColumn("_before", F.coalesce(F.sum("_c").over(in_bucket), F.lit(0))))
    hits = (cand.join(F.broadcast(hit_buckets), ["_k", "_b"])
                .filter((F.col("_o") + F.col("_before") <= F.col("_r"))
                        & (F.col("_r") < F.col("_o") + F.col("_before") + F.col("_c")))
                .groupBy("_k", "_i", "_h")
                .agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_lo"),
                     F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_hi")))
    val = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    q = hits.select("_k", "_i", F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(val).alias("_q"))
    # always one row, even when a column has no values
    anchor = df.sparkSession.range(1).select(F.lit(-1).alias("_k"), F.lit(-1).alias("_i"),
                                             F.lit(None).cast("double").alias("_q"))
    return (anchor.unionByName(q)
            .agg(*[F.max(F.when((F.col("_k") == k) & (F.col("_i") == i), F.col("_q"))).alias(f"{c}{prefix}{i}")
                   for k, c in enumerate(cols) for i in range(len(probs))]))


def running_total_before(df: DataFrame, order: str, value: str, out: str, by: Sequence[str] = (),
                         buckets: int = 256) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same ``by`` group with
    a smaller ``order`` (``order`` unique within a group), without a window
    over a whole group: rows are range-bucketed by approximate quantile
    edges of ``order`` (one sketch row per group), per-bucket totals give
    bucket offsets (a window over the bucket table), and the running sum is
    finished inside each bucket (a window per (group, bucket))."""
    by = list(by)
    cuts = [i / buckets for i in range(1, buckets)]
    g = df.groupBy(*by) if by else df
    sketch = g.agg(F.percentile_approx(F.col(order).cast("double"), cuts, 10 * buckets).alias("_e"))
    # groups may be many: their tables are broadcast only if the planner finds them small
    joined = df.join(sketch, by) if by else with_scalars(df, sketch)
    bucketed = upper_bound(joined.withColumn("_ov", F.col(order).cast("double")), "_e", "_ov", "_b",
                           buckets - 1).drop("_e", "_ov")
    totals = bucketed.groupBy(*by, "_b").agg(F.sum(value).alias("_bt"))
    offs = totals.select(*by, "_b", F.coalesce(F.sum("_bt").over(
        Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_bo"))
    within = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (bucketed.join(offs if by else F.broadcast(offs), [*by, "_b"])
                    .withColumn(out, F.col("_bo") + F.coalesce(F.sum(value).over(within), F.lit(0)))
                    .drop("_b", "_bo"))
