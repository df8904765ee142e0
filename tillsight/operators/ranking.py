"""Exact global rank without a single-partition window, and RFM scores.

``row_number().over(Window.orderBy(v))`` moves every row into one task. The
rank here is built from range buckets instead:

1. approximate quantile edges of ``v`` (a bounded sketch, one small job);
2. an edge value that repeats is a heavy value: it gets a bucket of its own,
   split further by id ranges (ties are ordered by id, so the split keeps the
   order);
3. rows are bucketed with ``Bucketizer`` (binary search, JVM side), counted
   per bucket, and the running offset of each bucket is a window over the
   bucket table (its size is the number of buckets, not rows);
4. rank = bucket offset + ``row_number`` inside the bucket.

Every step is a DataFrame job; the driver only sees the edge lists.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.scalars import ceil_div
from tillsight.session import materialize


#: Rows that one bucket sorts, about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 64


def _edges(df: DataFrame, exprs: dict, n: int, accuracy: int = 100000) -> dict:
    """Approximate quantile edges (n - 1 cut points) of several expressions
    in one aggregate job. Returns {name: [edges]}; bounded by ``n``."""
    probs = [i / n for i in range(1, n)]
    if not probs or not exprs:
        return {k: [] for k in exprs}
    row = df.agg(*[F.percentile_approx(e.cast("double"), probs, max(accuracy, 10 * n)).alias(k)
                   for k, e in exprs.items()]).first()
    return {k: [x for x in (row[k] or []) if x is not None] for k in exprs}


def _plan(edges: list) -> tuple[list, list]:
    heavy = sorted(e for e, n in Counter(edges).items() if n > 1)
    splits = sorted(set(edges) | {math.nextafter(e, math.inf) for e in heavy})
    return heavy, [-math.inf] + ([s for s in splits if math.isfinite(s)] or [0.0]) + [math.inf]


def rank_edges(df: DataFrame, values: list, key: str, buckets: int | None = None) -> dict:
    """Bucket plans for ranking ``df`` by each of ``values`` (ties by key):
    {value: (heavy values, value splits, key splits)}. Two small jobs in all:
    one for the value edges, one for the key edges inside heavy values. The
    number of buckets follows the rows unless it is given."""
    buckets = buckets or max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    vedges = _edges(df, {v: F.col(v) for v in values}, buckets)
    plans = {v: _plan(vedges[v]) for v in values}
    need = {v: F.when(F.col(v).cast("double").isin(plans[v][0]), F.col(key))
            for v in values if plans[v][0]}
    kedges = _edges(df, need, buckets) if need else {}
    out = {}
    for v in values:
        ks = sorted(set(kedges.get(v, [])))
        out[v] = (plans[v][0], plans[v][1],
                  [-math.inf] + [s for s in ks if math.isfinite(s)] + [math.inf])
    return out


def global_rank(df: DataFrame, value: str, key: str, out: str = "rank",
                buckets: int | None = None, plan: tuple | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in (value, key) order.

    Ties on ``value`` are broken by ``key`` ascending (``key`` must be
    unique). Values must be non-null. ``plan`` comes from ``rank_edges``
    (computed here when not given)."""
    heavy, splits, key_splits = plan or rank_edges(df, [value], key, buckets)[value]
    base = df.withColumn("_v", F.col(value).cast("double"))
    out_df = Bucketizer(splits=splits, inputCol="_v", outputCol="_bv").transform(base)
    if heavy:
        out_df = (Bucketizer(splits=key_splits, inputCol="_k", outputCol="_bk")
                  .transform(out_df.withColumn("_k", F.col(key).cast("double")))
                  .withColumn("_bk", F.when(F.col("_v").isin(heavy), F.col("_bk"))
                                      .otherwise(F.lit(0.0)))
                  .drop("_k"))
    else:
        out_df = out_df.withColumn("_bk", F.lit(0.0))
    counts = out_df.groupBy("_bv", "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    # The bucket table has one row per bucket: a bounded, proven-small side.
    offs = (counts.withColumn("_off", F.sum("_cnt").over(
                Window.orderBy("_bv", "_bk").rowsBetween(Window.unboundedPreceding, -1)))
                  .select("_bv", "_bk", F.coalesce(F.col("_off"), F.lit(0)).alias("_off")))
    w = Window.partitionBy("_bv", "_bk").orderBy("_v", key)
    return (out_df.join(F.broadcast(offs), ["_bv", "_bk"])
                  .withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("long"))
                  .drop("_v", "_bv", "_bk", "_off"))


def quintile_from_rank(rank: F.Column, n: F.Column) -> F.Column:
    """Equal-count bin 1..5 of a unique rank in 1..n, as ``qcut`` on ranks:
    bin = max(1, ceil(5 (r - 1) / (n - 1))); n = 1 gives bin 1."""
    raw = ceil_div((rank - 1) * 5, F.greatest(n - 1, F.lit(1)))
    return F.greatest(F.lit(1), raw).cast("int")


def rank_cuts(df: DataFrame, cols: list, key: str, ranks: list, buckets: int | None = None) -> dict:
    """{column: [(value, key) of the row at each 1-based rank]} in (value, key)
    order, without ordering the table.

    Approximate edges split a column's values into points (an edge itself) and
    the intervals between; their counts tell which one holds a rank. A point
    that many rows share is split the same way by ``key``. Only the rows of the
    last interval of each rank (rows / edges, about) are ordered. The driver
    sees edges, their counts and the cuts."""
    buckets = buckets or max(4 * LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))

    def place(rows, value, edges, out):
        # odd buckets are points [e, next double), even ones the intervals between
        splits = [-math.inf]
        for e in edges:
            if e > splits[-1] and math.isfinite(e):
                splits += [e, math.nextafter(e, math.inf)]
        rows = rows.withColumn("_x", F.coalesce(value.cast("double"), F.lit(0.0)))
        return Bucketizer(splits=[*splits, math.inf], inputCol="_x", outputCol=out).transform(rows).withColumn(
            out, F.col(out).cast("int")).drop("_x")

    def counts(rows, names):
        tagged = rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("b")) for i, c in enumerate(names)))))
        out = {}
        for r in tagged.where("b is not null").groupBy("i", "b").count().collect():
            out.setdefault(r["i"], {})[r["b"]] = r["count"]
        return out

    def find(have, rank):
        """(bucket, rank inside it) of a rank."""
        for b in sorted(have):
            if rank <= have[b]:
                return b, rank
            rank -= have[b]
        raise ValueError("rank beyond the rows")

    edges = {c: sorted(set(e)) or [0.0] for c, e in _edges(df, {c: F.col(c) for c in cols}, buckets).items()}
    placed = df.select(key, *cols)
    for c in cols:
        placed = place(placed, F.col(c), edges[c], f"_b_{c}")
    have = counts(placed, [f"_b_{c}" for c in cols])
    targets = [(c, *find(have[i], r)) for i, c in enumerate(cols) for r in ranks]
    # points: by key inside them
    points = sorted({(c, b) for c, b, _ in targets if b % 2})
    if points:
        inside = {f"{i}": F.when(F.col(f"_b_{c}") == b, F.col(key)) for i, (c, b) in enumerate(points)}
        keyed = _edges(placed, inside, buckets)
        for name, value in inside.items():
            placed = place(placed, value, sorted(set(keyed[name])) or [0.0], f"_k_{name}").withColumn(f"_k_{name}", F.when(value.isNotNull(), F.col(f"_k_{name}")))
        held = counts(placed, [f"_k_{name}" for name in inside])
    wanted = []
    for c, b, rest in targets:
        own = F.col(f"_b_{c}") == b
        if b % 2:
            i = points.index((c, b))
            k, rest = find(held[i], rest)
            own = own & (F.col(f"_k_{i}") == k)
        wanted.append((own, c, rest))
    hit = placed.select(key, F.explode(F.array_compact(F.array(*(
        F.when(own, F.struct(F.lit(t).alias("t"), F.col(c).cast("double").alias("v"), F.lit(rest).alias("rest"))) for t, (own, c, rest) in enumerate(wanted))))).alias("h"))
    order = Window.partitionBy("t").orderBy("v", key)
    found = hit.select(key, "h.*").withColumn("n", F.row_number().over(order)).where("n = rest").select("t", "v", key).collect()
    out: dict = {c: [None] * len(ranks) for c in cols}
    for t, v, k in found:
        out[wanted[t][1]][t % len(ranks)] = (v, k)
    return out


def rfm_scores(cust: DataFrame, key: str = "CustomerID", buckets: int | None = None,
               checkpoint: bool = True) -> DataFrame:
    """R/F/M scores 1..5 (5 = best) from ranks (ties by ``key``), and their sum.

    Recency is reversed (recent = 5). ``ntile(5)`` is not used: it sizes bins
    differently from quantile cuts. Of the ranks only the last of each of the
    first four bins matters, so the (value, key) pairs at those ranks are
    selected (``rank_cuts``) and every customer is compared with them: no sort
    and no window over the customers. The customer table is written first (to
    the folder of ``spark.checkpoint.dir``), so the selection reads its columns
    instead of recomputing it from the transactions."""
    if checkpoint:
        cust = materialize(cust)
    cols = ["recency", "frequency", "monetary"]
    n = cust.count()
    # bin(r) = max(1, ceil(5 (r - 1) / (n - 1))) <= b up to rank floor(b (n - 1) / 5) + 1
    buckets = buckets or max(4 * LEAST_BUCKETS, -(-n // BUCKET_ROWS))
    cuts = rank_cuts(cust, cols, key, [b * (n - 1) // 5 + 1 for b in range(1, 5)], buckets) if n else {c: [] for c in cols}

    def quintile(c):
        v = F.col(c).cast("double")
        beyond = [(v > F.lit(x)) | ((v == F.lit(x)) & (F.col(key) > F.lit(k))) for x, k in cuts[c]]
        return sum((b.cast("int") for b in beyond), F.lit(1))

    return (cust.withColumns({"R_score": (6 - quintile("recency")).cast("int"), "F_score": quintile("frequency").cast("int"),
                              "M_score": quintile("monetary").cast("int")})
                .withColumn("RFM_score", (F.col("R_score") + F.col("F_score") + F.col("M_score")).cast("int")))
