"""k-means customer segments on standardized R/F/M."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.ml.parallel import fit_all
from tillsight.ml.silhouette import silhouettes, squares
from tillsight.ml.stages import ClusterLabels, fit_scaler
from tillsight.ml.starts import starts as first_centres
from tillsight.operators.metrics import standardize
from tillsight.operators.segments import label_clusters, map_labels
from tillsight.schema import RFM_COLS
from tillsight.session import materialize


def scaled_rfm(cust: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Population-std standardized R/F/M assembled into ``features``."""
    z = standardize(cust, cols)
    return VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features").transform(z)


def kmeans_segments(scored: DataFrame, k: int = 5, starts: int = 10, seed: int = 42,
                    max_iter: int = 300) -> tuple[DataFrame, object]:
    """Best of ``starts`` k-means runs (least within-cluster cost), then
    clusters labelled by mean RFM score. MLlib has one start per fit, so the
    restarts are distributed fits over the checkpointed vectors, several
    submitted at once.
    Input needs RFM_score (``rfm_scores``). Returns (segments, model)."""
    data = materialize(scaled_rfm(scored))

    def fit(i):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features",
                   predictionCol="cluster").fit(data)
        return m.summary.trainingCost, i, m

    # least cost; equal costs go to the earlier start
    _, _, best = min(fit_all(fit, range(starts)), key=lambda r: (r[0], r[1]))
    clustered = best.transform(data).drop("features", *[f"{c}_z" for c in RFM_COLS])
    return map_labels(clustered, label_clusters(clustered)), best


def segment_pipeline(clustered: DataFrame, model, cols: Sequence[str] = RFM_COLS) -> PipelineModel:
    """Scaler, vectors, k-means model and segment names as one saved chain, for
    customers of any later day. ``clustered`` and ``model`` come from
    ``kmeans_segments``; the names stay those of the fitted clusters."""
    names = [(int(r["cluster"]), r["segment"]) for r in clustered.select("cluster", "segment").distinct().collect()]  # a row a cluster
    vectors = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features")
    return PipelineModel(stages=[fit_scaler(clustered, cols), vectors, model, ClusterLabels(names)])


def assign_segments(pipeline: PipelineModel, cust: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """``cust`` with its ``cluster`` and ``segment`` by a (re)loaded chain."""
    types = dict(cust.dtypes)
    out = pipeline.transform(cust.drop("cluster", "segment", "features", *(f"{c}_z" for c in cols)))
    return out.drop("features", *(f"{c}_z" for c in cols)).withColumns({c: F.col(c).cast(types[c]) for c in cols})


TOL = 1e-4    # centres that move no farther have converged (MLlib's default)
ROWS = 8192   # points measured at a time: their distances stay in a core's cache
EVERY = 16        # of so many points one is asked how wide that strip may be
LOCAL = 250_000   # points that one task moves a run's centres by (6 MB)
EDGES = 2.0 ** np.arange(-20, 6, 0.25)  # widths of the strip between clusters that are tried


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre (the first of equal ones) and squared
    distance to it, for each point; ``points`` has a row a column."""
    own, least = np.zeros(points.shape[1], dtype=np.int64), None
    for j, centre in enumerate(centres):
        square = squares(points, centre)
        if least is None:
            least = square
            continue
        closer = square < least
        own[closer] = j
        np.minimum(least, square, out=least)
    return own, least


def nearest_table(points: np.ndarray, terms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``terms`` (a row a point) summed by nearest centre (a row a centre), the
    squared distances less |x|^2, and which centre is a point's nearest (both a
    row a centre): products of matrices, some four times as fast as ``nearest``."""
    away = (centres ** 2).sum(1)[:, None] - 2 * centres @ points
    hot = away == away.min(0)
    if np.count_nonzero(hot) != points.shape[1]:  # equal distances: the first
        hot = np.arange(len(centres))[:, None] == away.argmin(0)
    return hot.astype(float) @ terms, away, hot


def _terms(points: np.ndarray) -> np.ndarray:
    """1, columns and |x|^2 of each point, a row a point."""
    return np.column_stack([np.ones(points.shape[1]), points.T, (points ** 2).sum(0)])


def _slack(away: np.ndarray, square: np.ndarray) -> np.ndarray:
    """How far all centres may move before a point changes its cluster, a
    little less for rounding, from ``nearest_table``'s distances and |x|^2."""
    if len(away) < 2:
        return np.full(away.shape[1], np.inf)
    least, second = np.sqrt(np.maximum(np.partition(away, 1, axis=0)[:2] + square, 0.0))
    return (second - least) / 2 - 1e-6 * (1 + np.sqrt(square))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS points a row, as the bytes of a table with a row a column."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            block = np.array([part.column(j).to_numpy() for j in range(part.num_columns)], dtype=float)
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])


def point_blocks(data: DataFrame, cols: Sequence[str]) -> tuple[RDD, int]:
    """Persisted (partition, place of its first point in there, points with a
    row a column), dealt out evenly, and the number of partitions of ``data``."""
    width = len(cols)

    def placed(part, rows):
        at = 0
        for r in rows:
            points = np.frombuffer(r[0]).reshape(width, -1)
            yield part, at, points
            at += points.shape[1]

    found = data.select(*cols).mapInArrow(_blocks, "block binary").rdd
    parts, cores = found.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism
    found = found.mapPartitionsWithIndex(placed)
    if parts < cores:  # few large partitions: their blocks by turns
        found = found.map(lambda b: (b[0] + b[1] // ROWS, b)).partitionBy(cores, lambda key: key).values()
    return found.persist(StorageLevel.MEMORY_AND_DISK), parts


def _sorted_out(models: dict[int, tuple[np.ndarray, float]]):
    """For every model (number: centres, reach) a table with a row a cluster
    (points, sum of each column and of |x|^2) of the points that keep their
    cluster while no centre moves farther than ``reach``, the other points, and
    how many of some points are how near to another cluster."""
    def run(found):
        tables = {i: np.zeros((len(centres), centres.shape[1] + 2)) for i, (centres, _) in models.items()}
        strips = {i: np.zeros(len(EDGES) + 1) for i in models}
        loose = {i: [] for i in models}
        for _, _, points in found:
            terms = _terms(points)
            for i, (centres, reach) in models.items():
                if reach == np.inf:
                    loose[i].append(points)
                    continue
                table, away, hot = nearest_table(points, terms, centres)
                strips[i] += np.bincount(np.searchsorted(EDGES, _slack(away[:, ::EVERY], terms[::EVERY, -1])), minlength=len(EDGES) + 1)
                if reach > 0:
                    near = _slack(away, terms[:, -1]) <= reach
                    loose[i].append(points[:, near])
                    table -= hot[:, near].astype(float) @ terms[near]
                tables[i] += table
        for i in models:
            yield i, (tables[i], strips[i], np.concatenate(loose[i], axis=1) if loose[i] else None)
    return run


def _moved(models: dict[int, tuple[np.ndarray, float]], steps: dict[int, int], tol: float):
    """Lloyd's iterations of a model from what all tasks sorted out: exact
    until a centre has moved farther than the model's reach."""
    def run(found):
        tables, strips, loose = {}, {}, {}
        for i, (table, strip, points) in found:
            tables[i], strips[i] = tables.get(i, 0) + table, strips.get(i, 0) + strip
            loose.setdefault(i, []).extend([] if points is None else
                                           [points[:, lo:lo + ROWS] for lo in range(0, points.shape[1], ROWS)])
        for i, table in tables.items():
            begin, reach = models[i]
            centres, cost, done, left = begin.copy(), 0.0, False, steps[i]
            terms = [] if reach == np.inf else [_terms(points) for points in loose[i]]
            while left > 0 and not done:
                total, cost = table.copy(), 0.0
                if reach == np.inf:
                    for points in loose[i]:
                        own, least = nearest(points, centres)
                        cost += float(least.sum())
                        for j, x in enumerate((None, *points)):
                            total[:, j] += np.bincount(own, x, len(centres))
                else:
                    for points, term in zip(loose[i], terms):
                        total += nearest_table(points, term, centres)[0]
                    cost = float((total[:, -1] - 2 * (total[:, 1:-1] * centres).sum(1) + total[:, 0] * (centres ** 2).sum(1)).sum())
                at = np.flatnonzero(total[:, 0] > 0.5)
                new = total[at, 1:-1] / total[at, :1]
                move = np.sqrt(((new - centres[at]) ** 2).sum(1).max(initial=0.0))
                centres[at], left, done = new, left - 1, move <= tol
                if np.sqrt(((centres - begin) ** 2).sum(1)).max() > reach:
                    break
            yield i, (centres, cost, done, left, move, strips[i])
    return run


def _reach(strip: np.ndarray, move: float, most: int) -> float:
    """The widest reach that leaves at most ``most`` points to one task, 0 if
    the centres would be through it in a few steps."""
    widths = EDGES[np.cumsum(strip)[:-1] * EVERY <= most]
    return float(widths[-1]) if len(widths) and widths[-1] >= 4 * move else 0.0


def run_lloyd(points: RDD, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = TOL) -> list[tuple[np.ndarray, float]]:
    """``lloyd`` on the blocks of ``point_blocks``."""
    count = points.map(lambda b: b[2].shape[1]).sum()
    reach = np.inf if count <= LOCAL else 0.0
    models = {i: (np.array(s, dtype=float), reach) for i, s in enumerate(starts)}
    out = [(centres.copy(), 0.0) for centres, _ in models.values()]
    steps = dict.fromkeys(models, max_iter if count else 0)
    while models := {i: m for i, m in models.items() if steps[i] > 0}:
        turn = {i: n for n, i in enumerate(models)}
        found = (points.mapPartitions(_sorted_out(models)).partitionBy(len(models), lambda i, turn=turn: turn[i])
                 .mapPartitions(_moved(models, steps, tol)).collect())  # a row a model
        for i, (centres, cost, done, left, move, strip) in found:
            out[i], steps[i] = (centres, cost), 0 if done else left
            models[i] = centres, reach or _reach(strip, move, LOCAL)
    return out


def lloyd(data: DataFrame, cols: Sequence[str], starts: Sequence[np.ndarray], max_iter: int = 300,
          tol: float = TOL) -> list[tuple[np.ndarray, float]]:
    """k-means from each of the ``starts`` (rows are centres), all in the same
    passes over ``data``. Gives the last centres and, as MLlib's
    ``trainingCost``, the cost at those before. A cluster without points keeps
    its centre.

    A pass moves all centres once. Where they move little, it also sorts out
    the points whose cluster can't change while no centre leaves its
    surroundings: their sums stand for them, and one task a run goes on with
    the others (LOCAL at most), step by step, until a centre leaves them."""
    points, _ = point_blocks(data, cols)
    try:
        return run_lloyd(points, starts, max_iter, tol)
    finally:
        points.unpersist()


def with_cluster(data: DataFrame, cols: Sequence[str], centres: np.ndarray) -> DataFrame:
    """``data`` with the place of each row's nearest centre."""
    away = F.array(*[sum(((F.col(c) - F.lit(float(x))) ** 2 for c, x in zip(cols, centre)), F.lit(0.0)) for centre in centres])
    return data.withColumn("_away", away).withColumn("cluster", (F.array_position("_away", F.array_min("_away")) - 1).cast("int")).drop("_away")


def k_sweep(scored: DataFrame, ks: Iterable[int] = range(2, 9), seed: int = 42, starts: int = 10,
            max_iter: int = 300) -> DataFrame:
    """Inertia and Euclidean silhouette for each k (the elbow table), each of
    the best of ``starts`` fits; ``silhouette_error`` is the half width of the
    interval that holds it. The best k by silhouette is flagged but not used."""
    cols = [f"{c}_z" for c in RFM_COLS]
    data = materialize(scaled_rfm(scored).select("features", *cols))
    ks = list(ks)
    jobs = [(k, seed + i) for k in ks for i in range(starts)]
    points, parts = point_blocks(data, cols)
    try:
        fits = run_lloyd(points, first_centres(points, parts, jobs), max_iter)
    finally:
        points.unpersist()
    best = [min((f for (own, _), f in zip(jobs, fits) if own == k), key=lambda f: f[1]) for k in ks]  # equal costs: the earlier start
    names = [f"cluster{i}" for i in range(len(ks))]
    clustered = data.select(*cols)
    for name, (centres, _) in zip(names, best):
        clustered = with_cluster(clustered, cols, centres).withColumnRenamed("cluster", name)
    found = silhouettes(materialize(clustered.select(*names, *cols)), cols, names)
    rows = [(int(k), cost, *value) for k, (_, cost), value in zip(ks, best, found)]
    spark = scored.sparkSession
    out = spark.createDataFrame(rows, "k int, inertia double, silhouette double, silhouette_error double")
    best = max(rows, key=lambda r: r[2])[0] if rows else None
    return out.withColumn("best_by_silhouette", F.col("k") == F.lit(best))
