"""Least squares from cross products: one pass over the rows for any number of
nested training windows.

Every task sums [1, x, y]' [1, x, y] for each block of days it holds, and Spark
adds the sums up: (columns + 2)^2 numbers a block, whatever the number of rows.
A training window that ends at a block's edge is a prefix sum over blocks, so
all walk-forward folds are solved from the same pass. Columns are shifted and
scaled by their overall mean and deviation first, which changes no solution but
keeps the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.ml.tabled import TableModel
from tillsight.operators.daily import _positions
from tillsight.operators.metrics import regression_metrics
from tillsight.schema import TARGET
from tillsight.session import materialize

_CELLS = pa.schema([("block", pa.int32()), ("cell", pa.int32()), ("value", pa.float64())])


def dot(x: str, weights: Column) -> Column:
    """Inner product of two array columns, inside the JVM."""
    return F.aggregate(F.zip_with(F.col(x), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


class LinearFit(TableModel):
    """Intercept (place -1) and coefficients."""

    SCHEMA = "place int, value double"

    @property
    def intercept(self) -> float:
        return self.rows[0][1]

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector([v for _, v in self.rows[1:]])

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*(F.lit(float(v)) for v in self.coefficients))
        return df.withColumn("_x", vector_to_array("features")).withColumn("prediction", F.lit(self.intercept) + dot("_x", weights)).drop("_x")


def moments(rows: DataFrame, label: str) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Cross products of [1, x, y], shifted and scaled, for each ``block``; and
    the shift and scale of [x, y]. Rows need ``block`` and the array ``x``."""
    data = rows.select(F.col("block").cast("int").alias("block"), F.array_append("x", F.col(label).cast("double")).alias("x")).where(F.col(label).isNotNull())
    size = data.select(F.size("x").alias("n")).first()
    if size is None:
        return {}, np.zeros(1), np.ones(1)
    d = size["n"]
    facts = data.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()
    shift, scale = np.array([facts[f"m{i}"] for i in range(d)]), np.array([facts[f"s{i}"] for i in range(d)])
    scale = np.where(scale > 0, scale, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            block = b.column(0).to_numpy()
            z = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - shift) / scale
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            for k in np.unique(block).tolist():
                own = z[block == k]
                held[k] = held.get(k, 0.0) + own.T @ own
        for k, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, dtype=np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], schema=_CELLS)

    out: dict[int, np.ndarray] = {}
    for r in data.mapInArrow(run, "block int, cell int, value double").groupBy("block", "cell").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["block"], np.zeros((d + 1) * (d + 1)))[r["cell"]] = r["value"]
    return {k: m.reshape(d + 1, d + 1) for k, m in out.items()}, shift, scale


def solve(m: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """[intercept, coefficients] from the cross products. A column that is
    constant in the window gets 0, dependent ones the least coefficients."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - np.outer(mean, mean) * n
    var = np.diag(c)[:-1]
    own = np.flatnonzero(var > 1e-12 * n)
    d = np.sqrt(var[own])
    beta = np.zeros(len(var))
    beta[own] = np.linalg.lstsq(c[np.ix_(own, own)] / np.outer(d, d), c[own, -1] / d, rcond=1e-11)[0] / d
    raw = beta * scale[-1] / scale[:-1]
    level = shift[-1] + scale[-1] * mean[-1] - raw @ (shift[:-1] + scale[:-1] * mean[:-1])
    return np.concatenate([[level], raw])


def fit_linear(train: DataFrame, label: str = TARGET) -> LinearFit:
    """Ordinary least squares on the ``features`` vectors."""
    made, shift, scale = moments(train.select(F.lit(0).alias("block"), vector_to_array("features").alias("x"), label), label)
    if not made:
        raise ValueError("no rows to fit on")
    return LinearFit([(i - 1, float(v)) for i, v in enumerate(solve(made[0], shift, scale))])


def walk_forward(vectors: DataFrame, n_folds: int = 5, min_train_days: int = 90, keys: Sequence[str] = (), label: str = TARGET) -> DataFrame:
    """Metrics of linear fits on expanding windows, the folds of
    ``walk_forward_splits``: block 0 holds the first ``min_train_days`` days,
    block k the test days of fold k, which later folds train on."""
    spark = vectors.sparkSession
    at = _positions(vectors, keys)
    size = F.greatest(F.floor((F.col("n_days") - min_train_days) / n_folds), F.lit(1))
    block = F.when(F.col("pos") < min_train_days, 0).otherwise(1 + F.floor((F.col("pos") - min_train_days) / size))
    days = at.select("date", block.cast("int").alias("block")).where(F.col("block") <= n_folds)
    rows = materialize(vectors.select("date", vector_to_array("features").alias("x"), F.col(label).cast("double").alias(label)).join(days, "date"))
    made, shift, scale = moments(rows, label)
    total, fits = np.zeros((len(shift) + 1, len(shift) + 1)), []
    for k in range(1, n_folds + 1):
        total = total + made.get(k - 1, 0.0)
        if k in made and total[0, 0] > 0:
            fits.append((k, [float(v) for v in solve(total, shift, scale)]))
    table = spark.createDataFrame(fits, "block int, fit array<double>")  # a row a fold
    scored = rows.join(F.broadcast(table), "block").select(F.col("block").alias("fold"), label, (F.col("fit")[0] + dot("x", F.slice("fit", 2, len(shift)))).alias("prediction"))
    counts = rows.groupBy("block").agg(F.count_distinct("date").alias("n")).select("block", "n")
    folds = table.select(F.col("block").alias("fold"))
    sizes = folds.join(F.broadcast(counts), F.col("block") <= F.col("fold")).groupBy("fold").agg(
        F.sum(F.when(F.col("block") < F.col("fold"), F.col("n")).otherwise(0)).alias("train_days"), F.sum(F.when(F.col("block") == F.col("fold"), F.col("n")).otherwise(0)).alias("test_days"))
    return regression_metrics(scored, by=["fold"]).join(sizes, "fold").select("R2", "RMSE", "MAE", "fold", "train_days", "test_days")
