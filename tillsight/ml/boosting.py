"""Gradient-boosted regression trees on quantile-binned columns.

One Spark job a fit. Each task bins its rows once (a byte a value) and keeps
them with their gradients; all tasks of the barrier stage grow the same trees
by exchanging gradient histograms, once a level (or once a split where trees
grow leaf by leaf). Only the smaller child of a split is summed; its sibling is
the parent less it. Columns are drawn once a tree, rows by a hash of the row,
the tree and the seed. Gradients are whole numbers of a fixed small unit, so
that sums, and with them the trees, don't depend on how rows are dealt out.

A histogram has columns x bins cells whatever the number of rows. A lost
executor makes Spark run the barrier stage again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.ml.tabled import TableModel

#: Cut points a column at most; rows of one task, and tasks of a fit at most. An
#: exchange between tasks takes about a second, so a task gets so many rows that
#: summing them takes as long. Rows are summed STEP at a time.
CUTS, TASK_ROWS, MAX_TASKS, STEP = 254, 1 << 21, 64, 1 << 16
#: Gradients are counted in units of (range of the labels) / 2^UNIT.
UNIT = 28
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def drawn_rows(mark: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by their 64-bit marks."""
    if share >= 1:
        return np.ones(len(mark), dtype=bool)
    salt = mix(np.array([(seed << 32) + tree + 1], dtype=U64))[0]
    return mix(mark ^ salt) < U64(int(share * 2.0**64))


def drawn_columns(n: int, tree: int, seed: int, share: float) -> np.ndarray:
    """Which columns a tree may split on."""
    take = max(1, int(share * n))
    return np.sort(np.random.default_rng((seed, tree)).permutation(n)[:take])


class Grower:
    """Grows trees over one task's binned rows; ``exchange`` adds an array up
    over all tasks."""

    def __init__(self, bins: np.ndarray, cuts: list[np.ndarray], exchange: Callable, depth: int, leaves: int, penalty: float, least: int):
        self.bins, self.exchange = bins, exchange
        self.depth, self.leaves, self.penalty, self.least = depth, leaves, penalty, least
        self.width = max((len(c) for c in cuts), default=0) + 1
        self.room = np.array([len(c) for c in cuts])  # bin k <= x <= cut k; the last bin has no cut

    def histograms(self, rows: list[np.ndarray], grad: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """(leaf, gradient or count, column, bin) of the leaves' rows."""
        cells = len(cols) * self.width
        out = np.zeros((len(rows), 2, cells))
        at = np.arange(len(cols)) * self.width
        for k, own in enumerate(rows):
            for lo in range(0, len(own), STEP):
                some = own[lo:lo + STEP]
                cell = (self.bins[np.ix_(some, cols)] + at).ravel()
                out[k, 0] += np.bincount(cell, weights=np.repeat(grad[some], len(cols)), minlength=cells)
                out[k, 1] += np.bincount(cell, minlength=cells)
        return self.exchange(out).reshape(len(rows), 2, len(cols), self.width)

    def best(self, hist: np.ndarray, cols: np.ndarray) -> tuple[float, int, int]:
        """(gain, column, cut) of a leaf's best split; gain 0 if there is none."""
        if not self.room.max(initial=0):
            return 0.0, -1, -1
        left = np.cumsum(hist, axis=2)[:, :, :-1]
        total = hist[:, :1].sum(axis=2, keepdims=True)
        right = total - left
        ok = (np.arange(self.width - 1)[None, :] < self.room[cols][:, None]) & (left[1] >= self.least) & (right[1] >= self.least)

        def score(x):
            return x[0] * x[0] / np.maximum(x[1] + self.penalty, 1e-300)
        gain = np.where(ok, score(left) + score(right) - score(total), 0.0)
        k = int(gain.argmax())
        c, b = divmod(k, gain.shape[1])
        top = float(gain[c, b])
        return (top, int(cols[c]), b) if top > 1e-9 * float(score(total)[0, 0]) + 1e-9 else (0.0, -1, -1)

    def tree(self, grad: np.ndarray, seen: np.ndarray, cols: np.ndarray) -> tuple[list[list], np.ndarray]:
        """Nodes [column, cut, left, right, gradient sum, count, gain], and the
        leaf of every row."""
        where = np.zeros(len(grad), dtype=np.int32)
        nodes: list[list] = []
        rows, hists, splits, level = {}, {}, {}, {}

        def add(own, hist, depth):
            number = len(nodes)
            g, n = (float(hist[i, 0].sum()) if hist.shape[1] else 0.0 for i in (0, 1))
            nodes.append([-1, -1, -1, -1, g, n, 0.0])
            rows[number], level[number] = own, depth
            gain = self.best(hist, cols) if depth < self.depth else (0.0, -1, -1)
            if gain[0] > 0:
                hists[number], splits[number] = hist, gain
            return number

        start = np.flatnonzero(seen)
        add(start, self.histograms([start], grad, cols)[0], 0)
        count = 1
        while splits and count < self.leaves:
            if self.leaves < 1 << self.depth:  # leaf by leaf, the best first
                now = [min(splits, key=lambda i: (-splits[i][0], i))]
            else:
                now = sorted(splits)
            parts, small = {}, []
            for i in now:
                _, col, cut = splits[i]
                goes = self.bins[rows[i], col] <= cut
                parts[i] = rows[i][goes], rows[i][~goes]
                c = int(np.searchsorted(cols, col))
                n_left = hists[i][1, c, :cut + 1].sum()
                small.append(n_left <= hists[i][1, c].sum() - n_left)
            made = self.histograms([parts[i][0] if s else parts[i][1] for i, s in zip(now, small, strict=True)], grad, cols)
            for i, s, hist in zip(now, small, made, strict=True):
                gain, col, cut = splits.pop(i)
                other = hists.pop(i) - hist
                left, right = (hist, other) if s else (other, hist)
                a = add(parts[i][0], left, level[i] + 1)
                b = add(parts[i][1], right, level[i] + 1)
                nodes[i][:4] = [col, cut, a, b]
                nodes[i][6] = gain
                del rows[i]
                own = np.flatnonzero(where == i)
                where[own] = np.where(self.bins[own, col] <= cut, a, b)
                count += 1
        return nodes, where


def boost(bins, label, mark, cuts, exchange, unit, base, rounds, depth, leaves, step, rows, cols, penalty, least, seed) -> list[tuple]:
    """All trees, as rows of BoostedTrees.SCHEMA without the base."""
    grower = Grower(bins, cuts, exchange, depth, leaves, penalty, least)
    now = np.full(len(label), base)
    out = []
    for tree in range(rounds):
        grad = np.rint((label - now) / unit)
        nodes, where = grower.tree(grad, drawn_rows(mark, tree, seed, rows), drawn_columns(len(cuts), tree, seed, cols))
        value = np.array([step * unit * n[4] / (n[5] + penalty) if n[5] + penalty else 0.0 for n in nodes])
        now = now + value[where]
        for i, (col, cut, left, right, _, count, gain) in enumerate(nodes):
            out.append((tree + 1, i, left, right, col, float(cuts[col][cut]) if left >= 0 else 0.0, float(value[i]), float(count), float(gain) * unit * unit))
    return out


class BoostedTrees(TableModel):
    """Base value (tree 0, one leaf) plus the sum of the trees."""

    SCHEMA = "tree int, id int, left int, right int, feature int, threshold double, value double, cover double, gain double"

    def tables(self) -> list[dict]:
        """A dict of arrays a tree, by node."""
        table = pd.DataFrame(self.rows, columns=["tree", "id", "left", "right", "feature", "threshold", "value", "cover", "gain"]).sort_values(["tree", "id"])
        return [{c: g[c].to_numpy() for c in ("left", "right", "feature", "threshold", "value", "cover")} for _, g in table.groupby("tree", sort=True)]

    @property
    def trees(self) -> list[dict]:
        return self.tables()[1:]

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = self.tables()
        size = max(len(t["left"]) for t in trees)

        def stacked(field, kind):
            out = np.zeros((len(trees), size), dtype=kind)
            for i, t in enumerate(trees):
                out[i, :len(t[field])] = t[field]
            return out

        left, right, feature = (stacked(c, np.int64) for c in ("left", "right", "feature"))
        threshold, value = stacked("threshold", float), stacked("value", float)
        for i, t in enumerate(trees):  # a leaf is its own child
            leaf = np.flatnonzero(t["left"] < 0)
            left[i, leaf] = right[i, leaf] = leaf
            feature[i, leaf] = 0
        packed = df.sparkSession.sparkContext.broadcast((left, right, feature, threshold, value))

        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            left, right, feature, threshold, value = packed.value
            each = np.arange(len(left))
            for batch in batches:
                out = np.zeros(len(batch))
                for lo in range(0, len(batch), 2048):
                    x = np.stack(batch.iloc[lo:lo + 2048].to_numpy())
                    at = np.zeros((len(x), len(left)), dtype=np.int64)
                    row = np.arange(len(x))[:, None]
                    while True:
                        down = np.where(x[row, feature[each, at]] <= threshold[each, at], left[each, at], right[each, at])
                        if (down == at).all():
                            break
                        at = down
                    out[lo:lo + 2048] = value[each, at].sum(axis=1)
                yield pd.Series(out)

        udf = F.pandas_udf(predict, "double")
        return df.withColumn("prediction", udf(vector_to_array("features")))


def cut_points(data: DataFrame, d: int) -> tuple[list[np.ndarray], dict]:
    """Where each of the ``d`` columns of ``x`` may be split (values at equal
    steps of its rows, without its largest), and facts about the label."""
    probs = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    facts = data.agg(F.count("*").alias("n"), F.avg("y").alias("base"), F.min("y").alias("low"), F.max("y").alias("high"),
                     *(F.percentile_approx(F.col("x")[i], probs, 100000).alias(f"q{i}") for i in range(d)),
                     *(F.max(F.col("x")[i]).alias(f"m{i}") for i in range(d))).first()
    return [np.array(sorted({float(v) for v in facts[f"q{i}"] or [] if v == v and v < facts[f"m{i}"]})) for i in range(d)], facts.asDict()


def fit_boosted(train: DataFrame, label: str, rounds: int = 400, depth: int = 5, leaves: int | None = None, step: float = 0.03, rows: float = 0.8,
                cols: float = 0.8, penalty: float = 1.0, least: int = 1, seed: int = 42, tasks: int | None = None) -> BoostedTrees:
    """Fit on the ``features`` vectors of ``train``. Trees grow level by level,
    or leaf by leaf if ``leaves`` is less than a full tree's. Rows with equal
    features and label are drawn together; a NaN goes right at every split."""
    spark = train.sparkSession
    leaves = min(leaves or 1 << depth, 1 << depth)
    data = train.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y")).where("y is not null")
    width = data.select(F.size("x").alias("n")).first()
    if width is None:
        return BoostedTrees([(0, 0, -1, -1, -1, 0.0, 0.0, 0.0, 0.0)])
    d = width["n"]
    cuts, facts = cut_points(data, d)
    n, base = facts["n"], float(facts["base"])
    unit = max(facts["high"] - facts["low"], 1e-300) / 2.0**UNIT
    parts = tasks or max(1, min(MAX_TASKS, spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    settings = dict(unit=unit, base=base, rounds=rounds, depth=depth, leaves=leaves, step=step, rows=rows, cols=cols, penalty=penalty, least=least, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        held = [np.zeros((0, d), dtype=np.uint8)], [np.zeros(0)], [np.zeros(0, dtype=U64)]
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            held[0].append(np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8))
            held[1].append(b.column(1).to_numpy(zero_copy_only=False))
            held[2].append(b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
        bins, y, mark = (np.concatenate(h) for h in held)
        context = BarrierTaskContext.get() if parts > 1 else None

        def exchange(own: np.ndarray) -> np.ndarray:
            if context is None:
                return own
            every = context.allGather(base64.b64encode(own.astype(np.int64).tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(e), dtype=np.int64) for e in every).astype(np.float64).reshape(own.shape)

        made = boost(bins, y, mark, cuts, exchange, **settings)
        if context is None or context.partitionId() == 0:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in made], schema=schema)

    names = [c.split()[0] for c in BoostedTrees.SCHEMA.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.float64()) for c in BoostedTrees.SCHEMA.split(", ")])
    dealt = data.withColumn("mark", F.xxhash64("x", "y")).repartition(parts)
    found = dealt.mapInArrow(run, BoostedTrees.SCHEMA, barrier=parts > 1).collect()  # as many rows as the model has nodes
    return BoostedTrees([(0, 0, -1, -1, -1, 0.0, base, float(n), 0.0), *(tuple(r) for r in found)])
