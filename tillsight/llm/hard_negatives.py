"""Hard-negative mining by angular triangle filtering.

Every vector is stored with its angles to a few orthonormal reference
directions (principal axes of a bounded sample), with the sine of its angle to
their span, and with its norm. For an anchor a and a row x the triangle
inequality of those angles bounds the cosine between them:

    sum_r cos(a, r) cos(x, r)  +-  sin(a, span) sin(x, span)

which for a single reference is cos(angle_a +- angle_x). Times both norms, and
rounded outwards, that is an interval for the integer score. Rows get an
integer score only where the interval overlaps a window that can still take
them: at least the k-th best positive so far, or, for negatives, between the
larger of the window's low end and its k-th best so far and its high end.

Rows are packed into shards of a few thousand wherever they are read; anchors
go round in waves of bounded size, and what a wave finds is written out.

Defined results: a row takes part if its id, its label, its vector and all
components are there and the components are finite; only vectors of equal
length are compared; rows that share the anchor's id are the anchor itself;
repeated rows each take a place; equal repeated anchor rows give one result;
an anchor without positives, or a positive without negatives, gives no rows;
empty vectors score 0; vectors too large for exact doubles are scored in whole
numbers, clipped to 64 bits; an empty table gives an empty result; only named
columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import lean, stage
from tillsight.session import checkpoint_dir

#: Rows of a shard, anchors of a block, and bytes of anchors in one wave.
SHARD_ROWS, BLOCK_ROWS, WAVE_BYTES = 4096, 1024, 16 << 20
#: Reference directions for each 8 dimensions, and the rows they are fitted on.
PER_EIGHT, SAMPLE_ROWS = 7, 4096
EXACT = float(1 << 53)
#: Error allowed to a cosine made of angles that are stored in 32 bits.
SLACK = 4e-7
LIMIT = 1 << 62


def axes(dim: int, sample: np.ndarray | None) -> np.ndarray:
    """Orthonormal reference directions: principal axes of the sample's
    directions, or unit axes where the sample has no vector of that length."""
    n = -(-dim * PER_EIGHT // 8)
    if sample is None or not len(sample):
        return np.eye(dim)[:n]
    norm = np.linalg.norm(sample, axis=1)
    u = sample[norm > 0] / norm[norm > 0][:, None]
    return np.linalg.eigh(u.T @ u)[1][:, ::-1].T[:n]


def angles(vecs: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angles to the references, sine of the angle to their span, norm."""
    norm = np.linalg.norm(vecs, axis=1)
    u = vecs / np.where(norm > 0, norm, 1)[:, None]
    c = u @ refs.T
    return np.arccos(np.clip(c, -1, 1)).astype(np.float32), np.linalg.norm(u - c @ refs, axis=1), norm


def dots(vecs: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of whole-number vectors."""
    if exact:
        return (vecs @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(-LIMIT, min(LIMIT, sum(a * int(b) for a, b in zip(whole, v, strict=True)))) for v in vecs], dtype=np.int64)


class Shard:
    """Rows with their angles, and anchors likewise."""

    FIELDS = (("ids", np.int64), ("labels", np.int64), ("vecs", None), ("angles", np.float32), ("rest", np.float64), ("norm", np.float64))

    def __init__(self, dim, n, ids, labels, vecs, angles, rest, norm):
        self.dim, self.n, self.ids, self.labels, self.vecs = dim, n, ids, labels, vecs
        self.cos, self.rest, self.norm = np.cos(angles.astype(np.float64)), rest, norm

    @staticmethod
    def row(ids, labels, vecs, refs) -> dict:
        small = not vecs.size or np.abs(vecs).max() < 1 << 24
        ang, rest, norm = angles(vecs, refs)
        return {"dim": vecs.shape[1], "n": len(ids), "ids": ids.tobytes(), "labels": labels.tobytes(),
                "vecs": (b"f" if small else b"d") + vecs.astype(np.float32 if small else np.float64).tobytes(),
                "angles": ang.tobytes(), "rest": rest.tobytes(), "norm": norm.tobytes()}

    @classmethod
    def of(cls, r: dict) -> Shard:
        n, dim = r["n"], r["dim"]
        vecs = np.frombuffer(r["vecs"], dtype=np.float32 if r["vecs"][:1] == b"f" else np.float64, offset=1).reshape(n, dim).astype(np.float64)
        return cls(dim, n, np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["labels"], dtype=np.int64), vecs,
                   np.frombuffer(r["angles"], dtype=np.float32).reshape(n, -1), np.frombuffer(r["rest"]), np.frombuffer(r["norm"]))


def bounds(anchors: Shard, some: slice, rows: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each row can have with each anchor."""
    mid = anchors.cos[some] @ rows.cos.T
    span = np.outer(anchors.rest[some], rows.rest) + SLACK * (1 + rows.cos.shape[1])
    norms = np.outer(anchors.norm[some], rows.norm)
    pad = 1 + norms * 1e-12
    return np.maximum(mid - span, -1) * norms - pad, np.minimum(mid + span, 1) * norms + pad


class Best:
    """The k best (score, id) with a score between two ends."""

    __slots__ = ("low", "high", "k", "score", "ids")

    def __init__(self, k: int, low: int = -LIMIT, high: int = LIMIT):
        self.k, self.low, self.high = k, low, high
        self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def floor(self) -> int:
        return max(self.low, int(self.score[-1])) if len(self.score) == self.k else self.low

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        fit = (score >= self.floor()) & (score <= self.high)
        if fit.any():
            score, ids = np.concatenate([self.score, score[fit]]), np.concatenate([self.ids, ids[fit]])
            best = np.lexsort((ids, -score))[:self.k]
            self.score, self.ids = score[best], ids[best]


def scan(anchors: Shard, rows: Shard, windows: list[list[Best]], same: bool, tally: list | None = None) -> None:
    """Offer the rows of a shard to the windows of every anchor of a block."""
    top = (anchors.norm.max() if anchors.n else 0.0) * (rows.norm.max() if rows.n else 0.0)
    exact = top < EXACT
    for lo in range(0, anchors.n, 128):
        some = slice(lo, min(lo + 128, anchors.n))
        least, most = bounds(anchors, some, rows)
        for i in range(some.start, some.stop):
            own = windows[i]
            if not own:
                continue
            near, far = least[i - lo], most[i - lo]
            able = ((rows.labels == anchors.labels[i]) == same) & (rows.ids != anchors.ids[i])
            if exact:
                able &= (far >= min(w.floor() for w in own)) & (near <= max(w.high for w in own))
            left = np.flatnonzero(able)
            left = left[np.argsort(-far[left], kind="stable")]
            step = 64
            while len(left):  # the most promising first: their scores narrow the windows
                now, left = left[:step], left[step:]
                score = dots(rows.vecs[now], anchors.vecs[i], exact)
                if tally is not None:
                    tally[0] += len(now)
                for w in own:
                    w.offer(score, rows.ids[now])
                if exact and len(left):
                    left = left[far[left] >= min(w.floor() for w in own)]
                step *= 4


_PACKED = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vecs", "angles", "rest", "norm"))])
PACKED = "dim int, n int, ids binary, labels binary, vecs binary, angles binary, rest binary, norm binary"
_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])
FOUND = "anchor long, slot int, anchor_id long, found_id long, score long"


def _vectors(b: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, whole-number vectors) of the rows, by vector length."""
    ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    lists = b.column(2)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        with np.errstate(over="ignore"):
            vecs = np.floor(values[off[own][:, None] + np.arange(n)].astype(np.float64) * scale) if n else np.zeros((len(own), 0))
        good = np.isfinite(vecs).all(axis=1)
        if good.any():
            yield ids[own[good]].astype(np.int64), labels[own[good]].astype(np.int64), vecs[good]


def _pack(scale, refs, most):
    """Rows packed into shards of at most ``most``, one vector length each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(own):
            ids, labels, vecs = (np.concatenate(x) for x in zip(*own, strict=True))
            dim = vecs.shape[1]
            return pa.RecordBatch.from_pylist([Shard.row(ids, labels, vecs, refs[dim] if dim in refs else axes(dim, None))], schema=_PACKED)

        for b in lean(batches):
            for lo in range(0, b.num_rows, most):
                for ids, labels, vecs in _vectors(b.slice(lo, most), scale):
                    own = held.setdefault(vecs.shape[1], [])
                    if own and sum(len(x[0]) for x in own) + len(ids) > most:
                        yield row(held.pop(vecs.shape[1]))
                        own = held.setdefault(vecs.shape[1], [])
                    own.append((ids, labels, vecs))
        for own in held.values():
            yield row(own)
    return run


def _find(shared, k, same):
    """The k best of each window of the wave's anchors among a task's shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for b in lean(batches):
            if blocks is None:
                blocks = []
                for r in shared.value:
                    ends = np.frombuffer(r["ends"], dtype=np.int64).reshape(r["n"], -1, 2) if r["ends"] else None
                    blocks.append((r["block"], Shard.of(r), [
                        [Best(k)] if ends is None else [Best(k, int(x), int(y)) for x, y in own if x <= y] for own in (range(r["n"]) if ends is None else ends)],
                        None if ends is None else [[s for s, (x, y) in enumerate(own) if x <= y] for own in ends]))
            for r in b.to_pylist():
                rows = Shard.of(r)
                for _, anchors, windows, _ in blocks:
                    if anchors.dim == rows.dim:
                        scan(anchors, rows, windows, same)
        for block, anchors, windows, slots in blocks or ():
            out = [(block * BLOCK_ROWS + i, slots[i][s] if slots else 0, int(anchors.ids[i]), int(v), int(x))
                   for i, own in enumerate(windows) for s, w in enumerate(own) for x, v in zip(w.score, w.ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)
    return run


def _rounds(shards: DataFrame, blocks: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """Send the anchor blocks round in waves; the k best of each window over
    all shards, ranked. Each wave's finds are written to one folder."""
    spark = shards.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    # block numbers and sizes, 16 bytes for a thousand anchors
    size = sum(F.octet_length(c) for c in ("ids", "labels", "vecs", "angles", "rest", "norm"))
    waves: list[list] = [[]]
    room = WAVE_BYTES
    for block, n in blocks.select("block", size.alias("size")).orderBy("block").collect():
        if waves[-1] and n > room:
            waves.append([])
            room = WAVE_BYTES
        waves[-1].append(block)
        room -= n
    for wave in waves:
        own = [r.asDict() for r in blocks.where(F.col("block").isin(wave)).collect()] if wave else []
        if own:
            shared = spark.sparkContext.broadcast(own)
            shards.mapInArrow(_find(shared, k, same), FOUND).write.mode("append").parquet(path)
            shared.destroy()
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("found_id"))
    return spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
         id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """For the ``positives`` best rows of each anchor's label, the
    ``negatives`` best rows of other labels whose score lies between ``low``
    and ``high`` percent of the positive's: (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score, positive_rank)."""
    spark = rows.sparkSession
    valid = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), is_anchor.alias("anchor")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(True)))
    sample: dict[int, list] = {}
    for (v,) in valid.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("v").collect():
        sample.setdefault(len(v), []).append(v)
    with np.errstate(over="ignore"):
        whole = {d: np.floor(np.array(v) * scale) for d, v in sample.items() if d}
    refs = {d: axes(d, v[np.isfinite(v).all(axis=1)]) for d, v in whole.items()}
    cols = ["id", "label", "v"]
    shards = stage(valid.select(cols).mapInArrow(_pack(scale, refs, SHARD_ROWS), PACKED), "shards")
    asked = stage(valid.where("anchor").select(cols).dropDuplicates(), "anchors")
    parts = max(1, -(-asked.count() // BLOCK_ROWS))
    blocks = stage(asked.repartition(parts).mapInArrow(_pack(scale, refs, BLOCK_ROWS), PACKED)
                   .withColumn("block", F.monotonically_increasing_id()).withColumn("ends", F.lit(None).cast("binary")), "blocks")
    best = stage(_rounds(shards, blocks, positives, True, "near").select("anchor", "rank", "anchor_id", "found_id", "score"), "positives")
    # 100 * s in [low * p, high * p]; a low end beyond the high end holds nothing
    ends = best.select("anchor", F.col("rank"), F.expr(f"cast(ceil({low} * cast(score as decimal(20,0)) / 100) as long)").alias("x"),
                       F.expr(f"cast(floor({high} * cast(score as decimal(20,0)) / 100) as long)").alias("y"))
    made = ends.groupBy(F.expr(f"anchor div {BLOCK_ROWS}").alias("block")).agg(F.collect_list(F.struct("anchor", "rank", "x", "y")).alias("own"))
    fitted = stage(blocks.drop("ends").join(made, "block").mapInArrow(_windows(positives), PACKED + ", block long, ends binary"), "windows")
    found = _rounds(shards, fitted, negatives, False, "far")
    both = found.withColumnRenamed("score", "negative_score").join(
        best.select("anchor", F.col("rank").alias("positive_rank"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")).withColumn("slot", F.col("positive_rank") - 1),
        ["anchor", "slot"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
                       "positive_score", "negative_score", "positive_rank")


def _windows(positives):
    """Blocks with the windows of each anchor's positives, as packed ends. A
    block holds BLOCK_ROWS anchors, so its list of windows is bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for r in b.to_pylist():
                ends = np.zeros((r["n"], positives, 2), dtype=np.int64)
                ends[:, :, 0] = 1  # empty: from 1 to 0
                for w in r.pop("own"):
                    ends[w["anchor"] - r["block"] * BLOCK_ROWS, w["rank"] - 1] = w["x"], w["y"]
                yield pa.RecordBatch.from_pylist([r | {"ends": ends.tobytes()}], schema=pa.schema([*_PACKED, ("block", pa.int64()), ("ends", pa.binary())]))
    return run


def op13_angular_negatives(spark, sf_dir):
    """Contract query: negatives of the 5 best positives of every vector whose
    id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE_OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.place, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(place AS INTEGER) AS positive_rank FROM n WHERE rank <= 10
"""
