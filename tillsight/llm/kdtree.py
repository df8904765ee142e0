"""Exact top-k inner-product search with one KD-tree a shard.

Vectors are dealt into shards of a few thousand rows, wherever they are read.
Each shard is packed with its KD-tree: median splits along the widest side, a
tight bounding box and the smallest id for every node. Queries are packed into
blocks, and a wave of blocks of bounded size is broadcast to all shards. A
query goes through a tree best-first, by the largest inner product that a box
can hold; nodes that cannot reach the k-th best so far are left out. The k-th
best starts from a first shard and is carried from shard to shard.

Defined results: a vector that is null, or holds a null or non-finite
component, or whose id is null takes no part; empty vectors have inner product
0 with each other; only vectors of equal length are compared; ties go to the
smaller id; rows that share the query's id are its own and no candidates;
repeated candidate rows each take a place, repeated query rows give one result;
scores beyond a 64-bit integer are clipped to it; an empty table gives an empty
result; only named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import lean, stage

SHARD_ROWS, LEAF_ROWS = 4096, 96
#: Queries in a block; bytes of query vectors that one wave broadcasts.
BLOCK_QUERIES, WAVE_BYTES = 1024, 16 << 20
EXACT = float(1 << 53)


def build(ids: np.ndarray, vecs: np.ndarray, leaf: int = LEAF_ROWS):
    """(ids, vectors in leaf order, nodes (start, end, left, right), boxes, smallest ids)."""
    order = np.arange(len(ids))
    nodes, low, high, least = [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = order[a:b]
        box_low, box_high = vecs[own].min(axis=0), vecs[own].max(axis=0)
        number = len(nodes)
        nodes.append([a, b, -1, -1])
        low.append(box_low)
        high.append(box_high)
        least.append(ids[own].min())
        if parent >= 0:
            nodes[parent][2 + side] = number
        wide = box_high - box_low
        if b - a > leaf and len(wide) and wide.max() > 0:
            axis = int(wide.argmax())
            mid = (b - a) // 2
            order[a:b] = own[np.argpartition(vecs[own, axis], mid)]
            todo.append((a + mid, b, number, 1))
            todo.append((a, a + mid, number, 0))
    return ids[order], vecs[order], np.array(nodes, dtype=np.int32), np.array(low), np.array(high), np.array(least)


class Best:
    """The k best (score, -id) of one query so far."""

    __slots__ = ("heap", "k")

    def __init__(self, k: int, floor: tuple | None = None):
        self.heap: list = []
        self.k = k
        if floor is not None:  # the k-th best known from elsewhere, as stand-ins that are not returned
            self.heap = [(floor[0], -floor[1], False)] * k

    def kth(self):
        return self.heap[0][:2] if len(self.heap) == self.k else None

    def offer(self, score, number, real=True):
        item = (score, -number, real)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item[:2] > self.heap[0][:2] or item[:2] == self.heap[0][:2] and not self.heap[0][2]:
            heapq.heapreplace(self.heap, item)


def search(shard, queries: np.ndarray, query_ids: np.ndarray, best: list[Best]) -> None:
    """Best-first search of one shard for every query of a block."""
    ids, vecs, nodes, low, high, least = shard
    dim = vecs.shape[1]
    most = (np.abs(queries).max() if queries.size else 0.0) * (np.abs(vecs).max() if vecs.size else 0.0) * max(dim, 1)
    if most >= EXACT:  # beyond exact doubles: whole numbers, every row
        own = [[int(x) for x in v] for v in vecs]
        for q, (qv, qid) in enumerate(zip(queries, query_ids.tolist(), strict=True)):
            whole = [int(x) for x in qv]
            for i, v in zip(ids.tolist(), own, strict=True):
                if i != qid:
                    best[q].offer(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole, v, strict=True)))), i)
        return
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    starts, ends, lefts, rights = (nodes[:, i].tolist() for i in range(4))
    least = least.tolist()
    for q, qid in enumerate(query_ids.tolist()):
        mine, top, qv = best[q], bound[q].tolist(), queries[q]
        todo = [(-top[0], 0)]
        while todo:
            kth = mine.kth()
            ub, node = heapq.heappop(todo)
            if kth is not None:
                if -ub < kth[0]:
                    break  # no box left can reach the k-th best
                if -ub == kth[0] and -least[node] < kth[1]:
                    continue  # it could only tie, with larger ids
            if lefts[node] >= 0:
                for child in (lefts[node], rights[node]):
                    heapq.heappush(todo, (-top[child], child))
                continue
            a, b = starts[node], ends[node]
            scores = vecs[a:b] @ qv
            hits = np.arange(b - a) if kth is None else np.flatnonzero(scores >= kth[0])
            if len(hits) > 8 * mine.k:  # only the best few of a leaf can count
                own = hits[np.lexsort((ids[a + hits], -scores[hits]))]
                hits = own[:mine.k + int((ids[a + own] == qid).sum())]
            for i in hits.tolist():
                number = int(ids[a + i])
                if number != qid:
                    mine.offer(int(scores[i]), number)


def _rows(b: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number vectors) of the valid rows, by vector length."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    lists = b.column(1)
    size = np.array([len(x) for x in lists] if len(lists) else [], dtype=np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        vecs = values[off[own][:, None] + np.arange(n)] if n else np.zeros((len(own), 0))
        with np.errstate(over="ignore"):
            vecs = np.floor(vecs.astype(np.float64) * scale)
        good = np.isfinite(vecs).all(axis=1)
        if good.any():
            yield ids[own[good]].astype(np.int64), vecs[good]


def _pack(vecs: np.ndarray) -> bytes:
    """Whole numbers as 32-bit floats where those hold them exactly."""
    small = not vecs.size or np.abs(vecs).max() < 1 << 24
    return (b"f" if small else b"d") + vecs.astype(np.float32 if small else np.float64).tobytes()


def _unpack(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float32 if data[:1] == b"f" else np.float64, offset=1).reshape(rows, dim).astype(np.float64)


def _shards(scale):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(ids, vecs):
            ids, vecs, nodes, low, high, least = build(ids, vecs)
            return pa.RecordBatch.from_pydict({
                "dim": [vecs.shape[1]], "n": [len(ids)], "ids": [ids.tobytes()], "vecs": [_pack(vecs)], "nodes": [nodes.tobytes()],
                "low": [_pack(low)], "high": [_pack(high)], "least": [least.tobytes()]}, schema=_SHARD)

        for b in lean(batches):
            for lo in range(0, b.num_rows, SHARD_ROWS):
                for ids, vecs in _rows(b.slice(lo, SHARD_ROWS), scale):
                    own = held.setdefault(vecs.shape[1], [])
                    own.append((ids, vecs))
                    if sum(len(x) for x, _ in own) >= SHARD_ROWS:
                        yield row(np.concatenate([x for x, _ in own]), np.concatenate([v for _, v in own]))
                        del held[vecs.shape[1]]
        for own in held.values():
            yield row(np.concatenate([x for x, _ in own]), np.concatenate([v for _, v in own]))
    return run


_SHARD = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("nodes", pa.binary()),
                    ("low", pa.binary()), ("high", pa.binary()), ("least", pa.binary())])
SHARD = "dim int, n int, ids binary, vecs binary, nodes binary, low binary, high binary, least binary"


def _blocks(scale):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for lo in range(0, b.num_rows, BLOCK_QUERIES):
                for ids, vecs in _rows(b.slice(lo, BLOCK_QUERIES), scale):
                    yield pa.RecordBatch.from_pydict({"dim": [vecs.shape[1]], "queries": [len(ids)], "query_ids": [ids.tobytes()], "query_vecs": [_pack(vecs)]},
                                                     schema=pa.schema([("dim", pa.int32()), ("queries", pa.int32()), ("query_ids", pa.binary()), ("query_vecs", pa.binary())]))
    return run


_HIT = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # block -> (ids, vectors, bests): at most one wave of blocks
        for b in lean(batches):
            for r in b.to_pylist():
                block, dim = r["block"], r["dim"]
                if block not in held:
                    n = r["queries"]
                    floor = np.frombuffer(r["floor"], dtype=np.int64).reshape(n, 3) if r["floor"] else None
                    held[block] = (np.frombuffer(r["query_ids"], dtype=np.int64), _unpack(r["query_vecs"], dim, n),
                                   [Best(k, None if floor is None or not floor[i, 2] else (int(floor[i, 0]), int(floor[i, 1]))) for i in range(n)])
                nodes = np.frombuffer(r["nodes"], dtype=np.int32).reshape(-1, 4)
                shard = (np.frombuffer(r["ids"], dtype=np.int64), _unpack(r["vecs"], dim, r["n"]), nodes, _unpack(r["low"], dim, len(nodes)),
                         _unpack(r["high"], dim, len(nodes)), np.frombuffer(r["least"], dtype=np.int64))
                search(shard, held[block][1], held[block][0], held[block][2])
        for block, (ids, _, bests) in held.items():
            rows = [(block, i, int(ids[i]), -neg, score) for i, best in enumerate(bests) for score, neg, real in best.heap if real]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_HIT)], schema=_HIT)
    return run


HIT = "block long, number int, query_id long, vec_id long, score long"


def _floors(k):
    """The k-th best of each query of a block, from a first shard's hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[int, dict] = {}
        for b in lean(batches):
            for block, number, _, vec, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hits.setdefault(block, {}).setdefault(number, []).append((score, -vec))
        for block, by in hits.items():
            out = np.zeros((BLOCK_QUERIES, 3), dtype=np.int64)
            for number, own in by.items():
                if len(own) >= k:
                    score, neg = sorted(own, reverse=True)[k - 1]
                    out[number] = score, -neg, 1
            yield pa.RecordBatch.from_pydict({"block": [block], "floors": [out.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("floors", pa.binary())]))
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best inner products of every query with all ``vectors``, whose
    components count as floor(scale * x): (query_id, rank, vec_id, score)."""
    def valid(df):
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
            F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(True)))

    shards = stage(valid(vectors).mapInArrow(_shards(scale), SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = valid(queries).dropDuplicates(["vec_id", "v"])
    asked = stage(asked, "queries")
    parts = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocks = stage(asked.repartition(parts).mapInArrow(_blocks(scale), "dim int, queries int, query_ids binary, query_vecs binary")
                   .withColumn("block", F.monotonically_increasing_id()), "blocks")
    # block numbers and sizes, 16 bytes for a thousand queries
    sizes = blocks.select("block", F.octet_length("query_vecs").alias("size")).orderBy("block").collect()
    firsts = [r[0] for r in shards.groupBy("dim").agg(F.min("shard")).select("min(shard)").collect()]  # one a vector length
    waves, room = [[]], WAVE_BYTES
    for block, size in sizes:
        if waves[-1] and size > room:
            waves.append([])
            room = WAVE_BYTES
        waves[-1].append(block)
        room -= size
    found = None
    for wave in waves:
        own = blocks.where(F.col("block").isin(wave)) if len(waves) > 1 else blocks
        first, rest = shards.where(F.col("shard").isin(firsts)), shards.where(~F.col("shard").isin(firsts))
        # each shard meets each block of the wave; the wave's size is bounded above
        seed = stage(first.join(F.broadcast(own.withColumn("floor", F.lit(None).cast("binary"))), "dim").mapInArrow(_search(k), HIT), "seed")
        floor = seed.repartition("block").mapInArrow(_floors(k), "block long, floors binary")
        known = own.join(floor, "block", "left").withColumn("floor", F.expr("substring(floors, 1, queries * 24)")).drop("floors")
        main = rest.join(F.broadcast(known), "dim").mapInArrow(_search(k), HIT)
        both = seed.unionByName(main)
        found = both if found is None else found.unionByName(both)
    order = Window.partitionBy("block", "number").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_kdtree_topk(spark, sf_dir):
    """Contract query: the 5 best of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
