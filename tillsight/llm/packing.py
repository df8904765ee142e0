"""Best-fit packing by a configuration linear program.

Documents are tokenized and cut into pieces of at most one sequence. The
histogram of piece lengths (one entry a length, whatever the corpus size) goes
to the driver, which solves the configuration program: a configuration says
how many pieces of each length share a sequence, and as few as possible are to
cover the histogram. Multiplicative weights hold the price of each length, a
knapsack dynamic program over the capacity finds the configuration of the
highest price, and lengths that were covered less than others become dearer.
The fractional solution is rounded down; the rest is packed by configurations
that take the longest piece left and the best fitting rest (a bounded knapsack
over what is left). Pieces then find their place by their rank among pieces of
equal length: Spark ranks them in salted groups, and the plan, whose size
depends on the number of lengths only, maps a rank to a sequence and offset.

Defined results: a null text counts as empty (its only token is the
separator); a null id is kept; repeated rows are packed row by row; an empty
table gives no pieces; only named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.bpe import broadcast_spec, shared_tokenizer
from tillsight.llm.common import lean, send, stage

CAPACITY = 2048
#: Pricing rounds, weight rate, and the part of the scarcest length that a
#: round covers.
ROUNDS, RATE, STEP = 240, 0.08, 0.5
#: Rows that share one ranking group, about.
GROUP_ROWS = 4096


def price(capacity: int, lengths: np.ndarray, value: np.ndarray) -> dict[int, int]:
    """Unbounded knapsack by dynamic programming over the capacity: the
    configuration of the highest value, as {index of length: count}."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        v = best[c - lengths[:fit[c]]] + value[:fit[c]]
        i = int(v.argmax())
        best[c], pick[c] = v[i], i
    out: dict[int, int] = {}
    c = capacity
    while pick[c] >= 0:
        i = int(pick[c])
        out[i] = out.get(i, 0) + 1
        c -= int(lengths[i])
    return out


def fractional(capacity: int, lengths: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> list[tuple[dict, float]]:
    """Configurations with their (fractional) numbers, by multiplicative weights."""
    covered = np.zeros(len(lengths))
    out = []
    for _ in range(rounds):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        idx = np.flatnonzero(open_)
        weight = np.exp(RATE * (1 - covered[idx])) * lengths[idx] / capacity
        config = {int(idx[i]): k for i, k in price(capacity, lengths[idx], weight).items()}
        room = min((1 - covered[i]) * count[i] / k for i, k in config.items())
        x = max(room * STEP, min(room, 1.0))
        for i, k in config.items():
            covered[i] += x * k / count[i]
        out.append((config, x))
    return out


def fill(room: int, lengths: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """Bounded knapsack: the fullest choice of the pieces left, longer pieces
    first among equals."""
    out: dict[int, int] = {}
    idx = np.flatnonzero((left > 0) & (lengths <= room))[::-1]
    items = []  # each length in powers of two
    for i in idx:
        n, k = min(int(left[i]), room // int(lengths[i])), 1
        while n > 0:
            items.append((int(i), min(k, n)))
            n -= k
            k *= 2
    reach = 1  # bit c: some choice of the items so far has length c
    steps = []
    for i, k in items:
        steps.append((i, k, reach))
        reach |= reach << (int(lengths[i]) * k)
        reach &= (1 << room + 1) - 1
        if reach >> room:
            break
    c = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> c & 1:
            out[i] = out.get(i, 0) + k
            c -= int(lengths[i]) * k
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[({length: count}, number of sequences)] that hold the histogram
    exactly. Where long pieces prevail and rounding costs more than the program
    gains, the plan that rounds everything down to nothing is the smaller."""
    return min((_rounded(histogram, capacity, r) for r in (rounds, 0)), key=lambda plan: sum(m for _, m in plan))


def _rounded(histogram: dict[int, int], capacity: int, rounds: int) -> list[tuple[dict[int, int], int]]:
    plan = []
    if histogram.get(capacity):
        plan.append(({capacity: 1}, histogram[capacity]))
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0 and k < capacity), dtype=np.int64)
    if not len(lengths):
        return plan
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)

    def take(config, most):
        m = int(min(most, *(left[i] // k for i, k in config.items())))
        if m > 0:
            for i, k in config.items():
                left[i] -= m * k
            plan.append(({int(lengths[i]): k for i, k in config.items()}, m))

    for config, x in fractional(capacity, lengths, left.astype(float), rounds):
        take(config, int(x + 1e-9))
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        config = fill(capacity - int(lengths[top]), lengths, left)
        left[top] += 1
        config[top] = config.get(top, 0) + 1
        take(config, int(left.max()))
    return plan


def _pieces(spec, capacity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared_tokenizer(spec, keep_labels=False)
        step = 4 * capacity
        for b in lean(batches, keep="tokenizer"):
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                row, piece, length, crc = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = tok.encode(text.as_py()) + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), step)):
                        own = ids[at:at + step]
                        row.append(i)
                        piece.append(k)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                k = np.array(piece, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(k), pa.array(k.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: ids and a separator, cut where longer
    than a sequence."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_pieces(broadcast_spec(docs.sparkSession, tokenizer_path), capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def slots(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: first rank of a run of places, places a
    sequence, first sequence, first offset."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for config, m in plan:
        at = 0
        for length, k in sorted(config.items(), reverse=True):
            r = ranks.get(length, 0)
            out.setdefault(length, []).append((r, k, base, at))
            ranks[length] = r + k * m
            at += k * length
        base += m
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in lean(batches):
            names = b.schema.names
            length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            by = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[by])) + 1
            for own in np.split(by, cut) if len(by) else ():
                first, k, base, at = table[int(length[own[0]])]
                i = np.searchsorted(first, rank[own], side="right") - 1
                place = rank[own] - first[i]
                seq[own] = base[i] + place // k[i]
                off[own] = at[i] + place % k[i] * length[own]
            keep = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(names.index(n)) for n in keep] + [pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])
    return run


def assign(made: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of a staged table with a
    ``length`` of 1 to ``capacity``."""
    spark = made.sparkSession
    hist = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    table = send(spark, slots(solve(hist, capacity, rounds)))
    if not hist:
        return made.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # a length that many pieces share is ranked in several groups
    many = spark.createDataFrame([(k, max(1, -(-n // GROUP_ROWS))) for k, n in hist.items()], "length long, groups long")
    rows = made.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(many), "length")
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), "groups")).drop("groups")
    size = rows.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    base = size.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).drop("_n")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("_row")).cast("long") - 1)
    ranked = ranked.join(base, ["length", "_group"]).withColumn("rank", F.col("rank") + F.col("_base")).select(*made.columns, "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return ranked.mapInArrow(_assign(table), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return assign(stage(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces"), capacity)


def op6_best_fit_packing(spark, sf_dir):
    """Contract query: all documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
