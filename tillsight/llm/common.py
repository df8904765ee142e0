"""Shared helpers: reading tables, staging results in the cluster's shared
folder, and cutting Arrow batches into chunks of bounded text size."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import checkpoint_dir

#: Text bytes handled by one vectorised step inside a task.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint directory, in
    subfolders by the columns ``by``, and return the reread table: lineage ends there, any executor can read it, and
    losing one costs nothing. Shuffle files of the finished job are then free
    to go, so the driver's garbage is collected at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    release(spark)
    return (spark.read.schema(df.schema) if by else spark.read).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the staged table behind ``df``, which nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no plan refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slim(spark: SparkSession) -> None:
    """Executors collect their garbage and give back the heap that it took: a
    heap that has grown otherwise stays so for all later work, beside the Python
    workers and the buffers. One short task a core."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").collect()


#: Broadcasts that plans of this session may still read.
_SHARED: list = []


def send(spark: SparkSession, value):
    """Broadcast ``value``; ``unshare`` lets go of it on the executors."""
    out = spark.sparkContext.broadcast(value)
    _SHARED.append(out)
    return out


def unshare() -> None:
    """Drop the executors' copies of what was shared so far. A plan that still
    reads one gets it from the driver again."""
    while _SHARED:
        _SHARED.pop().unpersist()


#: What a worker keeps from task to task, by kind.
HELD: dict = {}


def lean(batches, reuse: bool = False, keep: str = ""):
    """The batches of a task, in a worker that gives freed memory back to the
    system: workers live on from task to task, and several share an executor's
    memory with its JVM. With ``reuse`` freed blocks are kept until the task
    ends, where mapping new ones would cost more than the work on them. Tables
    that tasks of another kind have kept are dropped; ``keep`` names its own."""
    for kind in [k for k in HELD if k != keep]:
        del HELD[kind]
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, (32 if reuse else 1) << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, (256 if reuse else 1) << 20)  # M_TRIM_THRESHOLD
    try:
        yield from batches
    finally:
        gc.collect()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def utf8(col: str) -> Column:
    """Column as binary UTF-8, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def chunks(batch: pa.RecordBatch, col: str, limit: int = CHUNK_BYTES):
    """Slices of an Arrow batch whose ``col`` (binary) holds at most ``limit``
    bytes, or a single row where that row alone is longer."""
    n = batch.num_rows
    if n == 0:
        return
    arr = batch.column(batch.schema.get_field_index(col))
    off = offsets(arr)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def offsets(arr: pa.Array) -> np.ndarray:
    """Value offsets of a (sliced) binary or string array, as int64."""
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    kind = np.int64 if wide else np.int32
    buf = arr.buffers()[1]
    if buf is None or len(arr) == 0:
        return np.zeros(len(arr) + 1, dtype=np.int64)
    return np.frombuffer(buf, dtype=kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a null-free binary array as one uint8 view, and offsets from 0."""
    off = offsets(arr)
    buf = arr.buffers()[2]
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


#: Bits of a membership map. It is sent to all executors whatever the number of
#: members; more members only let more others through, to an exact join.
MAP_BITS = 1 << 24


def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """MAP_BITS bits, set for the values of a 64-bit hash column. Spark ors
    them into MAP_BITS / 64 words at most, which the driver takes over."""
    bit = F.col(col).bitwiseAND(F.lit(MAP_BITS - 1))
    words = df.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.uint64) & np.uint64(MAP_BITS - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def split_by(df: DataFrame, key: Column, members: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may have their 64-bit ``key`` among ``members.col``,
    and rows that surely don't. Only the former need a shuffle for the exact
    join, so most texts stay where they are read."""
    shared = send(df.sparkSession, bitmap(members, col))

    def pick(inside):
        def run(batches):
            for b in lean(batches):
                hit = in_bitmap(shared.value, b.column(b.num_columns - 1).to_numpy())
                b = b.drop_columns([b.schema.names[-1]])
                yield b.filter(pa.array(hit if inside else ~hit))
        return df.withColumn("_hash", key).mapInArrow(run, df.schema)

    return pick(True), pick(False)
