"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in what is missing, so that tests and the bench run on ``local[N]`` with the
same code paths.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for correctness (time zone, ANSI) and for the plans we
# want (AQE coalescing, skew-join splitting, a size-checked broadcast cap).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files once their data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tillsight", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    It is read from the session. Only when it is unset (local tests) is a
    scratch folder created and registered, so lineage cuts still work.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="tillsight-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Bytes that a task scans, and bytes and rows that it gets from a shuffle, about,
#: while a shared table is made. A task's maps and sorts hold some ten times the
#: compressed bytes.
SCAN_BYTES, SHUFFLE_BYTES, SHUFFLE_ROWS = 32 << 20, 16 << 20, 250_000


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Jobs run inside have tasks of bounded size, so that their maps and sorts
    stay in memory whatever the input: more tasks, not larger ones, for more of
    the ``rows``. Smaller sizes that the session sets are kept."""
    def size(key):
        return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))

    wanted = {key: str(most) for key, most in (("spark.sql.files.maxPartitionBytes", SCAN_BYTES),
                                               ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES)) if size(key) > most}
    parts = -(-rows // SHUFFLE_ROWS)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts:
        wanted["spark.sql.shuffle.partitions"] = str(parts)
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return the reread frame.

    It cuts the logical plan, so every later job plans against a file scan
    instead of re-analysing the whole lineage; the scan reads only the columns
    and row groups that a query asks for; and the data survives the loss of an
    executor (unlike ``persist`` blocks or ``localCheckpoint``)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
