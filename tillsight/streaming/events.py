"""Structured Streaming versions of the daily series, dedupe and running
customer profile, over an event log (event_id, ts, user_id, event_type,
value, props).

Every query writes to a durable sink under the shared checkpoint folder
(with its own streaming checkpoint, so a restarted query resumes where it
stopped) and is read back as a table; nothing is held in driver memory.
``run_available`` drives a query with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import checkpoint_dir
from tillsight.sources.files import folder_names, is_folder, path_exists, remove

EVENT_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                "value double, props string")


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A streaming read of parquet event files; ``ts`` is cast to TIMESTAMP
    because watermarks do not accept TIMESTAMP_NTZ. ``path`` is a folder or
    one file, on any file system that Spark reads."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet") and not is_folder(spark, path):
        # a single file: stream its folder, filtered to that file name
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per calendar day (tumbling window): events, value, distinct users.

    Distinct users are exact: a first aggregation keeps one row per (day,
    user); a chained second aggregation counts them per day. Rows later
    than the watermark (max event time - ``delay``) are dropped; a day is
    emitted (append mode) once the watermark passes its end."""
    per_user = (events.withWatermark("ts", delay)
                .groupBy(F.window("ts", "1 day").alias("w"), "user_id")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("c")))
    return (per_user.groupBy(F.col("w"))
            .agg(F.sum("n").alias("events"), F.sum("c").alias("value_cents"),
                 F.count(F.lit(1)).alias("users"))
            .select(F.to_date(F.col("w.start")).alias("date"), "events",
                    (F.col("value_cents") / 100.0).alias("value"), "users"))


def stream_dedupe(events: DataFrame, keys=("event_id",), delay: str = "1 hour") -> DataFrame:
    """Drop repeated events (same keys) arriving within ``delay`` of each
    other; state is evicted once the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(df: DataFrame, name: str, mode: str = "append", root: str | None = None,
                  partition_by=(), base: str | None = None) -> str:
    """Run a streaming query over everything available now into a parquet
    sink; return the output path. Passing the same ``base`` again resumes
    from its checkpoint (new files only, watermark and state kept)."""
    spark = df.sparkSession
    base = base or os.path.join(root or checkpoint_dir(spark), "streams",
                                f"{name}-{uuid.uuid4().hex[:8]}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ck)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(out)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


PROFILE_SCHEMA = "user_id long, frequency long, value_cents long, last_event timestamp"


def merge_profiles(parts: DataFrame) -> DataFrame:
    """One profile per user from partial ones (sums and a maximum, so they
    merge in any grouping; a hot user is combined before the shuffle)."""
    return parts.groupBy("user_id").agg(F.sum("frequency").alias("frequency"), F.sum("value_cents").alias("value_cents"),
                                        F.max("last_event").alias("last_event"))


class ProfileTable:
    """Running profiles, keyed by user, as a snapshot and the batches after it.

    A micro-batch writes its own partial profiles to ``delta/<batch>``. Every
    ``compact_every`` batches the newest snapshot and the deltas after it become
    ``snapshot/<batch>``; what an older snapshot had is then deleted, but for the
    one before, which a reader may still hold. So the table holds two rows a user
    at most, and the rows of the batches since. The stream itself keeps no state.

    A batch that is run again after a failure replaces its own delta, and a
    snapshot counts once its ``_SUCCESS`` file is there. Deltas up to the
    snapshot are not read, so a batch already in it isn't counted twice."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 10):
        self.spark, self.path, self.compact_every = spark, path, compact_every

    def _done(self, kind: str) -> list[int]:
        folder = f"{self.path}/{kind}"
        return sorted(int(n) for n in folder_names(self.spark, folder)
                      if path_exists(self.spark, f"{folder}/{n}/_SUCCESS"))

    def _rows(self, newest: int | None, deltas: list[int]) -> DataFrame:
        paths = [f"{self.path}/delta/{d}" for d in deltas] + ([] if newest is None else [f"{self.path}/snapshot/{newest}"])
        return merge_profiles(self.spark.read.schema(PROFILE_SCHEMA).parquet(*paths) if paths
                              else self.spark.createDataFrame([], PROFILE_SCHEMA))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Store the events of a micro-batch."""
        part = (batch.groupBy("user_id")
                .agg(F.count(F.lit(1)).alias("frequency"),
                     F.sum(F.rint(F.col("value") * 100).cast("long")).alias("value_cents"),
                     F.max("ts").alias("last_event")))
        part.write.mode("overwrite").parquet(f"{self.path}/delta/{batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Fold the deltas up to ``upto`` into a snapshot and delete what two
        snapshots no longer need."""
        done = self._done("snapshot")
        if upto not in done:
            before = max((s for s in done if s < upto), default=None)
            deltas = [d for d in self._done("delta") if d <= upto and (before is None or d > before)]
            self._rows(before, deltas).write.mode("overwrite").parquet(f"{self.path}/snapshot/{upto}")
            done = sorted([*done, upto])
        for old in done[:-2]:
            remove(self.spark, f"{self.path}/snapshot/{old}")
        for d in self._done("delta"):
            if len(done) > 1 and d <= done[-2]:
                remove(self.spark, f"{self.path}/delta/{d}")

    def read(self) -> DataFrame:
        """The newest profile of every user."""
        newest = max(self._done("snapshot"), default=None)
        return self._rows(newest, [d for d in self._done("delta") if newest is None or d > newest])


def stream_customer_rfm(events: DataFrame, name: str = "customer_rfm", root: str | None = None,
                        base: str | None = None, compact_every: int = 10) -> str:
    """Running per-user frequency, value and last event of a stream, in a
    ``ProfileTable``; returns its path for ``latest_profiles``. Passing the same
    ``base`` again resumes with new files only."""
    spark = events.sparkSession
    base = base or os.path.join(root or checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    table, ck = os.path.join(base, "table"), os.path.join(base, "checkpoint")

    def sink(batch: DataFrame, batch_id: int):
        ProfileTable(batch.sparkSession, table, compact_every).add(batch, batch_id)

    q = (events.select("user_id", "value", "ts").writeStream.option("checkpointLocation", ck)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return table


def latest_profiles(spark: SparkSession, table: str) -> DataFrame:
    """Newest row per user of a ``stream_customer_rfm`` table."""
    return ProfileTable(spark, table).read().select(
        "user_id", "frequency", (F.col("value_cents") / 100.0).alias("monetary"), "last_event")
