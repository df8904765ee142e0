"""The streaming profile table: compaction, replays, resumption."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.sources.files import folder_names
from tillsight.streaming import events as ST


def _events(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 90_000))),
             None if u == 0 else int(u), "view", None if i % 11 == 0 else round(float(rng.random() * 9), 2), "{}")
            for i, u in enumerate(np.minimum(rng.integers(0, 30, n), 20))]  # user 20 has a third of all
    return spark.createDataFrame(rows, ST.EVENT_SCHEMA)


def _plain(events):
    parts = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("frequency"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("value_cents"),
        F.max(F.col("ts").cast("timestamp")).alias("last_event"))
    return _rows(parts.select("user_id", "frequency", (F.col("value_cents") / 100.0).alias("monetary"), "last_event"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_many_batches_stay_a_bounded_table(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    table = None
    for run in range(2):  # the second run resumes with its own files only
        _events(spark, 600, run).repartition(7).write.mode("append").parquet(src)
        table = ST.stream_customer_rfm(ST.read_events(spark, src, max_files=1), base=base, compact_every=3)
        assert _rows(ST.latest_profiles(spark, table)) == _plain(spark.read.parquet(src))
    assert sorted(map(int, folder_names(spark, f"{table}/snapshot"))) == [8, 11]
    assert sorted(map(int, folder_names(spark, f"{table}/delta"))) == [9, 10, 11, 12, 13]


@pytest.mark.parametrize("again", [1, 2, 3])
def test_a_batch_run_again_changes_nothing(spark, tmp_path, again):
    table = ST.ProfileTable(spark, str(tmp_path), compact_every=3)
    batches = [_events(spark, 100, s).withColumn("ts", F.col("ts").cast("timestamp")) for s in range(4)]
    for i, b in enumerate(batches):
        table.add(b, i)
        if i == again:  # before, at and after a compaction
            table.add(b, i)
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    assert _rows(ST.latest_profiles(spark, str(tmp_path))) == _plain(whole)


def test_unfinished_snapshot_is_not_read(spark, tmp_path):
    table = ST.ProfileTable(spark, str(tmp_path), compact_every=100)
    b = _events(spark, 100, 5).withColumn("ts", F.col("ts").cast("timestamp"))
    table.add(b, 0)
    (tmp_path / "snapshot" / "0").mkdir(parents=True)
    assert _rows(ST.latest_profiles(spark, str(tmp_path))) == _plain(b)
    table.compact(0)
    assert _rows(ST.latest_profiles(spark, str(tmp_path))) == _plain(b)


def test_no_batch_yet(spark, tmp_path):
    assert ST.latest_profiles(spark, str(tmp_path / "none")).count() == 0
