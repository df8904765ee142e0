"""Local stand-in for the driver's correctness gate: run a Spark query and its
DuckDB oracle on the same parquet tables and compare row count, column names
and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=6):
    import datetime as _dt
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        v = float(v)
        if math.isnan(v):
            return None
        return round(v, digits) + 0.0
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, _dt.datetime):
        v = v.replace(tzinfo=None)
        return v.isoformat(sep=" ") if (v.hour, v.minute, v.second, v.microsecond) != (0, 0, 0, 0) \
            else v.date().isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), digits)
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x, digits) for x in v.tolist())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def frame_hash(pdf: pd.DataFrame, digits=6):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x, digits) for x in r) for r in pdf[cols].itertuples(index=False)]
    rows = sorted(rows, key=repr)
    return cols, len(rows), hashlib.sha256(repr(rows).encode()).hexdigest(), rows


def compare(spark, name, fn, sql, sf_dir, show=5):
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    con = duck(sf_dir)
    dp = con.execute(sql).df()
    a, b = frame_hash(sp), frame_hash(dp)
    ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    if not ok:
        print(f"MISMATCH {name}: cols {a[0]} vs {b[0]}; rows {a[1]} vs {b[1]}", file=sys.stderr)
        sa, sb = set(a[3]), set(b[3])
        print("  spark-only:", list(sa - sb)[:show], file=sys.stderr)
        print("  duck-only: ", list(sb - sa)[:show], file=sys.stderr)
    return ok, a[1]
