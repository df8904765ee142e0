"""File sources and sinks: CSV exports with inconsistent headers, sheet
unions, and staged Parquet tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.schema import COLUMN_ALIASES, NULL_WORDS, REQUIRED_COLUMNS
from tillsight.session import checkpoint_dir


def normalize_columns(df: DataFrame, aliases: dict = COLUMN_ALIASES) -> DataFrame:
    """Give the headers their canonical names; case and outer blanks don't
    matter, a name without an alias only loses its blanks. Pure analysis-time
    renaming, no job."""
    def canonical(header: str) -> str:
        bare = header.strip()
        return aliases.get(bare.lower(), bare)

    return df.toDF(*map(canonical, df.columns))


def check_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Fail before any job if a required column is absent."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing {', '.join(absent)} among {', '.join(df.columns)}")
    return df


def read_transactions(spark: SparkSession, paths: str | Sequence[str], encoding: str = "ISO-8859-1",
                      multi_line: bool = True) -> DataFrame:
    """Read CSV exports (Latin-1, header row) into the canonical columns.

    Each path is read by its own header and the paths are united by name, so
    their column orders may differ; the files of one folder must share one
    header (another one fails). Quotes inside quoted fields are doubled, and
    fields may hold line breaks. ``multi_line=False`` splits large files over
    tasks, for exports that are known to have no line break in a field.

    Every column is read as text, ``NULL_WORDS`` become null, and the numbers
    are cast by name, before any dedupe, so "2.50" and "2.5" compare equal.
    InvoiceDate and Description stay raw text until the cleaning chain parses
    them."""
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("escape", '"').option("multiLine", multi_line).option("enforceSchema", False)
              .option("mode", "PERMISSIVE"))
    df = union_sources(check_columns(normalize_columns(reader.csv(p)))
                       for p in ([paths] if isinstance(paths, str) else paths))
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_WORDS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.withColumns({
        "Quantity": F.expr("try_cast(Quantity AS DOUBLE)"),
        "UnitPrice": F.expr("try_cast(UnitPrice AS DOUBLE)"),
        "CustomerID": F.coalesce(F.expr("try_cast(CustomerID AS BIGINT)"),
                                 F.expr("try_cast(try_cast(CustomerID AS DOUBLE) AS BIGINT)")),
    })


def union_sources(dfs: Iterable[DataFrame]) -> DataFrame:
    """Concatenate sheets/files by column name; a column missing in one
    source is null there."""
    dfs = list(dfs)
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def stage_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """Location of a staged table: under ``root`` or the cluster's shared
    checkpoint folder (never a machine-local temp folder)."""
    return os.path.join(root or checkpoint_dir(spark), "stages", name)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new location at each call: a lazy result that reads an earlier one
    keeps its files."""
    return stage_path(spark, f"{name}-{uuid.uuid4().hex}")


def source_stamp(spark: SparkSession, paths: Iterable[str]) -> tuple:
    """(path, bytes, modification time) of each file or folder, through the
    Hadoop file system, so that remote paths work."""
    return tuple((p, s.getLen(), s.getModificationTime()) for p in paths
                 for s in [_file_system(spark, p).getFileStatus(_hadoop_path(spark, p))])


def path_exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_hadoop_path(spark, path))


def is_folder(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path) and _file_system(spark, path).getFileStatus(_hadoop_path(spark, path)).isDirectory()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries; none if it doesn't exist."""
    if not path_exists(spark, path):
        return []
    return [s.getPath().getName() for s in _file_system(spark, path).listStatus(_hadoop_path(spark, path))]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table that this library wrote."""
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_stage(df: DataFrame, path: str, by: Sequence[str] = (), sort_by: Sequence[str] = (),
                fmt: str = "parquet") -> str:
    """Persist a stage output (overwrite), optionally partitioned by columns
    (directory pruning on read) and sorted inside each file (min/max
    statistics become selective for range filters); no global sort."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    w = out.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w.option("header", True).option("ignoreLeadingWhiteSpace", False) \
         .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with header, the format of the downloadable tables."""
    return write_stage(df, path, fmt="csv")
