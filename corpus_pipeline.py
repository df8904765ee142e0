"""Corpus pipeline: quality rules, line deduplication, near-duplicate
documents, repeated passages, packing.

Each stage takes the documents that its predecessor left, and its decisions
take effect: rejected documents and all but the first of each group of near
duplicates go, recurring lines and repeated passages leave the texts (and
``n_chars`` follows). The last stage returns the packed token pieces. Rows
without an id are never near duplicates of others; rows that repeat an id stay
or go together; an empty table gives empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import slim, split_by, stage, unshare
from tillsight.llm.line_dedup import drop_lines
from tillsight.llm.ngram_join import near_duplicates
from tillsight.llm.packing import pack_documents
from tillsight.llm.quality import keep_good
from tillsight.llm.suffix_dedup import remove_repeats


#: Arrow hands texts to tasks in batches of at most this size.
BATCH = "8m"


def fresh(step: Callable) -> Callable:
    """A stage that first lets go of what earlier ones have left on executors,
    heap that was grown included, and gets its texts in small batches."""
    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        unshare()
        slim(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return step(spark, docs, sf_dir)
    return run


@fresh
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def _with_text(made: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return made.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


@fresh
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(drop_lines(docs), docs, "_kept")


@fresh
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    later = stage(near_duplicates(docs).where("doc_id <> component_id").select("doc_id", F.xxhash64("doc_id").alias("key")).distinct(), "later")
    inside, outside = split_by(docs, F.xxhash64("doc_id"), later, "key")
    return inside.join(later, "doc_id", "left_anti").select(*docs.columns).unionByName(outside)


@fresh
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(remove_repeats(docs, form="text"), docs, "_rest")


@fresh
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near), ("suffix-array dedup", passages), ("best-fit packing", packing)]

#: Perplexity, components and packing have no SQL. tests/llm compares the first
#: four stages with brute-force versions on sf0.001 (quality rules in
#: test_quality_model, line dedup in test_line_rules, with the module's hashes of
#: sampled windows); of packing it checks the layout and the number of sequences.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
