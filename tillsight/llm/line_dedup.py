"""Line deduplication by a tree of log templates.

Lines are parsed as log messages are: a tree of fixed depth sorts them by their
token count and their first tokens, and each leaf generalises the fields that
vary. A token with a digit, an ``@`` or a ``://`` is a variable field at once.
Within a leaf, a token that fewer than MIN_DOCS documents have at its place is
one too. A line's template is what stays constant; it counts if that is most of
the line. A template recurs if at least MIN_DOCS different documents hold it, or
if it stands in MIN_DOCS documents and in different surroundings in at least half
of them. Copies and near copies of a document count as one, so that lines that
come along with them are left to document deduplication. Every line of a
recurring template is dropped.

Which documents are copies is read off a sample of their word windows, the
SAMPLE lowest hashes, which near copies have mostly in common. A document with
at least OWN of its sample in fewer than MIN_DOCS documents is one of its own;
it counts by the most common of these windows, so that a few copies are one. The
others are copies in larger groups and count by their least common window, if
most documents that hold that window count by it.

All steps are aggregates with partial sums, so one line in a third of all
documents is counted without gathering its rows.

Defined results: a null text counts as empty and stays null where text is
returned; lines without a token are kept and never counted, lines of one or two
tokens are judged as longer ones are; a line may be as long as its document; a
document may end
up with an empty text, never without its row; a null id is kept; repeated rows
count as documents of their own and get equal results; an empty table gives an
empty result; other columns are passed through by ``drop_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import textvec as tv
from tillsight.llm.common import bitmap, chunks, flat, in_bitmap, lean, send, split_by, stage, unstage, utf8

#: Leading tokens that a leaf fixes; documents that make a template recur;
#: tokens of the shortest template; constant part of a template; different
#: surroundings for each document.
DEPTH, MIN_DOCS, MIN_TOKENS, CONSTANT, SURROUNDINGS = 3, 5, 1, 0.7, 0.5
#: Words of a window; sampled windows of a document; the part of them that makes
#: it one of its own.
WINDOW, SAMPLE, OWN = 5, 32, 0.25
U64 = np.uint64
FIELD = U64(0x2545F4914F6CDD1D)  # the hash of any variable field
VARIABLE = np.zeros(256, dtype=bool)
VARIABLE[list(b"0123456789@")] = True


class Lines:
    """Hashes of the tokens, lines and leaves of a chunk of documents; without
    ``whole`` of the tokens and leaves only."""

    def __init__(self, data: np.ndarray, off: np.ndarray, depth: int, whole: bool = True):
        breaks = np.flatnonzero(data == 0x0A)
        # a line starts at each document's start and behind each of its line breaks
        start = np.concatenate([off[:-1], breaks + 1])
        doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
        by = np.lexsort((start, doc))
        self.doc = doc[by]
        self.line_off = np.append(start[by], len(data))
        first, last, bounds = tv.words(data, self.line_off)
        h = tv.span_hash(tv.prefix_hash(data), first, last)
        # the few bytes that make a token a field, and the tokens that hold them
        colon = np.flatnonzero(data[:-2] == 0x3A)
        colon = colon[(data[colon + 1] == 0x2F) & (data[colon + 2] == 0x2F)]
        self.field = np.zeros(len(h), dtype=bool)
        for at in (np.flatnonzero(VARIABLE[data]), colon):
            self.field[np.searchsorted(first, at, side="right") - 1] = True
        h[self.field] = FIELD
        self.tokens, self.bounds, self.count = h, bounds, np.diff(bounds)
        leaf = tv.mix(self.count.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        for k in range(depth):
            has = self.count > k
            at = np.minimum(bounds[:-1] + k, max(len(h) - 1, 0))
            leaf = tv.mix(leaf * U64(0xD6E8FEB86659FD93) + np.where(has, h[at] if len(h) else U64(0), U64(0)))
        self.leaf = leaf
        if not whole:
            return
        self.index = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)
        up, down = tv._powers(len(h) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)])])
        self.line = tv.mix((run[bounds[1:]] - run[bounds[:-1]]) * down[bounds[:-1]] + self.count.astype(np.uint64))
        # the lines around it, blank ones left out, 0 at a document's ends
        full = np.flatnonzero(self.count > 0)
        before, after = np.zeros(len(self.line), np.uint64), np.zeros(len(self.line), np.uint64)
        same = self.doc[full[1:]] == self.doc[full[:-1]]
        before[full[1:][same]] = self.line[full[:-1][same]]
        after[full[:-1][same]] = self.line[full[1:][same]]
        self.around = tv.mix(before * U64(0x9FB21C651E98DF25) + after)


def _samples(x: Lines, docs: np.ndarray) -> list:
    """The lowest different window hashes, of 40 bits, of each of ``docs``
    (ascending)."""
    place = np.full(int(x.doc[-1]) + 1 if len(x.doc) else 0, -1)
    place[docs] = np.arange(len(docs))
    doc = np.repeat(place[x.doc], x.count)
    w = tv.window_hash(x.tokens, WINDOW)
    at = np.flatnonzero((doc[:len(w)] == doc[len(doc) - len(w):]) & (doc[:len(w)] >= 0))
    doc, w = doc[at].astype(np.uint64), w[at] >> U64(24)
    # only hashes below a document's limit are sorted; it lets enough through
    # but for texts that repeat themselves, which are then taken whole
    size = np.bincount(doc.astype(np.int64), minlength=len(docs))
    all_of = 1 << 40
    limit = np.where(size > 8 * SAMPLE, all_of // np.maximum(size, 1) * 4 * SAMPLE, all_of).astype(np.uint64)
    while True:
        low = w < limit[doc.astype(np.int64)]
        # document and hash in one integer, which sorts fast
        held = np.unique((doc[low] << U64(40)) | w[low])
        ends = np.searchsorted(held, np.arange(len(docs) + 1).astype(np.uint64) << U64(40))
        few = (np.diff(ends) < SAMPLE) & (limit < U64(all_of))
        if not few.any():
            break
        limit[few] = all_of
    w = held
    lo, hi = ends[:-1], ends[1:]
    w = (w & U64((1 << 40) - 1)).astype(np.int64)
    first = np.searchsorted(x.doc, docs)
    # a text too short for a window is sampled by its first line
    return [w[a:min(z, a + SAMPLE)] if z > a else x.line[f:f + 1].astype(np.int64) for a, z, f in zip(lo, hi, first)]


def _leaves(depth, min_tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush():
            leaf = np.concatenate([x for x, _ in held])
            leaf, inv = np.unique(leaf, return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(n)], names=["leaf", "docs"])

        for big in lean(batches):
            for b in chunks(big, "text"):
                x = Lines(*flat(b.column(b.schema.get_field_index("text"))), depth, whole=False)
                own = np.flatnonzero(x.count >= min_tokens)
                _, one = np.unique(tv.mix(x.leaf[own] + x.doc[own].astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)
                held.append(np.unique(x.leaf[own[one]], return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 19:
                    yield flush()
                    held.clear()
        if held:
            yield flush()
    return run


def _popular(shared, depth, min_tokens):
    """The lines of popular leaves, with their token hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for big in lean(batches):
            for b in chunks(big, "text"):
                x = Lines(*flat(b.column(b.schema.get_field_index("text"))), depth)
                own = np.flatnonzero((x.count >= min_tokens) & in_bitmap(seen, x.leaf))
                once = np.zeros(len(own), dtype=bool)
                once[np.unique(tv.mix(x.line[own] + x.doc[own].astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]] = True
                size = x.count[own]
                base = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                at = np.repeat(x.bounds[own], size) + np.arange(int(size.sum())) - np.repeat(base[:-1], size)
                tokens = np.where(x.field[at], np.int64(0), x.tokens[at].astype(np.int64)) if len(at) else np.zeros(0, np.int64)
                doc = pa.array(x.doc[own])
                # a document's sample goes with its first line here
                held, head = np.unique(x.doc[own], return_index=True)
                sample: list = [None] * len(own)
                for i, v in zip(head, _samples(x, held)):
                    sample[i] = v
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(doc), b.column(1).take(doc), pa.array(x.index[own].astype(np.int32)), pa.array(x.leaf[own].astype(np.int64)),
                     pa.array(x.line[own].astype(np.int64)), pa.array(x.around[own].astype(np.int64)), pa.array(once),
                     pa.ListArray.from_arrays(pa.array(base), pa.array(tokens)), pa.array(sample, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "line_no", "leaf", "line", "around", "once", "tokens", "sample"])
    return run


def copy_classes(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(text_key, class): texts of one class are copies of each other. Texts
    of larger groups that don't speak for their class are left out."""
    held = lines.where(F.col("sample").isNotNull()).groupBy("text_key").agg(F.count("*").alias("docs"), F.first("sample").alias("sample"))
    held = held.select("text_key", "docs", F.explode("sample").alias("window"))
    common = held.groupBy("window").agg(F.sum("docs").alias("n"))
    held = held.join(common, "window")
    rare = F.col("n") < min_docs
    most = F.max(F.when(rare, F.struct("n", "window")))["window"]
    least = F.min(F.when(~rare, F.struct("n", "window")))
    texts = held.groupBy("text_key").agg(
        F.first("docs").alias("docs"), (F.sum(rare.cast("long")) >= F.lit(OWN) * F.count("*")).alias("own"), most.alias("most"), least.alias("least"))
    texts = stage(texts.select("text_key", "docs", "own", F.when(F.col("own"), F.col("most")).otherwise(F.col("least.window")).alias("class"), F.col("least.n").alias("n")), "classes")
    solid = texts.where(~F.col("own")).groupBy("class").agg(F.sum("docs").alias("docs"), F.max("n").alias("n")).where(F.col("docs") * 2 >= F.col("n")).select("class")
    return texts.where("own").select("text_key", "class").unionByName(texts.where(~F.col("own")).join(solid, "class").select("text_key", "class"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
                    min_tokens: int = MIN_TOKENS, constant: float = CONSTANT, surroundings: float = SURROUNDINGS) -> DataFrame:
    """(doc_id, text_key, numbers) of every document that has lines whose
    template recurs, with their places."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), utf8(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    leaves = src.select("text").mapInArrow(_leaves(depth, min_tokens), "leaf long, docs long").groupBy("leaf").agg(F.sum("docs").alias("docs"))
    shared = send(spark, bitmap(leaves.where(F.col("docs") >= min_docs), "leaf"))
    lines = stage(src.mapInArrow(_popular(shared, depth, min_tokens), f"doc_id {kind}, text_key long, line_no int, leaf long, line long, around long, "
                                 "once boolean, tokens array<long>, sample array<long>"), "lines")
    # distinct lines, their documents and surroundings
    docs_of = F.sum(F.col("once").cast("long"))
    kinds = stage(lines.groupBy("leaf", "line").agg(docs_of.alias("docs"), F.first("tokens").alias("tokens")), "kinds")
    places = kinds.select("leaf", "line", "docs", F.posexplode("tokens").alias("place", "token"))
    common = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != 0)).drop("n")
    # the template: its leaf and the places and tokens that stay
    fixed = places.join(common, ["leaf", "place", "token"]).groupBy("leaf", "line").agg(
        F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("place", "token")).alias("template"))
    template = kinds.select("leaf", "line", "docs", F.size("tokens").alias("size")).join(fixed, ["leaf", "line"]).where(
        F.col("fixed") >= F.col("size") * constant).select("leaf", "line", "docs", "template")
    around = lines.where("once").select("leaf", "line", "around").distinct().join(template, ["leaf", "line"]).groupBy("leaf", "template", "around").agg(
        F.lit(1).alias("one")).groupBy("leaf", "template").agg(F.count("*").alias("places"))
    varied = template.groupBy("leaf", "template").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).join(around, ["leaf", "template"]).where(
        F.col("places") >= F.col("docs") * surroundings).select("leaf", "template")
    # documents that count, copies as one; a constant line must have them all, as
    # what varies in a template may be all that its documents have of their own
    holders = lines.where("once").select("leaf", "line", "text_key").distinct().join(copy_classes(lines, min_docs), "text_key").select("leaf", "line", "class").distinct()
    shared_by = holders.groupBy("leaf", "line").agg(F.count("*").alias("classes")).where(F.col("classes") >= min_docs)
    often = varied.unionByName(template.join(shared_by, ["leaf", "line"]).select("leaf", "template")).distinct()
    bad = template.join(often, ["leaf", "template"]).select("leaf", "line")
    found = lines.select("doc_id", "text_key", "line_no", "leaf", "line").join(bad, ["leaf", "line"])
    out = stage(found.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("numbers")), "recurring")
    unstage(lines)
    unstage(kinds)
    return out


def _drop(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in lean(batches):
            for b in chunks(big, "_text"):
                out, total, gone = [], [], []
                numbers = b.column(b.schema.get_field_index("_numbers"))
                for i, t in enumerate(b.column(b.schema.get_field_index("_text"))):
                    t, own = t.as_py(), set(numbers[i].as_py() or ())
                    total.append((t or "").count("\n") + 1)
                    gone.append(len(own))
                    out.append("\n".join([x for k, x in enumerate(t.split("\n")) if k not in own]) if own else t)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                                 names=[*names, "_kept", "_lines", "_gone"])
    return run


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with ``_kept`` (the text without recurring lines), ``_lines``
    and ``_gone`` (lines, and lines dropped) added."""
    found = recurring_lines(docs, id_col, text_col, **how).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("numbers").alias("_numbers"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key"))
    inside, outside = split_by(docs, F.xxhash64(text_col), found, "_key")
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(text_col).cast("string")
    joined = inside.join(found, same, "left").select(*own, text.alias("_text"), "_numbers")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = joined.mapInArrow(_drop(docs.columns), f"{kinds}, _kept string, _lines long, _gone long")
    # texts without recurring lines stay as they are
    breaks = F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))
    whole = outside.select(*own, text.alias("_kept"), (breaks + 1).cast("long").alias("_lines"), F.lit(0).cast("long").alias("_gone"))
    return cut.unionByName(whole)


def op7_line_templates(spark, sf_dir):
    """Every document without the lines of recurring templates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.col("_kept").alias("text"))
