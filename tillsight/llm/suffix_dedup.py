"""Removal of repeated byte strings by suffix sorting.

Every byte that a string of ``length`` bytes covers which also starts anywhere
else is removed. Suffixes are sorted in shards, by external induced sorting
with common-prefix values (``induced.py``).

Sharding must bring equal strings together. Each window of ``length`` bytes is
given to one of its own places, its anchor: the place with the least hash of
the next GRAM bytes. Equal windows have equal anchors, so a window can only be
repeated if its anchor's bytes are, and all windows of one anchor stand in one
short segment of the text. Anchors whose bytes occur once are done; the
segments of all others go to the shard of their anchor, equal segments once
with their number. A shard's segments, cut to the windows whose surroundings of
the anchor occur twice or more, are suffix-sorted as one string, and a
window that fits its segment is repeated if a neighbour in the order shares
``length`` bytes with it, or its segment stands for several.

A group of copies counts once in each task before anything is shuffled, so a
passage in a third of all documents costs a shard one segment a task. Where the
contexts of a passage make more segments of one anchor than a shard may hold,
``split_hot`` deals their windows out by what lies around them.

Defined results: a null text counts as empty; matches never cross documents;
texts shorter than ``length`` lose nothing; repeated rows are documents of
their own, so they remove each other's text; a null id is kept; an empty table
gives an empty result; extra columns are passed through by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import textvec as tv
from tillsight.llm.common import chunks, flat, lean, split_by, stage, unstage
from tillsight.llm.induced import sorted_suffixes

LENGTH, GRAM = 200, 32
#: Text bytes that one shard sorts, about; copies in a chunk that are counted
#: before the shuffle.
SHARD_BYTES, COPIES = 3 << 19, 8
#: Ranges of distances to the anchor, judged one by one before a shard is sorted.
PARTS = 4
U64 = np.uint64
PLACE = U64((1 << 32) - 1)


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """For every run of windows with one anchor: (document, first window,
    last window, anchor hash, segment hash)."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    run = tv.prefix_hash(data)
    at = np.arange(n - gram + 1)
    least = (tv.span_hash(run, at, at + gram) & ~PLACE) | at.astype(np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    # windows that end within their document
    count = np.maximum(np.diff(off) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1], count)
    anchor = (least[window] & PLACE).astype(np.int64)
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    a, s, e = anchor[first], window[first], window[last]
    key = tv.span_hash(run, a, a + gram)
    own = tv.mix(tv.span_hash(run, s, e + length) + (a - s).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return doc[first], s, e, key, own


_COLS = (("anchor", np.uint64), ("segment", np.uint64), ("row", np.int64), ("start", np.int64), ("size", np.uint16), ("copies", np.uint32))
_BLOCK = "bucket int, " + ", ".join(f"`{c}` binary" for c, _ in _COLS)


def _anchors(buckets, length, gram):
    """Segments in packed blocks: bucket -1 holds those that are known to be
    copies, the other buckets one entry for each segment to be counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in lean(batches):
            for b in chunks(big, "text"):
                doc, s, e, key, own = segments(*flat(b.column(b.schema.get_field_index("text"))), length, gram)
                if not len(doc):
                    continue
                off = flat(b.column(b.schema.get_field_index("text")))[1]
                rows = b.column(b.schema.get_field_index("row")).to_numpy()
                val = {"anchor": key, "segment": own, "row": rows[doc], "start": s - off[doc], "size": e - s + 1}
                _, first, inv, n = np.unique(own + key, return_index=True, return_inverse=True, return_counts=True)
                many = n >= COPIES
                single = np.flatnonzero(~many[inv])
                chosen = np.concatenate([single, first[many]])
                copies = np.ones(len(own), dtype=np.int64)
                copies[first[many]] = n[many]
                of = (key[chosen] % U64(buckets)).astype(np.int64)
                by = chosen[np.argsort(of, kind="stable")]
                cut = np.searchsorted(np.sort(of), np.arange(buckets + 1))
                parts = [(k, by[cut[k]:cut[k + 1]]) for k in range(buckets) if cut[k] < cut[k + 1]]
                known = np.flatnonzero(many[inv])
                if len(known):
                    parts.append((-1, known))
                val["copies"] = copies
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32())] + [
                    pa.array([val[c][p].astype(t).tobytes() for _, p in parts], pa.binary()) for c, t in _COLS], names=["bucket", *(c for c, _ in _COLS)])
    return run


def _unpack(blobs, dtype):
    return np.concatenate([np.frombuffer(x, dtype=dtype) for x in blobs]) if len(blobs) else np.zeros(0, dtype)


_OCCUR = "row long, start long, size int, anchor long, segment long, copies long, chosen boolean"


def _repeated(pdf):
    """Entries of anchors that occur twice or more; the first of each segment
    is chosen to stand for it, with the copies of all."""
    import pandas as pd

    v = {c: _unpack(pdf[c], t) for c, t in _COLS}
    by = np.lexsort((v["segment"], v["anchor"]))
    v = {c: x[by] for c, x in v.items()}
    new = np.concatenate([[True], v["anchor"][1:] != v["anchor"][:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=v["copies"])
    own = np.flatnonzero(total[group] >= 2)
    v = {c: x[own] for c, x in v.items()}
    if not len(own):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("row", "int64"), ("start", "int64"), ("size", "int32"), ("anchor", "int64"), ("segment", "int64"), ("copies", "int64"), ("chosen", "bool"))})
    head = np.concatenate([[True], (v["anchor"][1:] != v["anchor"][:-1]) | (v["segment"][1:] != v["segment"][:-1])])
    sums = np.add.reduceat(v["copies"].astype(np.int64), np.flatnonzero(head))
    copies = np.zeros(len(head), dtype=np.int64)
    copies[head] = sums
    return pd.DataFrame({"row": v["row"], "start": v["start"], "size": v["size"].astype(np.int32), "anchor": v["anchor"].astype(np.int64),
                         "segment": v["segment"].astype(np.int64), "copies": copies, "chosen": head})


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of bucket -1, one row each."""
    for b in lean(batches):
        for i in range(b.num_rows):
            v = {c: np.frombuffer(b.column(b.schema.get_field_index(c))[i].as_py(), dtype=t) for c, t in _COLS}
            n = len(v["row"])
            yield pa.RecordBatch.from_arrays([pa.array(v["row"]), pa.array(v["start"]), pa.array(v["size"].astype(np.int32)), pa.array(v["anchor"].astype(np.int64)),
                                              pa.array(v["segment"].astype(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, bool))],
                                             names=["row", "start", "size", "anchor", "segment", "copies", "chosen"])


def _contents(length):
    """The bytes of chosen segments, cut out of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = {"anchor": [], "segment": [], "copies": [], "content": []}
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for w in wanted:
                        out["anchor"].append(w["anchor"])
                        out["segment"].append(w["segment"])
                        out["copies"].append(w["copies"])
                        out["content"].append(text[w["start"]:w["start"] + w["size"] - 1 + length])
                yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.binary() if c == "content" else pa.int64()) for c in out], names=list(out))
    return run


def repeated_windows(t: np.ndarray, room: np.ndarray, many: np.ndarray, length: int, **how) -> np.ndarray:
    """True at every place of the string where a window starts that fits
    (``room`` to its segment's end) and is repeated: it shares ``length``
    symbols with a neighbour in suffix order, or ``many`` says so."""
    hit = (room >= length) & many
    last, least = -1, length  # the fitting suffix before, and the least value since
    for pos, lcp in sorted_suffixes(t, 257, length, **how):
        fit = np.flatnonzero(room[pos] >= length)
        if not len(fit):
            least = min(least, int(lcp.min()))
            continue
        long = np.append(lcp, np.int32(length))
        between = np.minimum.reduceat(long, np.concatenate([[0], fit + 1]))
        values = between[:-1].copy()
        values[0] = min(values[0], least)
        same = values >= length
        own = pos[fit]
        before = np.concatenate([[last], own[:-1]])
        same &= before >= 0
        hit[own[same]] = True
        hit[before[same]] = True
        last, least = int(own[-1]), int(between[-1])
    return hit


def places(data: np.ndarray, off: np.ndarray, anchor: np.ndarray, gram: int) -> np.ndarray:
    """Where the anchor (the first place with its hash) of each segment stands
    in it; -1 where ``anchor`` is no hash of its bytes (parts of ``split_hot``)."""
    n = len(data) - gram + 1
    if n < 1:
        return np.full(len(anchor), -1)
    prefix, (_, down) = tv.prefix_hash(data), tv._powers(len(data) + 1)
    raw = tv.unmix(anchor.astype(np.uint64)) ^ (np.full(1, gram, dtype=np.uint64) * tv.LENGTH_CODE)
    same = np.flatnonzero((prefix[gram:] - prefix[:-gram]) * down[:n] == np.repeat(raw, np.diff(off))[:n])
    at = np.append(same, len(data))[np.searchsorted(same, off[:-1])]
    return np.where(at + gram <= off[1:], at - off[:-1], -1)


def shared_windows(anchor, copies, size, place, keys, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the bytes of each segment whose windows may be repeated in
    the shard; empty where none are.

    Windows are dealt into PARTS by their distance to the anchor. All windows of
    a part hold the bytes that ``keys`` has hashed, so a window can only be
    repeated if these bytes are, at the same distance to the same anchor."""
    start, end = np.zeros(len(size), dtype=np.int64), size.astype(np.int64)
    least, most = place + length - size, place
    known = (place >= 0) & (least >= 0) & (most <= length - gram)
    who, key = np.concatenate([w for w, _ in keys]), np.concatenate([k for _, k in keys])
    part = np.repeat(np.arange(len(keys)), [len(w) for w, _ in keys])
    _, inv = np.unique(tv.mix(key ^ tv.mix(anchor.astype(np.uint64)[who] + part.astype(np.uint64))), return_inverse=True)
    twice = np.bincount(inv, weights=copies[who])[inv] >= 2
    who, part = who[twice], part[twice]
    low, high = np.array(parts_of(length, gram)).T
    first, last = np.full(len(size), length, dtype=np.int64), np.full(len(size), -1, dtype=np.int64)
    np.minimum.at(first, who, np.maximum(low[part], least[who]))
    np.maximum.at(last, who, np.minimum(high[part], most[who]))
    some = last >= 0
    start[known] = np.where(some, place - last, 0)[known]
    end[known] = np.where(some, place - first + length, 0)[known]
    return start, end


def parts_of(length: int, gram: int) -> list[tuple[int, int]]:
    """Least and greatest distance to the anchor in each part."""
    cut = np.linspace(0, length - gram + 1, PARTS + 1).astype(int).tolist()
    return [(a, b - 1) for a, b in zip(cut, cut[1:], strict=False)]


def part_keys(data: np.ndarray, off: np.ndarray, place: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(segments, hash of the bytes that their windows of the part share) of
    each part."""
    prefix, a = tv.prefix_hash(data), off[:-1] + place
    least, most = place + length - np.diff(off), place
    known, out = (place >= 0) & (least >= 0) & (most <= length - gram), []
    for low, high in parts_of(length, gram):
        own = np.flatnonzero(known & (np.maximum(low, least) <= np.minimum(high, most)))
        out.append((own, tv.span_hash(prefix, a[own] - low, a[own] - high + length)))
    return out


def _shard(length, how, gram=GRAM):
    """Suffix-sort the segments of a shard, without the ends that surely aren't
    repeated; the string is collected in a file. Gives the runs of repeated
    windows of each segment."""
    gram = min(gram, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as f:
            anchor, segment, copies, size, place, text, keys, n = [], [], [], [], [], [], [[] for _ in range(PARTS)], 0
            for big in lean(batches, reuse=True):
                for b in chunks(big, "content"):
                    data, off = flat(b.column(b.schema.get_field_index("content")))
                    for to, c in ((anchor, "anchor"), (segment, "segment"), (copies, "copies")):
                        to.append(b.column(b.schema.get_field_index(c)).to_numpy())
                    size.append(np.diff(off))
                    text.append(data.copy())
                    place.append(places(data, off, anchor[-1], gram))
                    for to, (who, key) in zip(keys, part_keys(data, off, place[-1], length, gram), strict=True):
                        to.append((who + n, key))
                    n += b.num_rows
            if not n:
                return
            anchor, segment, copies, size, place = (np.concatenate(x) for x in (anchor, segment, copies, size, place))
            keys = [tuple(map(np.concatenate, zip(*k, strict=True))) for k in keys]
            begin, stop = shared_windows(anchor, copies, size, place, keys, length, gram)
            own, done = np.flatnonzero(stop > begin), 0
            if not len(own):
                return
            for data in text:  # segments do not cross the chunks
                mine = np.cumsum(size) - size
                here = own[(mine[own] >= done) & (mine[own] < done + len(data))]
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edge, mine[here] + begin[here] - done, 1)
                np.add.at(edge, mine[here] + stop[here] - done, -1)
                kept = data[np.cumsum(edge[:-1]) > 0]
                done += len(data)
                inside = np.ones(len(kept) + len(here), dtype=bool)
                inside[np.cumsum(stop[here] - begin[here]) + np.arange(len(here))] = False
                symbols = np.zeros(len(inside), dtype=np.uint16)
                symbols[inside] = kept.astype(np.uint16) + 1
                f.write(symbols.tobytes())
            del text, keys
            anchor, segment, copies, begin, size = (x[own] for x in (anchor, segment, copies, begin, stop - begin))
            f.flush()
            t = np.memmap(f, dtype=np.uint16, mode="r")
            end = np.cumsum(size + 1) - 1
            start = end - size
            own = np.repeat(np.arange(len(size)), size + 1)
            room = (end[own] - np.arange(len(t))).astype(np.int32)
            hit = repeated_windows(t, room, (copies > 1)[own], length, **how)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            first, last = edge[::2], edge[1::2]  # runs never cross segments: their ends never fit
            seg = own[first]
            cut = np.searchsorted(seg, np.arange(len(size) + 1))
            some = np.flatnonzero(cut[1:] > cut[:-1])
            first, last = ((x - start[seg] + begin[seg]).astype(np.int32) for x in (first, last))
            for lo in range(0, len(some), 4096):
                part = some[lo:lo + 4096]
                at = np.append(cut[part], cut[part[-1] + 1])  # the segments between have no runs
                off = pa.array((at - at[0]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(segment[part])] + [
                    pa.ListArray.from_arrays(off, pa.array(x[at[0]:at[-1]])) for x in (first, last)], names=["anchor", "segment", "first", "last"])
    return run


def _halves(length, gram):
    """Each part (a run of windows of a segment, ``low`` to ``high`` bytes before
    their anchor) as two, which are keyed by the bytes that all windows of the
    half share, whatever the segment."""
    cols = ("of_anchor", "of_segment", "shift", "low", "high", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in lean(batches):
            for b in chunks(big, "content"):
                v = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in cols}
                content = b.column(b.schema.get_field_index("content"))
                data, off = flat(content)
                prefix = tv.prefix_hash(data)
                # the anchor is the first place with its hash
                at = np.arange(max(0, len(data) - gram + 1))
                own = np.repeat(np.arange(b.num_rows), np.diff(off))[:len(at)]
                same = np.flatnonzero(tv.span_hash(prefix, at, at + gram) == v["of_anchor"].astype(np.uint64)[own])
                a = same[np.searchsorted(same, off[:-1])] if len(same) else off[:0]
                most = a - off[:-1]
                least = a + length - off[1:]
                mid = (v["low"] + v["high"]) // 2
                for low, high in ((v["low"], mid), (mid + 1, v["high"])):
                    lo, hi = np.maximum(low, least), np.minimum(high, most)
                    some = np.flatnonzero((low <= high) & (lo <= hi))
                    if not len(some):
                        continue
                    c, k, lo, hi, low, high = a[some], v["of_anchor"].astype(np.uint64)[some], lo[some], hi[some], low[some], high[some]
                    start, end = c - hi, c - lo + length
                    shared = tv.span_hash(prefix, c - low, c - high + length)
                    key = tv.mix(shared ^ tv.mix(k + (low * (length + 1) + high).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
                    part = tv.mix(tv.span_hash(prefix, start, end) + hi.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(v["of_anchor"][some]), pa.array(v["of_segment"][some]), pa.array(v["shift"][some] + start - off[:-1][some]), pa.array(low), pa.array(high),
                        pa.array(v["copies"][some]), pa.array(key.astype(np.int64)), pa.array(part.astype(np.int64)),
                        pa.array([data[x:y].tobytes() for x, y in zip(start, end, strict=True)], pa.binary())],
                        names=[*cols, "anchor", "segment", "content"])
    return run


_PART = "of_anchor long, of_segment long, shift long, low long, high long, copies long, anchor long, segment long, content binary"


def split_hot(content: DataFrame, hot: DataFrame, shard_bytes: int, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Segments for the shards, and where parts of segments stand in them.

    A passage that many texts share has one segment for each of its contexts
    with the same anchor, more than a shard may hold. The windows of such
    segments are halved by their distance to the anchor, and keyed by what all
    windows of the half have in common. Only halves that reach over the
    passage's edge on one side are still alike in key and unlike in content;
    they are halved again, until a half is a single window. Equal windows stay
    together in every step, and a segment leaves a few parts each time."""
    parts = content.join(hot, "anchor", "left_semi").select(
        F.col("anchor").alias("of_anchor"), F.col("segment").alias("of_segment"), F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("low"),
        F.lit(length - gram).cast("long").alias("high"), "copies", "anchor", "segment", "content")
    done = []
    while True:
        parts = stage(parts.mapInArrow(_halves(length, gram), _PART), "parts")
        each = parts.groupBy("anchor", "segment").agg(F.max(F.octet_length("content")).alias("bytes"), F.max(F.col("high") - F.col("low")).alias("width"))
        over = each.groupBy("anchor").agg(F.sum("bytes").alias("bytes"), F.max("width").alias("width"))
        over = stage(over.where((F.col("bytes") > shard_bytes) & (F.col("width") > 0)).select("anchor"), "over")
        if over.isEmpty():
            done.append(parts)
            break
        done.append(parts.join(over, "anchor", "left_anti"))
        parts = parts.join(over, "anchor", "left_semi")
    made = done[0].select(*parts.columns)
    for more in done[1:]:
        made = made.unionByName(more)
    once = made.groupBy("anchor", "segment").agg(F.sum("copies").alias("copies"), F.first("content").alias("content"))
    cold = content.join(hot, "anchor", "left_anti").select("anchor", "segment", "copies", "content")
    return stage(cold.unionByName(once), "segments"), made.select("of_anchor", "of_segment", "shift", "anchor", "segment")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, **how) -> DataFrame:
    """(row, spans): for every document that has repeated windows, their first
    places, as runs (from, to behind the last). ``row`` is ``row_key``."""
    gram = min(gram, length)
    spark = docs.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(row_key(id_col, text_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    src = src.where(F.octet_length("text") >= length)
    found = stage(src.mapInArrow(_anchors(4 * parallel, length, gram), _BLOCK), "anchors")
    counted = found.where("bucket >= 0").groupBy("bucket").applyInPandas(_repeated, _OCCUR)
    occur = stage(counted.unionByName(found.where("bucket < 0").mapInArrow(_known, _OCCUR)), "occurrences")
    unstage(found)
    wanted = occur.where("chosen").groupBy("row").agg(F.collect_list(F.struct("start", "size", "anchor", "segment", "copies")).alias("wanted"))
    texts = split_by(src, F.col("row"), occur.where("chosen"), "row")[0].join(wanted, "row").select("text", "wanted")
    content = stage(texts.mapInArrow(_contents(length), "anchor long, segment long, copies long, content binary"), "segments")
    sizes = content.groupBy("anchor").agg(F.sum(F.octet_length("content")).alias("bytes"))
    total, most = (x or 0 for x in sizes.agg(F.sum("bytes"), F.max("bytes")).first())
    parts = None
    if most > shard_bytes:
        hot = stage(sizes.where(F.col("bytes") > shard_bytes).select("anchor"), "hot")
        content, parts = split_hot(content, hot, shard_bytes, length, gram)
    shards = max(parallel, total // shard_bytes + 1)
    spans = content.repartition(int(shards), "anchor").mapInArrow(_shard(length, how, gram), "anchor long, segment long, first array<int>, last array<int>")
    spans = stage(spans, "spans")
    unstage(content)
    if parts is not None:
        shifted = [F.transform(c, lambda x: x + F.col("shift").cast("int")).alias(c) for c in ("first", "last")]
        spans = spans.unionByName(parts.join(spans, ["anchor", "segment"]).select(F.col("of_anchor").alias("anchor"), F.col("of_segment").alias("segment"), *shifted))
    placed = occur.select("row", "start", "anchor", "segment").join(spans, ["anchor", "segment"])
    runs = placed.select("row", F.expr("transform(arrays_zip(first, last), x -> struct(start + x.first AS a, start + x.last AS b))").alias("runs"))
    out = stage(runs.select("row", F.explode("runs").alias("r")).groupBy("row").agg(F.collect_set("r").alias("spans")), "repeats")
    unstage(occur)
    return out


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _cover(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _remove(names, length, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                size, removed, count, kept = [], [], [], []
                for text, spans in zip(part.column(part.schema.get_field_index("_text")).to_pylist(), part.column(part.schema.get_field_index("_spans")).to_pylist(), strict=True):
                    runs = _cover(spans, length)
                    rest, at, null = [], 0, text is None
                    for x, y in runs:
                        rest.append(text[at:x])
                        at = y
                    rest = b"".join([*rest, (text or b"")[at:]])
                    text = text or b""
                    size.append(len(text))
                    removed.append(len(text) - len(rest))
                    count.append(len(runs))
                    kept.append(hashlib.sha256(rest).hexdigest() if form == "digest" else rest if form == "bytes" else None if null else rest.decode("utf-8", errors="ignore"))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [
                    pa.array(x, pa.int64()) for x in (size, removed, count)] + [pa.array(kept, pa.binary() if form == "bytes" else pa.string())],
                    names=[*names, "_bytes", "_removed", "_runs", "_rest"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, form: str = "bytes", **how) -> DataFrame:
    """``docs`` with ``_bytes``, ``_removed``, ``_runs`` (maximal removed runs)
    and ``_rest`` added: the ``bytes`` left, their ``digest`` (SHA-256, without
    the text), or the ``text`` they spell (null where it was null; pieces of a
    character that a removal has cut go too)."""
    found = repeats(docs, id_col, text_col, length, **how).select(F.col("row").alias("_row"), F.col("spans").alias("_spans"))
    inside, outside = split_by(docs, row_key(id_col, text_col), found, "_row")
    names = [c for c in docs.columns if not (form == "digest" and c == text_col)]
    raw = F.col(text_col).cast("string").cast("binary")
    joined = inside.join(found, row_key(id_col, text_col) == F.col("_row"), "left").select(*(F.col(f"`{c}`") for c in docs.columns), raw.alias("_text"), "_spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    cut = joined.mapInArrow(_remove(names, length, form), f"{kinds}, _bytes long, _removed long, _runs long, _rest {'binary' if form == 'bytes' else 'string'}")
    # texts without repeats stay as they are
    full = F.coalesce(raw, F.lit("").cast("binary"))
    rest = {"bytes": full, "digest": F.sha2(full, 256), "text": F.col(text_col).cast("string")}[form]
    none = F.lit(0).cast("long")
    whole = outside.select(*(F.col(f"`{c}`") for c in names), F.octet_length(full).cast("long").alias("_bytes"), none.alias("_removed"), none.alias("_runs"), rest.alias("_rest"))
    return cut.unionByName(whole)


def op4_suffix_dedup(spark, sf_dir):
    """Contract query: bytes removed from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, form="digest").select(
        "doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_spans"), F.col("_rest").alias("kept_sha256"))
