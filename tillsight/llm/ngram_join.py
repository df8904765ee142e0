"""N-gram Jaccard join with a prefix tree.

Every document is the set of its word n-grams, as 64-bit hashes in one global
order: rare n-grams first, the most frequent ones last. Two sets that are
similar enough share an n-gram within a short prefix, at places that leave room
for the overlap still needed. Equal sets are one class; classes that share a
prefix n-gram are candidates.

Groups of many near copies are not expanded into pairs. Each shared n-gram
first links its classes to one of them (the one with the most shared prefix),
and components are formed. Only classes outside the largest component of an
n-gram are then compared with the rest of it, in other components, under the
same length bounds. Every pair is thus either compared, or known to be in one
component, or excluded by a bound: no link between components is lost.

Comparisons go through a prefix tree: the ordered sets that one class is
compared with are walked in tree order, so that sets with a common beginning
share its partial overlap, and a branch is left as soon as the elements that
remain cannot reach the overlap needed.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text with fewer words than n is one n-gram; a
null id keeps its row with a null component where it is alone; rows with the
same id are judged by their texts; an empty table gives an empty result; only
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import textvec as tv
from tillsight.llm.common import chunks, flat, lean, send, split_by, stage, unstage, utf8
from tillsight.llm.components import connected_components

N, PERCENT = 5, 80
#: N-grams that the order puts last, by their corpus counts: at most HEAVY, and
#: only those counted HEAVY_COUNT times. The choice only steers the work.
HEAVY, HEAVY_COUNT = 1 << 18, 16
U64 = np.uint64


def shingles(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all documents, document by document, and the
    n-grams before each document."""
    data = tv.LOWER[data]
    start, end, bounds = tv.words(data, off)
    h = tv.span_hash(tv.prefix_hash(data), start, end)
    count = np.diff(bounds)
    doc = tv.doc_of(bounds)
    grams = tv.window_hash(h, n)
    inside = doc[:len(grams)] == doc[n - 1:] if len(grams) else np.zeros(0, dtype=bool)
    out, owner = [grams[inside]], [doc[:len(grams)][inside]]
    for k in range(1, n):  # the whole sequence of a shorter text
        own = np.flatnonzero(count == k)
        if len(own):
            out.append(tv.window_hash(h, k)[bounds[own]])
            owner.append(own)
    out, owner = np.concatenate(out), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return out[by], np.searchsorted(owner[by], np.arange(len(off)))


def _frequent(buckets: int):
    """Corpus counts of 32-bit fingerprints, as packed blocks for a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged():
            keys = np.concatenate([k for k, _ in held])
            keys, inv = np.unique(keys, return_inverse=True)
            return keys, np.bincount(inv, weights=np.concatenate([c for _, c in held])).astype(np.uint32)

        def flush():
            keys, count = merged()
            of = keys % buckets
            by = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[by], np.arange(buckets + 1))
            own = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            out = []
            for b in own:  # first the keys counted more than once, with their counts
                some = by[cut[b]:cut[b + 1]]
                some = some[np.argsort(count[some] == 1, kind="stable")]
                more = count[some][count[some] > 1]
                out.append((keys[some].tobytes(), np.minimum(more, 65535).astype(np.uint16).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())],
                                              names=["bucket", "keys", "counts"])

        for big in lean(batches):
            for b in chunks(big, "text"):
                h, _ = shingles(*flat(b.column(b.schema.get_field_index("text"))))
                held.append(np.unique((h >> U64(32)).astype(np.uint32), return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    yield flush()
                    held.clear()
        if held:
            yield flush()
    return run


def heavy_table(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams' fingerprints, sorted, with the binary
    logarithm of their corpus counts. Counted over all documents; the driver
    gets HEAVY entries at most."""
    spark = src.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, HEAVY // buckets)

    def top(pdf):
        import pandas as pd

        keys = np.concatenate([np.frombuffer(k, dtype=np.uint32) for k in pdf["keys"]])
        count = np.ones(len(keys), dtype=np.int64)
        at = 0
        for k, c in zip(pdf["keys"], pdf["counts"], strict=True):
            more = np.frombuffer(c, dtype=np.uint16)
            count[at:at + len(more)] = more
            at += len(k) // 4
        keys, inv = np.unique(keys, return_inverse=True)
        total = np.bincount(inv, weights=count).astype(np.int64)
        own = np.flatnonzero(total >= HEAVY_COUNT)
        if len(own) > most:
            own = own[np.argsort(-total[own], kind="stable")[:most]]
        return pd.DataFrame({"fingerprint": keys[own].astype(np.int64), "level": np.minimum(np.log2(total[own]), 63).astype(np.int32)})

    rows = src.select("text").mapInArrow(_frequent(buckets), "bucket int, keys binary, counts binary").groupBy("bucket").applyInPandas(
        top, "fingerprint long, level int").toPandas()
    by = np.argsort(rows["fingerprint"].to_numpy())
    return rows["fingerprint"].to_numpy()[by].astype(np.uint32), rows["level"].to_numpy()[by].astype(np.uint64)


class Order:
    """Maps n-gram hashes to keys whose numeric order is the global order."""

    def __init__(self, table):
        self.keys, self.level = table
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self.keys >> 10] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = h >> U64(1)
        if len(self.keys):
            f = (h >> U64(32)).astype(np.uint32)
            maybe = np.flatnonzero(self.seen[f >> 10])
            at = np.minimum(np.searchsorted(self.keys, f[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == f[maybe]
            own = maybe[hit]
            out[own] = U64(1 << 63) | (self.level[at[hit]] << U64(57)) | (h[own] >> U64(7))
        return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of sizes a and b with the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sets(shared, percent, whole: bool):
    """(id, node, n, prefix or whole set) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(shared.value)
        for big in lean(batches):
            for b in chunks(big, "text"):
                h, at = shingles(*flat(b.column(b.schema.get_field_index("text"))))
                keys = order(h)
                node, size, part = [], [], []
                for i in range(b.num_rows):
                    own = np.unique(keys[at[i]:at[i + 1]])
                    n = len(own)
                    node.append(_node(hashlib.blake2b(own.tobytes(), digest_size=16).digest()) if n else None)
                    size.append(n)
                    part.append((own if whole else own[:prefix_size(n, percent)]).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(part, pa.binary())],
                                                 names=["doc_id", "node", "n", "part"])
    return run


def _light(buckets):
    """Prefix n-grams that aren't frequent, as packed blocks for a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for part in chunks(b, "part", 1 << 20):
                data, off = flat(part.column(part.schema.get_field_index("part")))
                keys = np.frombuffer(data.tobytes(), dtype=np.uint64)
                off //= 8
                row = np.repeat(np.arange(part.num_rows), np.diff(off))
                at = (np.arange(len(keys)) - off[row]).astype(np.int32)
                own = np.flatnonzero(keys < U64(1 << 63))
                of = (keys[own] % U64(buckets)).astype(np.int64)
                by = own[np.argsort(of, kind="stable")]
                cut = np.searchsorted(np.sort(of), np.arange(buckets + 1))
                node, n = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("node", "n"))
                full = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                piece = [by[cut[k]:cut[k + 1]] for k in full]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([keys[p].tobytes() for p in piece], pa.binary()), pa.array([node[row[p]].tobytes() for p in piece], pa.binary()),
                    pa.array([n[row[p]].astype(np.int32).tobytes() for p in piece], pa.binary()), pa.array([at[p].tobytes() for p in piece], pa.binary())],
                    names=["bucket", "key", "node", "n", "at"])
    return run


def _shared_keys(pdf):
    """Postings of the keys of a bucket that two classes or more have."""
    import pandas as pd

    key, node, n, at = (np.concatenate([np.frombuffer(x, dtype=t) for x in pdf[c]]) for c, t in (("key", np.uint64), ("node", np.int64), ("n", np.int32), ("at", np.int32)))
    by = np.argsort(key, kind="stable")
    key = key[by]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    own = by[twice]
    return pd.DataFrame({"key": key[twice].astype(np.int64), "node": node[own], "n": n[own].astype(np.int64), "at": at[own]})


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the frequent prefix n-grams, one row each."""
    for b in lean(batches):
        for part in chunks(b, "part", 1 << 20):
            data, off = flat(part.column(part.schema.get_field_index("part")))
            keys = np.frombuffer(data.tobytes(), dtype=np.uint64)
            off //= 8
            row = np.repeat(np.arange(part.num_rows), np.diff(off))
            own = np.flatnonzero(keys >= U64(1 << 63))
            node, n = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(keys[own].astype(np.int64)), pa.array(node[row[own]]), pa.array(n[row[own]]),
                                              pa.array((own - off[row[own]]).astype(np.int32))], names=["key", "node", "n", "at"])


class Probe:
    """Walks ordered sets in prefix-tree order and counts their overlap with
    one set."""

    STEP = 64

    def __init__(self, own: np.ndarray, percent: int):
        self.own, self.percent = own, percent

    def similar(self, sets: list[np.ndarray]) -> list[bool]:
        own, size, out = self.own, len(self.own), [False] * len(sets)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        path = np.zeros(0, dtype=np.uint64)  # the branch walked last, as far as it was walked
        seen = np.zeros(1, dtype=np.int64)  # overlap at each depth of it
        for i in order:
            x = sets[i]
            k = min(len(x), len(path))
            differ = np.flatnonzero(x[:k] != path[:k])
            depth = int(differ[0]) if len(differ) else k
            need, count = needed(size, len(x), self.percent), [seen[:depth + 1]]
            have = int(seen[depth])
            dead = False
            if depth:  # the shared beginning may already leave too little
                dead = have + min(len(x) - depth, size - int(np.searchsorted(own, x[depth - 1], side="right"))) < need
            while depth < len(x) and not dead:
                piece = x[depth:depth + self.STEP]
                at = np.searchsorted(own, piece)
                hit = own[np.minimum(at, size - 1)] == piece if size else np.zeros(len(piece), dtype=bool)
                run = have + np.cumsum(hit)
                count.append(run)
                have = int(run[-1])
                depth += len(piece)
                dead = have + min(len(x) - depth, size - int(at[-1])) < need
            path, seen = x[:depth], np.concatenate(count)
            out[i] = not dead and have >= need
        return out


def _verify(percent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            first, second = b.column(0).to_numpy(), b.column(1).to_numpy()
            by = np.argsort(first, kind="stable")
            cut = np.flatnonzero(np.diff(first[by])) + 1
            a, c = [], []
            for own in np.split(by, cut) if len(by) else ():
                probe = Probe(np.frombuffer(b.column(2)[int(own[0])].as_py(), dtype=np.uint64), percent)
                for lo in range(0, len(own), 256):
                    some = own[lo:lo + 256]
                    for i, yes in zip(some, probe.similar([np.frombuffer(b.column(3)[int(i)].as_py(), dtype=np.uint64) for i in some]), strict=True):
                        if yes:
                            a.append(first[i])
                            c.append(second[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
    return run


def _fits(percent: int):
    """Sizes and places of a shared prefix n-gram leave room for the overlap."""
    need = f"ceil({percent} * (x.n + y.n) / {100 + percent}.0D)"
    return F.expr(f"least(x.n - x.at, y.n - y.at) >= {need} AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    shared = send(spark, heavy_table(src))
    kind = "doc_id long, node long, n long, part binary"
    sets = stage(src.mapInArrow(_sets(shared, percent, False), kind), "sets")
    prefixes = stage(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("part").alias("part")), "prefixes")
    sets, whole_sets = stage(sets.drop("part"), "sizes"), sets
    unstage(whole_sets)
    classes = stage(prefixes.drop("part"), "classes")
    total = prefixes.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    buckets = max(32, total >> 23)  # about a million prefix n-grams each
    light = prefixes.select("node", "n", "part").mapInArrow(_light(buckets), "bucket int, key binary, node binary, n binary, at binary").groupBy("bucket").applyInPandas(
        _shared_keys, "key long, node long, n long, at int")
    heavy = prefixes.select("node", "n", "part").mapInArrow(_heavy, "key long, node long, n long, at int")
    posts = stage(light.unionByName(heavy), "postings")
    unstage(prefixes)

    # first round: each shared n-gram links its classes to one of them
    share = posts.groupBy("node").agg(F.count("*").alias("share"))
    ranked = posts.join(share, "node")
    best = F.max_by(F.struct("node", "n", "at"), F.struct(F.col("share") / F.col("n"), -F.col("node"))).alias("p")
    pivots = ranked.groupBy("key").agg(best, F.count("*").alias("c")).where("c > 1").select("key", "p.*")
    stars = (posts.alias("y").join(pivots.alias("x"), "key").where("x.node <> y.node").where(_fits(percent))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    stars = stage(stars, "stars")
    links = stage(_check(src, shared, classes, stars, percent), "links")
    groups = stage(connected_components(links), "groups")

    # second round: what the first one left apart, n-gram by n-gram
    placed = posts.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    sizes = placed.groupBy("key", "g").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("g", F.struct("c", "g")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    split = stage(placed.join(main, "key"), "apart")
    other = split.where("g <> main")
    pairs = (other.alias("x").join(split.alias("y"), "key").where("x.g <> y.g").where(_fits(percent))
             .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
             .join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = stage(_check(src, shared, classes, stage(pairs, "pairs"), percent), "links")
    if more.isEmpty():
        final = groups
    else:
        final = connected_components(links.unionByName(more))
    named = classes.select("node", "first").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = stage(named.join(least, "component").select("node", "component_id"), "labels")
    return sets.join(label, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _check(src, shared, classes, pairs, percent):
    """The pairs (a, b) of classes that are similar enough. Whole sets are
    made anew from the texts of the classes' first documents."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(classes.join(nodes, "node").select(F.col("first").alias("doc_id"), F.xxhash64("first").alias("key")).distinct(), "wanted")
    texts = split_by(src, F.xxhash64("doc_id"), wanted, "key")[0]
    # a class whose documents all have a null id is found among the rows without one
    texts = texts.alias("t").join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    whole = texts.mapInArrow(_sets(shared, percent, True), "doc_id long, node long, n long, part binary")
    whole = stage(whole.where("node is not null").join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", "part"), "whole")
    joined = pairs.join(whole.select(F.col("node").alias("b"), F.col("part").alias("part_b")), "b").join(
        whole.select(F.col("node").alias("a"), F.col("part").alias("part_a")), "a")
    return joined.select("a", "b", "part_a", "part_b").mapInArrow(_verify(percent), "a long, b long")


def op8_ngram_jaccard_join(spark, sf_dir):
    """Contract query: set size and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
