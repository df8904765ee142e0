"""Near duplicates by SetSketch registers.

A document's set of word 5-grams is kept as REGISTERS registers. Register i
holds K_i = floor(1 - log_b(min_x h_i(x))), cut to 0 ... TOP, where h_i maps
elements to exponential variates: an exponentially spaced, truncated minimum.
The register-wise maximum of two sketches is the sketch of the union, so that
pieces of a set may be sketched apart. Two sets agree in a register with a
probability of at least their Jaccard similarity J.

BANDS bands of registers are hashed; classes (distinct sets) that share a band
value are candidates. At J = 0.85 a pair shares none of 32 bands of 4 with
probability (1 - 0.85^4)^32 = 6e-11. For a candidate pair the registers that
are larger, smaller and equal give the joint log-likelihood of J, the set sizes
being known; a pair goes only if every J that links is less likely by LIKELY
nats than the best J (6 standard deviations). What remains is verified on the
full sets, so that no link is made wrongly.

Groups of many near copies are not expanded into pairs. Each band value first
links its classes to one of them, the one with the most company, and components
are formed. Where a band value still holds several components, the classes
outside its largest one are compared with the rest, in blocks of rows inside
tasks. Band values of few rows give the pairs that pass the likelihood; those
of more rows are verified on the full sets where the blocks meet, and only
links come out that join what the blocks' other links leave apart.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing (its component is its own id); a text with fewer
words than n is one n-gram; a null id keeps its row, links others, is never a
component's name, and has a null component and a null ``kept`` where no row of
its component has an id; rows with the same id are judged by their texts; texts of any
length are sketched whole; an empty table gives an empty result; only named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import textvec as tv
from tillsight.llm.common import bitmap, chunks, flat, in_bitmap, lean, stage, unstage, utf8
from tillsight.llm.components import connected_components

N, PERCENT = 5, 85
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Register scale: base and rate of the exponential variates, largest value.
BASE, RATE, TOP = 1.02, 20.0, 2000
LIKELY = 20.0
#: With fewer equal registers the likelihood lets no pair at 0.79 or more through
#: (128 KL(0.5 | 0.79) = 26 nats), so it isn't computed.
LEAST_EQUAL = REGISTERS // 2
#: Second round: rows of a block, elements of their sets (about), and the rows
#: of a band value that may give their likely pairs.
BLOCK, BLOCK_SET, SMALL = 256, 1 << 17, 32
U64, U32 = np.uint64, np.uint32
_RND = np.random.Generator(np.random.PCG64(20250311))
_MUL = _RND.integers(0, 1 << 31, (REGISTERS, 2), dtype=U32) * U32(2) + U32(1)
_BAND = _RND.integers(0, 1 << 63, BANDS, dtype=np.uint64) * U64(2) + U64(1)


def shingles(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all documents, document by document,
    and the n-grams before each document."""
    data = tv.LOWER[data]
    start, end, bounds = tv.words(data, off)
    h = tv.span_hash(tv.prefix_hash(data), start, end)
    count = np.diff(bounds)
    doc = tv.doc_of(bounds)
    grams = tv.window_hash(h, n)
    whole = doc[:len(grams)] == doc[n - 1:] if len(grams) else np.zeros(0, dtype=bool)
    parts, owners = [grams[whole]], [doc[:len(grams)][whole]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            parts.append(tv.window_hash(h, k)[bounds[short]])
            owners.append(short)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return value[by], np.searchsorted(owner[by], np.arange(len(off)))


def registers(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Register values of the sets value[at[i]:at[i+1]], a row each; an empty
    set has zeros."""
    out = np.zeros((len(at) - 1, REGISTERS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    least = np.full((len(full), REGISTERS), 0xFFFFFFFF, dtype=U32)
    step = 1 << 15  # elements at a time, so that they stay in the cache
    begin = at[full]
    for lo in range(0, len(value), step):
        some = value[lo:lo + step]
        low, high = some.astype(U32), (some >> U64(32)).astype(U32)
        x, y = np.empty_like(low), np.empty_like(low)
        first = np.searchsorted(begin, lo, side="right") - 1
        last = np.searchsorted(begin, lo + len(some), side="left")
        cut = np.maximum(begin[first:last] - lo, 0)
        for i in range(REGISTERS):
            np.multiply(low, _MUL[i, 0], out=x)
            x += high
            np.right_shift(x, U32(15), out=y)
            x ^= y
            x *= _MUL[i, 1]
            own = np.minimum.reduceat(x, cut)
            np.minimum(least[first:last, i], own, out=least[first:last, i])
    # h = -ln(1 - u) / RATE for u in (0, 1)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    k = np.floor(1 - (np.log(-np.log1p(-u)) - np.log(RATE)) / np.log(BASE))
    out[full] = np.clip(k + 0, 0, TOP).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """Hash of each band of each row."""
    w = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(w.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        h = h * U64(0xD6E8FEB86659FD93) + w[:, :, k] + U64(1)
    return tv.mix(h * _BAND[None, :] + np.arange(BANDS, dtype=np.uint64)[None, :])


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 101)


def may_link(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Can pairs with ``more`` registers larger in a and ``less`` smaller have
    the similarity? By the joint likelihood of J, given the set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], most[:, None])
    up, down = _share(u[:, None] - v[:, None] * j), _share(v[:, None] - u[:, None] * j)
    same = np.maximum(1 - up - down, 1e-12)
    up, down = np.maximum(up, 1e-12), np.maximum(down, 1e-12)
    level = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(same)
    linked = np.where(_GRID[None, :] >= percent / 100 - 0.01, level, -np.inf).max(axis=1)
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & (linked >= level.max(axis=1) - LIKELY)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest of the set, n, registers, hash of the text)."""
    for big in lean(batches):
        for b in chunks(big, "text"):
            value, at = shingles(*flat(b.column(1)))
            own = [np.unique(value[at[i]:at[i + 1]]) for i in range(b.num_rows)]
            n = np.array([len(x) for x in own], dtype=np.int64)
            regs = registers(np.concatenate(own) if own else value, np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([_digest(x) if len(x) else None for x in own], pa.binary()), pa.array(n),
                pa.array([r.tobytes() if k else None for r, k in zip(regs, n, strict=True)], pa.binary()), b.column(2)],
                names=["doc_id", "digest", "n", "regs", "mark"])


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _rows(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(flat(arr)[0].tobytes(), dtype=np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lean(batches):
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            key = bands(_rows(part.column(1)))
            node, n = (pa.array(np.repeat(part.column(c).to_numpy(), BANDS)) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), node, n], names=["key", "node", "n"])


def _likely(percent):
    """Pairs (a, b) that the likelihood lets through, from their registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x, y = _rows(part.column(4)), _rows(part.column(5))
                ok = may_link((x > y).sum(axis=1), (x < y).sum(axis=1), part.column(2).to_numpy(), part.column(3).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in part.columns[:2]], names=["a", "b"])
    return run


def _compare(percent):
    """Likely pairs between two blocks of classes of one band value that lie in
    different components. A pair that shares several band values comes from
    the first of them only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            lows, highs = [], []
            for r in range(batch.num_rows):
                row = {c: batch.column(k)[r].as_py() for k, c in enumerate(batch.schema.names)}
                x, y = (np.frombuffer(b"".join(p["regs"] for p in row[side]), dtype=np.uint16).reshape(-1, REGISTERS) for side in ("one", "two"))
                (a, g, n), (b, h, m) = (tuple(np.array([p[c] for p in row[side]], dtype=np.int64) for c in ("node", "g", "n")) for side in ("one", "two"))
                band = int((bands(x[:1])[0].astype(np.int64) == row["key"]).argmax())
                for i in range(len(x)):  # a row against a block
                    fit = np.flatnonzero((h != g[i]) & (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])))
                    same = x[i] == y[fit]
                    first = same.reshape(len(fit), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                    ok = np.flatnonzero(first & (same.sum(axis=1) >= (LEAST_EQUAL if percent >= 80 else 0)))
                    fit = fit[ok]
                    if len(fit):
                        fit = fit[may_link((x[i] > y[fit]).sum(axis=1), (x[i] < y[fit]).sum(axis=1), np.full(len(fit), n[i]), m[fit], percent)]
                        lows.append(np.minimum(a[i], b[fit]))
                        highs.append(np.maximum(a[i], b[fit]))
            if lows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs))], names=["a", "b"])
    return run


def _verify_blocks(percent):
    """Links between two blocks of a large band value, verified on the full
    sets inside the task. Of the links of two blocks only those come out that
    join what others of them leave apart, so at most one a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            lows, highs = [], []
            for r in range(batch.num_rows):
                row = {c: batch.column(k)[r].as_py() for k, c in enumerate(batch.schema.names)}
                both = row["one"] + row["two"]
                node, g, n = (np.array([p[c] for p in both], dtype=np.int64) for c in ("node", "g", "n"))
                regs = np.frombuffer(b"".join(p["regs"] for p in both), dtype=np.uint16).reshape(-1, REGISTERS)
                sets = [np.frombuffer(p["own"], dtype=np.uint64) for p in both]
                band = int((bands(regs[:1])[0].astype(np.int64) == row["key"]).argmax())
                group = np.unique(g, return_inverse=True)[1]  # found links merge groups
                cut = len(row["one"])
                for i in range(cut):
                    fit = cut + np.flatnonzero((group[cut:] != group[i]) & (100 * np.minimum(n[cut:], n[i]) >= percent * np.maximum(n[cut:], n[i])))
                    same = regs[i] == regs[fit]
                    first = same.reshape(len(fit), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                    fit = fit[first & (same.sum(axis=1) >= (LEAST_EQUAL if percent >= 80 else 0))]
                    if len(fit):
                        fit = fit[may_link((regs[i] > regs[fit]).sum(axis=1), (regs[i] < regs[fit]).sum(axis=1), np.full(len(fit), n[i]), n[fit], percent)]
                    for j in fit.tolist():
                        if group[i] != group[j] and _similar(sets[i], sets[j], percent):
                            group[group == group[j]] = group[i]
                            lows.append(min(node[i], node[j]))
                            highs.append(max(node[i], node[j]))
            if lows:
                yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["a", "b"])
    return run


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Are two sorted sets similar enough?"""
    at = np.searchsorted(one, two)
    both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _picked(shared):
    """Texts whose hash is wanted, each hash once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in lean(batches):
            mark = b.column(1).to_numpy()
            own = []
            for i in np.flatnonzero(in_bitmap(shared.value, mark)).tolist():
                if int(mark[i]) not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(int(mark[i]))
                    own.append(i)
            yield b.take(pa.array(own, pa.int64()))
    return run


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sorted set) of the texts that have their class's set."""
    for big in lean(batches):
        for b in chunks(big, "text"):
            value, at = shingles(*flat(b.column(0)))
            node, out = [], []
            for i in range(b.num_rows):
                own = np.unique(value[at[i]:at[i + 1]])
                if _digest(own) == b.column(2)[i].as_py():
                    node.append(b.column(1)[i].as_py())
                    out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], names=["node", "own"])


def _exact(percent):
    """The pairs that are similar enough, on their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            ok = []
            last, one = None, None
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != last:
                    last, one = b.column(0)[i].as_py(), np.frombuffer(b.column(2)[i].as_py(), dtype=np.uint64)
                ok.append(_similar(one, np.frombuffer(b.column(3)[i].as_py(), dtype=np.uint64), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])
    return run


def _full_sets(src: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own): the sets of some classes, staged. One text of each is
    fetched by its hash, and its set made anew."""
    wanted = stage(classes.join(nodes, "node", "left_semi").select("node", "digest", "mark"), "wanted")
    shared = src.sparkSession.sparkContext.broadcast(bitmap(wanted, "mark"))
    texts = src.select("text", "mark").mapInArrow(_picked(shared), "text binary, mark long")
    full = stage(texts.join(wanted, "mark").select("text", "node", "digest").mapInArrow(_full, "node long, own binary").dropDuplicates(["node"]), "full")
    shared.destroy()
    unstage(wanted)
    return full


def _links(src: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The verified ones of the pairs (a, b) of classes, staged."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = _full_sets(src, classes, nodes)
    joined = pairs.join(full.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b").join(
        full.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    links = stage(joined.select("a", "b", "own_a", "own_b").mapInArrow(_exact(percent), "a long, b long"), "links")
    unstage(full)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    sketched = stage(src.mapInArrow(_sketch, "doc_id long, digest binary, n long, regs binary, mark long"), "sketches")
    one = F.min_by(F.struct("n", "regs", "mark"), "mark").alias("one")
    made = sketched.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), one)
    classes = stage(made.select("digest", "first", "one.n", "one.regs", "one.mark").withColumn("node", F.monotonically_increasing_id()), "classes")

    # band values that two classes or more share
    posts = classes.select("node", "regs", "n").mapInArrow(_bands, "key long, node long, n long")
    many = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    posts = stage(posts.join(many, "key", "left_semi"), "bands")
    company = posts.groupBy("node").agg(F.count("*").alias("share"))
    pivots = posts.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("share", "node")).alias("pivot"))
    stars = posts.join(pivots, "key").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    small = classes.select("node", "n", "regs")

    def sided(side):
        return small.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}"))

    near = stars.join(sided("a"), "a").join(sided("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    near = stage(near.mapInArrow(_likely(percent), "a long, b long"), "stars")
    links = _links(src, classes, near, percent)
    groups = stage(connected_components(links), "groups")

    # band values that hold several components: the rest against all others
    placed = posts.join(groups, "node", "left").withColumn("g", F.coalesce("component", -1 - F.col("node"))).drop("component")
    sizes = placed.groupBy("key", "g").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "g", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")

    def blocks(c, s):
        return F.expr(f"cast(greatest(ceil(({c}) / {BLOCK}.0D), ceil(({s}) / {BLOCK_SET}.0D)) as int)")

    apart = stage(placed.join(main, "key").select(
        "key", "node", "n", "g", (F.col("g") != F.col("main.g")).alias("other"), (F.col("c") > SMALL).alias("large"),
        blocks("c - main.c", "s - main.s").alias("others"), blocks("main.c", "main.s").alias("mains")), "apart")
    more = []
    if not apart.isEmpty():
        regs = classes.select("node", "regs")
        dealt = apart.withColumn("block", F.expr("pmod(xxhash64(node), if(other, others, mains))").cast("int")).join(regs, "node")

        def met(rows, *fields):
            packed = rows.groupBy("key", "other", "block").agg(F.collect_list(F.struct(*fields)).alias("rows"))
            packed = stage(packed, "blocks")
            left = packed.where("other").select("key", F.col("block").alias("x"), F.col("rows").alias("one"))
            right = packed.select("key", F.col("block").alias("y"), "other", F.col("rows").alias("two"))
            return left.join(right, "key").where("NOT other OR x <= y").select("key", "one", "two"), packed

        # small ones give their likely pairs, at most SMALL a row
        few, held = met(dealt.where("NOT large"), "node", "g", "n", "regs")
        fresh = few.mapInArrow(_compare(percent), "a long, b long").distinct().join(near, ["a", "b"], "left_anti")
        pairs = stage(fresh, "pairs")
        unstage(held)
        more.append(_links(src, classes, pairs, percent))
        # large ones are verified where they meet
        nodes = apart.where("large").select("node").distinct()
        full = _full_sets(src, classes, nodes)
        many, held = met(dealt.where("large").join(full, "node"), "node", "g", "n", "regs", "own")
        more.append(stage(many.mapInArrow(_verify_blocks(percent), "a long, b long"), "links"))
        unstage(held)
        unstage(full)
    more = [x for x in more if not x.isEmpty()]
    if more:
        for x in more:
            links = links.unionByName(x)
        groups = connected_components(links)
    named = classes.select("node", "digest", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", -1 - F.col("node")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = stage(named.join(least, "component").select("digest", "component_id"), "labels")
    unstage(posts)
    out = sketched.select("doc_id", "digest", "n").join(label, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op11_setsketch(spark, sf_dir):
    """Contract query: set size, component and verdict of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
