"""Quality rules with an n-gram perplexity filter.

Base rules count words, symbols, repeated lines and repeated word windows of
each whole text. The language model is a byte n-gram model with modified
Kneser-Ney smoothing. Its windows run through the text across words, so word
order counts. Spark counts its n-grams over every document, separately
for each language, and interpolates all orders by joins. Every n-gram of a scored
document was counted, so scoring needs the highest order's probabilities alone.
They are split into parts of bounded size, sorted arrays of packed n-gram keys;
a task probes them by binary search, one part at a time for a wave of documents,
whatever the size of the whole model. A document is rejected when its perplexity
lies outside the band of documents of its language and size: a mean over few
words strays further.

Defined results: a null text counts as empty (0 words, fails the base rules); a
null language is a language of its own; a null id is kept as null; repeated
rows are judged row by row and get equal verdicts; an empty table gives an
empty result; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm import textvec as tv
from tillsight.llm.common import chunks, flat, lean, send, split_by, stage, unstage, utf8

ORDER = 5
ROW_BYTES = 24
#: N-grams in one part of the model, about, and text bytes that a task scores
#: against all parts at once. The number of parts grows with the model.
PART_ROWS, WAVE_BYTES = 1 << 20, 8 << 20
#: Half width of a band: this many robust standard deviations of the log2
#: perplexity, and at least MIN_BITS. Where fewer than MIN_GROUP documents share
#: a language and size, the band of the whole language holds.
WIDTH, MIN_BITS, MIN_GROUP = 3.0, 0.1, 50
MIN_WORDS = 50
BINS = 1024  # bins a bit, for the medians

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class LanguageModel:
    """Sorted keys and values by (language, order): ``prob`` of n-grams and
    ``back`` (the weight of the lower order) of contexts."""

    order: int
    prob: dict = field(default_factory=dict)
    back: dict = field(default_factory=dict)

    @staticmethod
    def _find(entry, keys):
        if entry is None or not len(entry[0]):
            return np.zeros(len(keys), dtype=bool), None
        at = np.minimum(np.searchsorted(entry[0], keys), len(entry[0]) - 1)
        return entry[0][at] == keys, entry[1][at]

    def log2(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of each packed n-gram."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        scale = np.zeros(len(keys))
        for n in range(self.order, 0, -1):
            gram = keys[todo] & np.uint64((1 << 8 * n) - 1)
            hit, p = self._find(self.prob.get((lang, n)), gram)
            if p is not None:
                out[todo[hit]] = scale[todo[hit]] + np.log2(p[hit])
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                return out
            seen, w = self._find(self.back.get((lang, n)), gram >> np.uint64(8))
            if w is not None:
                scale[todo[seen]] += np.log2(w[seen])
        out[todo] = scale[todo] - 8.0  # uniform over 256 bytes
        return out


def packed_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-byte window that ends at each byte of each word and at the
    space behind it, packed into an integer; windows per document. Windows run
    through the text, with one space between words; the first word is preceded
    by a space and zero bytes."""
    doc = tv.doc_of(bounds)
    size = end - start
    opens = np.ones(len(doc), dtype=bool)
    opens[1:] = doc[1:] != doc[:-1]
    pad = ORDER - 1
    stop = np.cumsum(size + 1 + pad * opens)  # behind each word's space
    run = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
    solid = np.ones(len(run), dtype=bool)
    solid[stop - 1] = False
    window = np.ones(len(run), dtype=bool)
    head = (stop - size - 1 - pad)[opens]
    for k in range(pad):
        solid[head + k] = window[head + k] = False
        run[head + k] = 0x20 if k == pad - 1 else 0
    run[solid] = data[~tv.SPACE[data]]
    key = np.zeros(max(len(run) - pad, 0), dtype=np.uint64)
    for k in range(ORDER):
        key <<= np.uint64(8)
        key |= run[k:k + len(key)]
    per = np.bincount(doc, weights=size + 1, minlength=len(bounds) - 1).astype(np.int64)
    return key[window[pad:]], per


def _languages(batch: pa.RecordBatch, col: str):
    names = np.array(["" if x is None else x for x in batch.column(batch.schema.get_field_index(col)).to_pylist()], dtype=object)
    kinds, number = np.unique(names.astype(str), return_inverse=True)
    return kinds, number


def _windows(b: pa.RecordBatch, data, start, end, bounds) -> Iterator[tuple]:
    """(language, windows, documents, windows per document) of each language."""
    keys, per = packed_grams(data, start, end, bounds)
    first = np.cumsum(per) - per
    kinds, number = _languages(b, "lang")
    for k, lang in enumerate(kinds):
        own = np.flatnonzero((number == k) & (per > 0))
        if len(own):
            yield str(lang), np.concatenate([keys[first[d]:first[d] + per[d]] for d in own]) if len(kinds) > 1 else keys, own, per[own]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list] = {}

    def rows(lang):
        keys = np.concatenate([k for k, _ in total[lang]])
        n = np.concatenate([c for _, c in total[lang]])
        by = np.argsort(keys)
        keys, first = np.unique(keys[by], return_index=True)
        return keys, np.add.reduceat(n[by], first)

    for big in lean(batches):
        for b in chunks(big, "text"):
            data, off = flat(b.column(b.schema.get_field_index("text")))
            start, end, bounds = tv.words(data, off)
            if not len(start):
                continue
            for lang, keys, *_ in _windows(b, data, start, end, bounds):
                total.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                if sum(len(x) for x, _ in total[lang]) > 1 << 19:
                    total[lang] = [rows(lang)]
                    if len(total[lang][0][0]) > 1 << 19:
                        yield _gram_rows(lang, *total.pop(lang).pop())
    for lang in list(total):
        yield _gram_rows(lang, *rows(lang))


def _gram_rows(lang, keys, n):
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "c"])


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, n, g, c): n-gram types of every order. c is the corpus count at
    the highest order and the number of distinct left extensions below it."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), utf8(text_col).alias("text"))
    top = (src.mapInArrow(_count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")))
    top = stage(top, "grams")
    levels, low = [top.select("lang", F.lit(ORDER).alias("n"), "g", "c")], top
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * n) - 1
        low = low.groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count("*").alias("c"))
        levels.append(low.select("lang", F.lit(n).alias("n"), "g", "c"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def smoothed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The staged n-grams, (lang, n, g, v, back), and their counts by order.
    v is an n-gram's discounted share of its context, back its context's weight
    of the lower order (modified Kneser-Ney)."""
    adj = stage(count_grams(docs, text_col, lang_col), "adjusted")
    ones = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / nullif(n1 + 2 * n2, 0)")
    disc = adj.groupBy("lang", "n").agg(*ones).withColumn("y", F.coalesce(y, F.lit(0.0)))
    for k in (1, 2, 3):
        d = F.lit(float(k)) - F.lit(k + 1.0) * F.col("y") * F.expr(f"coalesce(n{k + 1} / nullif(n{k}, 0), 0)")
        disc = disc.withColumn(f"d{k}", F.when(F.col("y") > 0, F.least(F.greatest(d, F.lit(0.1)), F.lit(k - 0.05))).otherwise(F.lit(0.5)))
    # written first, so that the planner sees its size: one row a language and order
    disc = stage(disc.select("lang", "n", "d1", "d2", "d3"), "discounts")
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = adj.join(disc, ["lang", "n"]).withColumn("cut", cut).withColumn("x", F.shiftright("g", 8))
    ctx = Window.partitionBy("lang", "n", "x")  # a byte follows: 256 rows at most
    total = F.sum("c").over(ctx)
    out = stage(grams.select("lang", "n", "g", ((F.col("c") - F.col("cut")) / total).alias("v"), (F.sum("cut").over(ctx) / total).alias("back")), "smoothed")
    unstage(adj)
    unstage(disc)
    return out, out.groupBy("n").count()


def interpolated(grams: DataFrame, order: int) -> list[DataFrame]:
    """(lang, g, p) of each order from 1 up to ``order``."""
    levels: list[DataFrame] = []
    for n in range(1, order + 1):
        own = grams.where(F.col("n") == n)
        if n == 1:
            levels.append(own.select("lang", "g", (F.col("v") + F.col("back") / 256).alias("p")))
            continue
        own = own.withColumn("tail", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        low = levels[-1].select("lang", F.col("g").alias("tail"), F.col("p").alias("low"))
        levels.append(own.join(low, ["lang", "tail"]).select("lang", "g", (F.col("v") + F.col("back") * F.col("low")).alias("p")))
    return levels


def _by_lang(t: pa.Table, key: str, value: str) -> dict:
    """Sorted keys and values of each language."""
    lang = t.column("lang").combine_chunks()
    lang = (lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang).dictionary_encode()
    of, k, v = lang.indices.to_numpy(), t.column(key).to_numpy(), t.column(value).to_numpy()
    by = np.lexsort((k, of))
    ends = np.searchsorted(of[by], np.arange(len(lang.dictionary) + 1))
    return {name: (k[by[a:z]].astype(np.uint64), v[by[a:z]].astype(np.float32))
            for name, a, z in zip(lang.dictionary.to_pylist(), ends, ends[1:])}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", model_bytes: int | None = None) -> LanguageModel:
    """The whole model in one process, with the weights that unseen n-grams
    need. A caller with few bytes may ask for the orders that ``model_bytes``
    hold; ``quality_rules`` doesn't use this and always scores with all."""
    grams, counts = smoothed(docs, text_col, lang_col)
    sizes = dict(counts.collect())
    order = 0
    while order < ORDER and (model_bytes is None or sum(sizes.get(i, 0) for i in range(1, order + 2)) * ROW_BYTES <= model_bytes):
        order += 1
    model = LanguageModel(order)
    for n, level in enumerate(interpolated(grams, order), 1):
        model.prob.update(((lang, n), e) for lang, e in _by_lang(level.toArrow(), "g", "p").items())
        ctx = grams.where(F.col("n") == n).groupBy("lang", F.shiftright("g", 8).alias("x")).agg(F.max("back").alias("back"))
        model.back.update(((lang, n), e) for lang, e in _by_lang(ctx.toArrow(), "x", "back").items())
    unstage(grams)
    return model


def model_parts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", part_rows: int = PART_ROWS) -> list:
    """Broadcasts of the highest order, {lang: (sorted n-grams, bits)}; part i
    of P has the n-grams that leave i when divided by P. The driver holds one
    part at a time, and so do tasks."""
    spark = docs.sparkSession
    grams, counts = smoothed(docs, text_col, lang_col)
    # odd, so that the last bytes of n-grams spread over the parts
    many = -(-dict(counts.collect()).get(ORDER, 0) // part_rows) | 1
    top = interpolated(grams, ORDER)[-1].select("lang", "g", (-F.log2("p")).cast("float").alias("bits"), (F.col("g") % many).cast("int").alias("part"))
    top = stage(top, "model", "part")
    unstage(grams)
    parts = [send(spark, _by_lang(top.where(F.col("part") == i).select("lang", "g", "bits").toArrow(), "g", "bits")) for i in range(many)]
    unstage(top)
    return parts


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _scorer(parts):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, size = [], 0
        for big in lean(batches):
            for b in chunks(big, "text"):
                wave.append(_judge_chunk(b))
                size += int(np.diff(flat(b.column(b.schema.get_field_index("text")))[1]).sum())
                if size >= WAVE_BYTES:
                    yield from _score_wave(wave, parts)
                    wave, size = [], 0
        yield from _score_wave(wave, parts)
    return score


def _score_wave(wave: list, parts: list) -> Iterator[pa.RecordBatch]:
    """Looks up the wave's n-grams part by part, then sums them by document."""
    want: dict[str, list] = {}
    for _, grams in wave:
        for lang, keys, *_ in grams:
            want.setdefault(lang, []).append(keys)
    keys = {lang: np.unique(np.concatenate(k)) for lang, k in want.items()}
    bits = {lang: np.full(len(k), 8.0, dtype=np.float32) for lang, k in keys.items()}  # uniform over 256 bytes
    for i, part in enumerate(parts if keys else []):
        table = part.value
        for lang, k in keys.items():
            own = np.flatnonzero(k % np.uint64(len(parts)) == i)
            hit, v = LanguageModel._find(table.get(lang), k[own])
            if v is not None:
                bits[lang][own[hit]] = v[hit]
        if part._path is not None and len(parts) > 1:
            del part._value, table  # loaded again by the next wave
    while wave:
        out, grams = wave.pop(0)
        mean = np.zeros(out.num_rows)
        for lang, own, inv, docs, per in grams:
            v = bits[lang][np.searchsorted(keys[lang], own)].astype(np.float64)[inv]
            mean[docs] = np.add.reduceat(v, np.cumsum(per) - per) / per
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(mean)], names=[*out.schema.names, "bits"])


def _judge_chunk(b: pa.RecordBatch) -> tuple[pa.RecordBatch, list]:
    """The base counts, and for each language its distinct n-grams, the place
    of each window among them, its documents and their numbers of windows."""
    col = b.column(b.schema.get_field_index("text"))
    data, off = flat(col)
    docs = b.num_rows
    start, end, bounds = tv.words(data, off)
    n_words = np.diff(bounds)
    solid = ~tv.SPACE[data] & ((data & 0xC0) != 0x80)
    word_chars = tv.per_doc(solid, off)
    symbols = tv.per_doc(SYMBOL[data], off)
    dup = np.array([_dup_lines(x) for x in col.to_pylist()], dtype=np.int64)
    h = tv.span_hash(tv.prefix_hash(data), start, end)
    doc = tv.doc_of(bounds)
    marked = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        tri = tv.window_hash(h, 3)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = tv.mix(tri[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        twice = np.zeros(len(key), dtype=bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit = inside[twice]
        for k in range(3):
            marked[hit + k] = True
    c = np.concatenate([[0], np.cumsum(marked)])
    repeat = c[bounds[1:]] - c[bounds[:-1]]
    grams = []
    for lang, keys, own, per in _windows(b, data, start, end, bounds) if len(h) else ():
        distinct, inv = np.unique(keys, return_inverse=True)
        grams.append((lang, distinct, inv.astype(np.int32), own, per))
    keep = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
    names = [name for name in b.schema.names if name != "text"]
    new = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    return pa.RecordBatch.from_arrays(keep + [pa.array(x.astype(np.int64)) for x in new.values()], names=names + [*new]), grams


def bands(scored: DataFrame, keys: list[str], width: float = WIDTH, min_bits: float = MIN_BITS) -> DataFrame:
    """(keys, low_bits, high_bits, texts): median of log2 perplexity, plus or
    minus ``width`` robust standard deviations (1.4826 times the median absolute
    deviation), over all different texts that pass the base rules. Copies count
    once, so that a group of them can't narrow a band. Medians are taken on bins
    of 1/1024 bit, so the windows see a bounded number of rows."""
    texts = scored.where(~F.col("base_failed")).groupBy("lang", "size", "text_key").agg(F.min("bits").alias("bits"))
    hist = texts.groupBy(*keys, F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count("*").alias("k"))

    def median(df, value, name):
        w = Window.partitionBy(*keys)
        run = df.withColumn("cum", F.sum("k").over(w.orderBy(value))).withColumn("all", F.sum("k").over(w))
        return run.where(F.col("cum") * 2 >= F.col("all")).groupBy(*keys).agg(F.min(value).alias(name), F.first("all").alias("texts"))

    mid = median(hist, "bin", "mid")
    away = hist.join(mid, keys).withColumn("away", F.abs(F.col("bin") - F.col("mid"))).groupBy(*keys, "mid", "away").agg(F.sum("k").alias("k"))
    mad = median(away, "away", "mad").join(mid.drop("texts"), keys)
    half = F.greatest(F.lit(width * 1.4826) * (F.col("mad") + 1) / BINS, F.lit(min_bits))
    centre = (F.col("mid") + 0.5) / BINS
    return mad.select(*keys, (centre - half).alias("low_bits"), (centre + half).alias("high_bits"), "texts")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  width: float = WIDTH, min_bits: float = MIN_BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row a document: base counts, log2 perplexity with its band
    by language and size (number of words, to a power of two), ``base_failed`` and ``kept``; ``text_key`` is the text's hash."""
    parts = model_parts(docs, text_col, lang_col, part_rows)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                      F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), utf8(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    scored = src.mapInArrow(_scorer(parts), f"doc_id {kind}, text_key long, lang string, n_words long, word_chars long, "
                            "n_symbols long, n_dup_lines long, n_repeat_words long, bits double")
    scored = stage(scored.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn(
        "size", F.length(F.bin("n_words"))), "scored")
    for part in parts:
        part.unpersist()
    # written first, so that the planner sees their size and needn't deal documents out by language
    whole = stage(bands(scored, ["lang"], width, min_bits).drop("texts"), "bands")
    group = stage(bands(scored, ["lang", "size"], width, min_bits).where(F.col("texts") >= MIN_GROUP).drop("texts"), "group-bands")
    group = group.withColumnsRenamed({"low_bits": "own_low", "high_bits": "own_high"})
    low, high = F.coalesce("own_low", "low_bits"), F.coalesce("own_high", "high_bits")
    out = scored.join(whole, "lang", "left").join(group, ["lang", "size"], "left").withColumns({"low_bits": low, "high_bits": high}).drop("own_low", "own_high", "size")
    inside = F.col("bits").between(F.col("low_bits"), F.col("high_bits"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits")))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """``docs`` without the rejected documents, all columns as they were."""
    bad = stage(quality_rules(docs, id_col, text_col, lang_col, **how).where(~F.col("kept")).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct(), "rejected")
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text_col) == F.col("_bad_key"))
    inside, outside = split_by(docs, F.xxhash64(text_col), bad, "_bad_key")
    return inside.join(bad, same, "left_anti").unionByName(outside)


def op10_quality_rules(spark, sf_dir):
    """Contract query: base counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
