"""Spelling variants of the corpus' words, by blocked Gram matrices.

Words are counted over all texts (each task counts its own first). A word is
then a vector of letter counts. One inserted or deleted letter moves two such
vectors to squared distance 1, a replaced one to 2, so only pairs at most 2
apart, in the same or adjacent lengths, can differ by one edit. Words of one
length are dealt into blocks by how many of their letters fall into each of
four letter classes: one edit moves at most one letter from class to class, so
a block meets only its neighbours. The squared distances of two blocks come
from one matrix product, |x|^2 + |y|^2 - 2 x.y; pairs at most two apart are
verified letter by letter. Large blocks are cut into parts of bounded size.

A word's form is its near word of largest count, if that is at least twice its
own; counts at least double along the way, so the last form is at most 62 steps
away, and pointer doubling finds it in six rounds or less.

Defined results: a null or empty text has no words; a null id is written as an
empty string in the digest that plants variants; words of any length take part;
repeated rows count each time; an empty table gives an empty result; ties go to
the word smallest in code-point order; only named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import chunks, flat, lean, stage, utf8
from tillsight.llm.textvec import LOWER

#: Letters: a to z, and U+00C0 to U+00FF.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
INDEX = np.full(256, 255, dtype=np.uint8)
INDEX[LETTERS] = np.arange(len(LETTERS))
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Letter bytes of one part of a block (a word counts 8 at least), and words a
#: task counts before it hands them on.
PART_BYTES, HELD_WORDS = 1 << 13, 1 << 18


def _counted(typo: int):
    """(word, n) of the runs of a task's texts. A run whose digest with the
    document's id is divisible by ``typo`` loses one letter (0: none does)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for big in lean(batches):
            for b in chunks(big, "text"):
                data, off = flat(b.column(1))
                data = LOWER[data]
                for i, number in enumerate(b.column(0).to_pylist()):
                    own = Counter(RUN.findall(data[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace")))
                    start = zlib.crc32(f"{'' if number is None else number}:".encode())
                    for word, n in own.items():
                        if typo and (h := zlib.crc32(word.encode(), start)) % typo == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= LEAST_LENGTH:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()
    return run


def count_words(docs: DataFrame, typo: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the corpus' words of LEAST_LENGTH letters and LEAST_COUNT
    occurrences or more."""
    src = docs.select(F.col(id_col).cast("string").alias("doc_id"), utf8(text_col).alias("text"))
    return src.mapInArrow(_counted(typo), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def codes(words: list[str], length: int) -> np.ndarray:
    """Letter numbers of words of one length, a row each."""
    return INDEX[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)].reshape(len(words), length)


def letter_counts(code: np.ndarray) -> np.ndarray:
    n = len(LETTERS)
    cell = np.arange(len(code))[:, None] * n + code
    # 32-bit floats hold the squares exactly below 4096 letters
    return np.bincount(cell.ravel(), minlength=len(code) * n).reshape(len(code), n).astype(np.float32 if code.shape[1] < 4096 else np.float64)


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the letter matrices ``a`` and ``b`` (as long, or one letter
    longer) that differ by exactly one edit."""
    x, y = letter_counts(a), letter_counts(b)
    apart = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(apart <= 2)
    length, keep = a.shape[1], np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 22) // max(1, length))
    for lo in range(0, len(i), step):
        p, q = a[i[lo:lo + step]], b[j[lo:lo + step]]
        if b.shape[1] == length:
            keep[lo:lo + step] = (p != q).sum(axis=1) == 1
        else:  # a common beginning and a common end that cover the shorter word
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            keep[lo:lo + step] = head + tail >= length
    return i[keep], j[keep]


#: How one edit moves the counts of the four letter classes: a letter replaced
#: (within its class, or by one of an earlier class; the other way round is the
#: same pair), or one inserted.
_MOVES = [(0, 0, 0, 0), *(tuple((k == t) - (k == f) for k in range(4)) for f in range(4) for t in range(f))]
_INSERTS = [tuple(int(k == t) for k in range(4)) for t in range(4)]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) and (b, a) of near words of two parts."""
    for b in lean(batches):
        word, near = [], []
        for k in range(b.num_rows):
            left, right = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            i, j = near_pairs(codes(left, len(left[0])), codes(right, len(right[0])))
            if b.column(2)[k].as_py():  # a part with itself
                own = i < j
                i, j = i[own], j[own]
            one, two = [left[x] for x in i.tolist()], [right[x] for x in j.tolist()]
            word += one + two
            near += two + one
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string())], names=["word", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs (word, near) of the distinct ``words`` that differ by
    one inserted, deleted or replaced letter."""
    classes = [F.expr(f"size(filter(split(word, ''), c -> c <> '' AND ascii(c) % 4 = {k}))").alias(f"g{k}") for k in range(4)]
    placed = stage(words.select("word", *classes), "placed")  # the counts add up to the length
    key = [f"g{k}" for k in range(4)]
    size = placed.groupBy(*key).agg(F.count("*").alias("c"))
    size = size.select(*key, F.expr(f"greatest(1, ceil(c * greatest(8, g0 + g1 + g2 + g3) / {PART_BYTES}.0D))").cast("long").alias("parts"))
    parts = stage(placed.join(size, key).withColumn("part", F.pmod(F.xxhash64("word"), "parts")).groupBy(*key, "part").agg(F.collect_list("word").alias("words")), "parts")
    moves = F.array(*(F.struct(*(F.lit(int(x)).alias(f"d{k}") for k, x in enumerate(m))) for m in _MOVES + _INSERTS))
    left = parts.select("words", "part", *key, F.explode(moves).alias("m"))
    left = left.select(F.col("words").alias("a"), F.col("part").alias("part_a"), (F.greatest(*(F.abs(f"m.d{k}") for k in range(4))) == 0).alias("own"),
                       *((F.col(f"g{k}") + F.col(f"m.d{k}")).alias(f"g{k}") for k in range(4)))
    met = left.join(parts, key).where("NOT own OR part_a <= part")
    return met.select("a", "words", (F.col("own") & (F.col("part_a") == F.col("part"))).alias("same")).mapInArrow(_near, "word string, near string")


def group_variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the distinct ``words`` (word, n)."""
    words = stage(words, "words")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    made = words.join(best, "word", "left").withColumn("better", F.expr("-best.m >= 2 * n"))
    made = stage(made.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("better"), F.col("best.near")).alias("form"),
                             F.when(F.col("better"), -F.col("best.m")).alias("form_n")), "forms")
    up = made.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # 2, 4, ... 64 steps
        longer = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = stage(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return made.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_gram_spelling(spark, sf_dir):
    """Contract query: forms and roots of the words of ``documents``."""
    return group_variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
