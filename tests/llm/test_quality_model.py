"""The perplexity filter against a brute-force Kneser-Ney model."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tillsight.llm import quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def windows(text):
    """The 5 bytes that end at each byte of each word and the space behind it,
    run through the text."""
    words = WORD.findall((text or "").encode())
    run = b"\0\0\0 " + b" ".join(words) + b" "
    return [run[k - 4:k + 1] for k in range(4, len(run))] if words else []


def brute_bits(rows):
    """Mean bits a window of every (id, text, lang), modified Kneser-Ney of order 5."""
    models = {}
    for lang in {r[2] for r in rows}:
        c = {5: Counter(w for _, t, lg in rows if lg == lang for w in windows(t))}
        for n in (4, 3, 2, 1):
            c[n] = Counter(g[1:] for g in c[n + 1])
        p = {b"": 1 / 256}
        for n in range(1, 6):
            k = Counter(min(x, 5) for x in c[n].values())
            y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0
            d = [min(max(i - (i + 1) * y * (k[i + 1] / k[i] if k[i] else 0), 0.1), i - 0.05) if y else 0.5 for i in (1, 2, 3)]
            total, back = defaultdict(int), defaultdict(float)
            for g, x in c[n].items():
                total[g[:-1]] += x
                back[g[:-1]] += d[min(x, 3) - 1]
            p |= {g: (x - d[min(x, 3) - 1]) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, x in c[n].items()}
        models[lang] = p
    return [-sum(math.log2(models[lg][w]) for w in own) / len(own) if (own := windows(t)) else 0.0 for _, t, lg in rows]


def corpus():
    rnd = random.Random(8)
    words = ["the", "of", "ruin", "late", "häuser", "x1", "日本"]
    rows = [(i, "\n".join(" ".join(rnd.choice(words) + rnd.choice(["", "s", str(rnd.randint(0, 9))]) for _ in range(rnd.randint(1, 9))) for _ in range(12)), ("en", "de", "")[i % 3]) for i in range(40)]
    return [*rows, (50, None, "en"), (51, "", "fr"), (52, "  ", "de"), (53, "sólo", "es")]


@pytest.mark.parametrize("part_rows", [40, 1 << 20])
def test_all_orders_whatever_the_parts(spark, monkeypatch, part_rows):
    """A model far beyond one part scores with order 5, as a small one does."""
    rows = corpus()
    monkeypatch.setattr(quality, "WAVE_BYTES", 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {r["doc_id"]: r["bits"] for r in quality.quality_rules(docs, part_rows=part_rows).collect()}
    for (i, *_), want in zip(rows, brute_bits(rows)):
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4), i


def test_word_order_counts(spark):
    """Word salad made of ordinary words stands out, though every word is common."""
    rnd = random.Random(6)
    mid = [a + b for a in "bcdfgklm" for b in "aeiou"]
    kinds = [["a" + x for x in mid], [x + "eo" for x in mid], [x + "us" for x in mid], ["i" + x + "t" for x in mid]]
    rows = [(i, " ".join(rnd.choice(kinds[k % 4]) for k in range(400)), "en") for i in range(80)]
    salad = rows[0][1].split()
    rnd.shuffle(salad)
    docs = spark.createDataFrame([*rows, (99, " ".join(salad), "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()} == set(range(80))


def test_bands_by_language_and_size(spark):
    """Bands follow the spread of their size; copies don't narrow them."""
    rnd = random.Random(7)
    rows = [(f"{size}-{i}", size, 2 + rnd.uniform(-spread, spread)) for size, spread in ((6, 0.4), (9, 0.12)) for i in range(200)]
    rows += [("copy", 6, 2.0)] * 900
    scored = spark.createDataFrame([("en", s, hash(k) if k == "copy" else n, b, False) for n, (k, s, b) in enumerate(rows)], "lang string, size int, text_key long, bits double, base_failed boolean")
    got = {r["size"]: r for r in quality.bands(scored, ["lang", "size"]).collect()}
    for size in (6, 9):
        v = sorted({(k, b) for k, s, b in rows if s == size}, key=lambda x: x[1])
        mid = v[(len(v) - 1) // 2][1]
        mad = sorted(abs(b - mid) for _, b in v)[(len(v) - 1) // 2]
        half = max(quality.WIDTH * 1.4826 * mad, quality.MIN_BITS)
        assert got[size]["texts"] == len(v)
        assert math.isclose(got[size]["low_bits"], mid - half, abs_tol=0.01) and math.isclose(got[size]["high_bits"], mid + half, abs_tol=0.01)


def middle(v):
    return sorted(v)[(len(v) - 1) // 2]


def test_verdicts_of_real_rows(spark):
    """op10 and the pipeline's first stage on sf0.001 against brute force."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    bits = brute_bits(rows)
    got = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, sf).collect()}
    # different texts that pass the base rules, by language and size
    texts = {(lang, text): (got[i]["n_words"].bit_length(), b) for (i, text, lang), b in zip(rows, bits) if not got[i]["base_failed"]}

    def band(values):
        mid = middle(values)
        return mid, max(quality.WIDTH * 1.4826 * middle([abs(v - mid) for v in values]), quality.MIN_BITS)

    sure, inside = 0, set()
    for (i, _, lang), b in zip(rows, bits):
        assert math.isclose(got[i]["perplexity"], 2 ** b, rel_tol=1e-3), i
        size = got[i]["n_words"].bit_length()
        group = [v for (lg, _), (s, v) in texts.items() if (lg, s) == (lang, size)]
        group = group if len(group) >= quality.MIN_GROUP else [v for (lg, _), (_, v) in texts.items() if lg == lang]
        if got[i]["base_failed"]:
            assert not got[i]["kept"]
            continue
        mid, half = band(group)
        if abs(abs(b - mid) - half) > 0.01:  # bins of the medians
            assert got[i]["kept"] == (abs(b - mid) <= half), i
            sure += 1
        if got[i]["kept"]:
            inside.add(i)
    assert sure > 0.9 * sum(not r["base_failed"] for r in got.values())
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).collect()} == inside
