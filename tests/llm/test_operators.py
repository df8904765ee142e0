"""Dealt operators against brute force, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tillsight.llm import html_cut, induced, kdtree, line_dedup, ngram_join, packing, quality, suffix_dedup, url_filter, warc
from tillsight.llm.bpe import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, node string, key string, row string"


def doc_rows():
    rnd = random.Random(3)
    words = ["alpha", "beta", "Gamma", "dél", "x1", "the", "of", "日本", "rent"]

    def text(n):
        return " ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(n))

    base = text(120)
    near = base.replace(base.split()[60], "changed", 1)
    long = text(6000)
    passage = "Ünchanging passage " + text(60)
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "one two"), (9, long),
            (10, text(30) + passage + text(20)), (11, text(10) + passage), (12, "a" * 500), (13, "a" * 450), (None, base), (14, "x\n" + base)]
    return [(i, t, "en" if k % 3 else None, "n", "k", "r") for k, (i, t) in enumerate(rows)] + [(1, base, "en", "n", "k", "r")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_windows(texts, length):
    seen = Counter(b[s:s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("memory", [(1 << 20, 1 << 20), (0, 2), (3, 3)])
def test_induced_sorting_equals_sorting(memory):
    rnd = random.Random(memory[0])
    for _ in range(150):
        n, symbols = rnd.randint(1, 50), rnd.choice([1, 2, 4, 20])
        t = [rnd.randrange(symbols) for _ in range(n)]
        pos, lcp = [], []
        for p, v in induced.sorted_suffixes(np.array(t, dtype=np.uint16), symbols, 1000, *memory):
            pos += p.tolist()
            lcp += v.tolist()
        want = sorted(range(n), key=lambda i: t[i:])
        shared = [0] + [next((k for k in range(n) if t[a + k:a + k + 1] != t[b + k:b + k + 1] or a + k >= n or b + k >= n), n) for a, b in zip(want, want[1:])]
        assert pos == want and lcp == shared


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs, form="digest")
    rows = [(r[0], r[1]) for r in doc_rows()]
    want = brute_windows([(t or "").encode() for _, t in rows], 200)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["_bytes"], r["_removed"], r["_runs"], r["_rest"]) for r in got.collect()), key=key) == sorted(
        ((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert suffix_dedup.remove_repeats(none, form="digest").count() == 0
    texts = suffix_dedup.remove_repeats(docs, form="text").collect()
    assert [r["_rest"] for r in texts if r["doc_id"] == 4] == [None]


def test_suffix_dedup_splits_anchors_beyond_a_shard(spark):
    rnd = random.Random(9)

    def noise(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))

    passages = [noise(260), noise(230), "xy" * 150, noise(199)]
    lefts, rights = [noise(90) for _ in range(4)], [noise(90) for _ in range(4)]
    rows = [(k, noise(rnd.randint(0, 120)) + rnd.choice(lefts)[rnd.randint(0, 90):] + passages[k % 4] + rnd.choice(rights)[:rnd.randint(0, 90)] + noise(rnd.randint(0, 120)), "x") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shift string").repartition(4)
    want = [(i, *w) for (i, _, _), w in zip(rows, brute_windows([t.encode() for _, t, _ in rows], 200))]
    for most in (100, 3000, 1 << 20):
        got = suffix_dedup.remove_repeats(docs, form="digest", shard_bytes=most)
        assert sorted((r["doc_id"], r["_bytes"], r["_removed"], r["_runs"], r["_rest"]) for r in got.collect()) == want


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    return [(rows[a][0], len(sets[a]), min((rows[b][0] for b in range(len(rows)) if top(b) == top(a) and rows[b][0] is not None), default=None)) for a in range(len(rows))]


def test_ngram_join(docs, none):
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute_components([(r[0], r[1]) for r in doc_rows()]), key=key)
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"edit{rnd.random()}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted(brute_components(rows))


def test_probe_equals_intersection():
    rnd = np.random.default_rng(1)
    own = np.unique(rnd.integers(0, 400, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([own[rnd.random(len(own)) < p], rnd.integers(0, 400, 30).astype(np.uint64)])) for p in rnd.random(80)] + [own, own[:0]]
    want = [100 * len(np.intersect1d(own, s)) >= 80 * len(np.union1d(own, s)) for s in sets]
    assert ngram_join.Probe(own, 80).similar(sets) == want


def test_quality_base_rules_and_empty(docs, none):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_rules(docs).collect()}
    want = set()
    for i, t, *_ in doc_rows():
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)))
    assert got == want
    assert quality.quality_rules(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_language_model_sums_to_one(spark):
    rows = spark.createDataFrame([("en", "the cat sat on the mat and the dog"), ("en", "a cat and a hat"), (None, "autre chose")], "lang string, text string")
    lm = quality.fit(rows)
    for context in (b"\0\0\0 ", b"\0 th", b" cat", b"zzzz"):
        head = int.from_bytes(context, "big")
        p = 2.0 ** lm.log2("en", np.array([head << 8 | b for b in range(256)], dtype=np.uint64))
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-4)
    one = quality.fit(rows, model_bytes=quality.ROW_BYTES * 60)
    assert one.order < quality.ORDER


def test_language_model_rejects_noise(spark):
    rnd = random.Random(2)
    syl = ["ta", "re", "mi", "no", "ka", "lo"]
    good = [(i, " ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(300)), "en") for i in range(60)]
    bad = (99, " ".join("".join(rnd.choice("qxzwvkj#7") for _ in range(7)) for _ in range(300)), "en")
    kept = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame([*good, bad], "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(60))


def test_line_templates(spark, none):
    boiler = "Visited by user{} on day {} of the year"
    rows = [(i, f"own first line {'abcdefghijkl'[i]} here\n{boiler.format(i, i * 7)}\nown last words {'abcdefghijkl'[-i - 1]} there", "k") for i in range(8)]
    rows += [(100 + i, "copied text stands here\nand its second line too\nand a third one", "k") for i in range(9)]
    rows += [(50, None, "k"), (51, "", "k"), (None, rows[0][1], "k")]
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, leaf string")).collect()}
    assert all(got[i]["_gone"] == 1 and "Visited" not in got[i]["_kept"] and got[i]["_lines"] == 3 for i in range(8))
    assert all(got[100 + i]["_gone"] == 0 for i in range(9))  # copies are left to document deduplication
    assert got[50]["_kept"] is None and got[51]["_kept"] == "" and got[None]["_gone"] == 1
    assert line_dedup.drop_lines(none).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(0)
    vecs = rnd.normal(size=(700, 8)).round(1)
    vecs[300:400] = vecs[300]  # ties
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vecs)]
    rows += [(1000, None, "c"), (1050, [1.0, None], "c"), (1100, [float("nan")] * 8, "c"), (None, rows[0][1], "c"), (1150, [], "c"), (1200, [], "c"), (1250, [2.0], "c"), rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string").repartition(3)
    got = sorted(tuple(r) for r in kdtree.top_k(df, df.where("vec_id % 50 = 0")).collect())
    real = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = set()
    for q, qv in real:
        if q % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in real if i != q and len(v) == len(qv))[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(hits))
    assert got == sorted(want)
    assert kdtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.com/en/x", "https://WWW.Example.com/en/1?q=://x", "http://example.com/en/", "http://example.com", "http://x.net/fr/a#b", "http://net/es/", "http://anet/es/", None, "", "no scheme", "a://b?x", "http://.com/", "http://x.example.com/en/" + "y" * 5000]
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls + urls)], "page_id long, url string, path string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(url_filter.url_verdicts(df, rules).select(cols).collect())
    for r in got:
        host, path = url_filter.split_url((urls + urls)[r["page_id"]])
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (max(fit)[1:] if fit else (None, "allow"))
    large = url_filter.url_verdicts(df, rules, broadcast_bytes=0).withColumnRenamed("key", "page_id").select(cols)
    assert sorted(large.collect()) == got
    assert url_filter.url_verdicts(df.limit(0), rules).count() == 0


def test_digest_array_confirms_strings():
    items = [b"a", b"bb", b"ccc"]
    same = np.zeros(3, dtype=np.uint64)  # all digests collide
    a = url_filter.DigestArray(items, same)
    assert a.find([b"ccc", b"x", b"a"], same).tolist() == [2, -1, 0]


def test_min_cut_is_minimal():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randint(1, 7)
        s, t = [[rnd.randint(0, 9) for _ in range(n)] for _ in range(2)]
        edges = [(a, b, rnd.randint(0, 5)) for a in range(n) for b in range(a) if rnd.random() < 0.5]

        def cost(side):
            return sum(t[i] if x else s[i] for i, x in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert math.isclose(cost(html_cut.min_cut(s, t, edges)), min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)), abs_tol=1e-6)


def test_html_main_text(spark):
    page = ("<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><header>Site</header>"
            "<article><header><h1>Head &amp; more</h1></header><p>First  <b>bold</b>\n text&nbsp;here.<p>Second<br>line</article><div class='comments'><p>A reader says a lot of words here</p></div>"
            "<aside>Side</aside><form>Sign up <input></form><footer>&copy; foot</footer></body></html>")
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<article><p>cut <b", "x"), (4, "u", "<p>" + "long words here " * 20000, "x")]
    got = {r["page_id"]: r for r in html_cut.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "Head & more\nFirst bold text here.\nSecond line"
    assert got[2]["text"] == "" and got[None]["n_chars"] == 0 and got[3]["text"] == "cut" and got[4]["n_chars"] == 16 * 20000 - 1


def test_warc_records(spark):
    rows = [(1, "http://a/b", "<html lang='de'><title>T</title><p>Hé <a href='/l'>x</a></p>", "c"), (2, None, None, "c"), (None, "", "", "c"), (1, "http://a/b", "<p>", "c")]
    responses = warc.responses_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string, content string"), "2024-01-01T00:00:00Z")
    made = [r.asDict() for r in warc.derive(responses, "source_key").collect()]
    assert len(made) == 8
    by = {(r["source_key"], r["record_type"], r["payload_digest"]): r for r in made}
    first = warc.digest(rows[0][2].encode())
    meta, text = by[1, "metadata", first], by[1, "conversion", first]
    assert meta["refers_to"] == text["refers_to"] and meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert text["content"] == "Hé x" and "outlink: /l" in meta["content"] and "title: T" in meta["content"]
    assert text["block_digest"] == warc.digest("Hé x".encode()) and text["source_headers"]["Content-Type"] == "text/html; charset=utf-8"
    [(head, block)] = list(warc.records(warc.serialize(text)))
    assert head["warc-refers-to"] == text["refers_to"] and block.decode() == "Hé x"


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_library(spark, tokenizer_path):
    from tokenizers import Tokenizer as Library

    mine, lib = Tokenizer.load(tokenizer_path), Library.from_file(tokenizer_path)
    lib.no_truncation()
    lib.no_padding()
    rnd = random.Random(0)
    texts = ["", " ", "It's THE end<|endoftext|>x", "aaaa hahahaha ΣΑΣ İ ²½Ⅷ 日本 😂😂 \x1c\x85\u200b", "w" * 3000]
    texts += ["".join(rnd.choice("aehinrst' É1😂.\n") for _ in range(rnd.randint(1, 50))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        ids, labels = mine.encode_and_decode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert labels.decode() == lib.decode(want, skip_special_tokens=False) == mine.decode(want)


def test_packing(docs, none, tokenizer_path):
    rows = packing.pack_documents(docs, tokenizer_path, capacity=64).collect()
    tok = Tokenizer.load(tokenizer_path, False)
    total = sum(len(tok.encode(r[1])) // 4 + 1 for r in doc_rows())
    assert sum(r["length"] for r in rows) == total
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    big = sum(r["length"] > 32 for r in rows)  # no two of these share a sequence
    assert len(by) <= 1.01 * max(big, -(-total // 64)) + 1
    assert packing.pack_documents(none, tokenizer_path).count() == 0


def test_packing_plan_is_exact():
    rnd = random.Random(1)
    hist = {k: rnd.randint(1, 50) for k in rnd.sample(range(1, 2049), 300)}
    got = Counter()
    plan = packing.solve(hist)
    for config, m in plan:
        assert sum(k * n for k, n in config.items()) <= 2048
        for k, n in config.items():
            got[k] += n * m
    assert got == Counter(hist)
    # no worse than best-fit decreasing, piece by piece
    import bisect

    rooms = []
    for k in sorted(Counter(hist).elements(), reverse=True):
        at = bisect.bisect_left(rooms, k)
        room = rooms.pop(at) if at < len(rooms) else 2048
        bisect.insort(rooms, room - k)
    assert sum(m for _, m in plan) <= len(rooms)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.stage(step(spark, docs, SF), "test")
        assert out.columns == docs.columns, name
        docs = out
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(a == c for a, _, c in brute_components(rows) if c is not None)  # one of each group is left
    left = corpus_pipeline.passages(spark, docs, SF)
    want = {i: w[3] for (i, _), w in zip(rows, brute_windows([(t or "").encode() for _, t in rows], 200))}
    digests = {r["doc_id"]: r["_rest"] for r in suffix_dedup.remove_repeats(docs, form="digest").collect()}
    assert digests == want and left.columns == docs.columns
    pieces = corpus_pipeline.packing(spark, left, SF).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows}
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0
