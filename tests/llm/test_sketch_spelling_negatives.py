"""SetSketch near duplicates, spelling variants and hard negatives against
brute force, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillsight.llm import hard_negatives as hn
from tillsight.llm import setsketch as ss
from tillsight.llm import spelling as sp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, node long, key string, n string, mark string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- near duplicates ---------------------------------------------------------

def shingle_set(text):
    w = WORD.findall(lower(text))
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[top(a)].append(i)
    out = []
    for a, (i, _) in enumerate(rows):
        own = min((x for x in least[top(a)] if x is not None), default=None)
        out.append((i, len(sets[a]), own, None if i is None or own is None else i == own))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", "n", "m") for i, t in rows], DOCS).repartition(4)


def near_copies(rnd, words, times, each):
    rows = []
    for _ in range(times):
        w = list(words)
        for _ in range(each):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 10**6)}"
        rows.append(" ".join(w))
    return rows


def test_near_duplicates(spark):
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "one two", "One TWO", "one two three", "é " * 3]
    for size in (4, 5, 6, 40, 200, 900):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(size)]
        texts += near_copies(rnd, base, 6, max(1, size // 120)) + near_copies(rnd, base, 3, 4) + [" ".join(base)] * 3
    texts.append(" ".join(f"x{k % 701}" for k in range(30000)))  # a long text
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(5, "another text with the id five and more words"), (1, texts[-1])]
    assert found(ss.near_duplicates(frame(spark, rows))) == brute_components(rows)
    assert ss.near_duplicates(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(("small", "block"), [(1 << 20, 256), (4, 8)])
def test_near_duplicates_of_a_group_around_the_threshold(spark, monkeypatch, small, block):
    """A group whose members are similar to the centre and hardly to each
    other, and one whose members are all just below the threshold."""
    monkeypatch.setattr(ss, "SMALL", small)
    monkeypatch.setattr(ss, "BLOCK", block)
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = list(enumerate(near_copies(rnd, base, 60, 4) + near_copies(rnd, base, 60, 9) + near_copies(rnd, base[150:] + base[:100], 30, 3)))
    assert found(ss.near_duplicates(frame(spark, rows))) == brute_components(rows)


def test_a_row_without_id_links_others(spark):
    w = [f"w{k}" for k in range(100)]
    a, b, c = w, [*w[:96], *(f"x{k}" for k in range(4))], [*w[:92], *(f"x{k}" for k in range(4)), *(f"y{k}" for k in range(4))]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c))]
    assert found(ss.near_duplicates(frame(spark, rows))) == brute_components(rows)


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(ss.op11_setsketch(spark, SF)) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_registers_are_mergeable_and_locality_sensitive():
    rnd = np.random.default_rng(3)
    values = np.unique(rnd.integers(0, 1 << 63, 5000, dtype=np.uint64))
    a, b = values[:3000], values[1000:]

    def regs(x):
        return ss.registers(x, np.array([0, len(x)]))
    assert (ss.merge(regs(a), regs(b)) == regs(values)).all()
    many = ss.registers(np.concatenate([a, b, values[:0], values]), np.cumsum([0, len(a), len(b), 0, len(values)]))
    assert (many[0] == regs(a)[0]).all() and (many[1] == regs(b)[0]).all() and not many[2].any() and (many[3] == regs(values)[0]).all()
    for j in (0.85, 0.9):
        equal, passed = [], []
        for _ in range(60):
            n = int(rnd.integers(20, 2000))
            both = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = rnd.integers(0, 1 << 63, math.ceil(n * (1 - j) / j), dtype=np.uint64)
            cut = len(extra) // 2
            x, y = regs(np.concatenate([both, extra[:cut]]))[0], regs(np.concatenate([both, extra[cut:]]))[0]
            equal.append((x == y).mean())
            passed.append(ss.may_link(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([n + cut]), np.array([n + len(extra) - cut]), 84)[0])
        assert abs(np.mean(equal) - j) < 0.03 and all(passed)
    far = ss.may_link(np.array([50]), np.array([50]), np.array([500]), np.array([500]))
    assert not far[0]


# --- spelling ----------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    form, near = {}, {}
    for w in n:
        own = [v for k in (-1, 0, 1) for v in by[len(w) + k] if one_edit(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, c, near[w], form.get(w), n[form[w]] if w in form else None, root(w)) for w, c in n.items())


def test_spelling_of_made_words(spark):
    rnd = random.Random(4)
    pool = ["aaaaa", "aaaab", "aaaba", "abcde", "bcdea", "abcdef", "abxdef", "éàüöß", "éàüöÉ", "Straße", "strasse", "x" * 400, "x" * 401, "y" * 9000, "y" * 8999 + "z", "ab", "wordÿÀ", "wordÿà"]
    pool += ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 8))) for _ in range(120)]
    rows = []
    for i in range(150):
        rows.append((i if i % 13 else None, " ".join(rnd.choice(pool)[:9000] if rnd.random() < 0.98 else pool[13] for _ in range(rnd.randint(0, 60))).replace("abc", rnd.choice(["abc", "ABC"]))))
    rows += [(1, None), (2, ""), (3, "... 12 —"), rows[5], rows[5]]
    got = found(sp.group_variants(sp.count_words(frame(spark, rows))))
    assert got == sorted(brute_spelling(rows), key=str)
    assert sp.group_variants(sp.count_words(frame(spark, rows).limit(0))).collect() == []


def test_spelling_chain_to_the_last_form(spark):
    chain = ["abcde" + "f" * k for k in range(8)]
    words = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: r["root"] for r in sp.group_variants(words).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def test_spelling_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(sp.op12_gram_spelling(spark, SF)) == sorted(brute_spelling([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)


# --- hard negatives ----------------------------------------------------------

def brute_negatives(rows, positives=5, negatives=10):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, y, tuple(v)) for i, y, v in ok if i % 100 == 0}:
        scored = sorted((-sum(x * z for x, z in zip(a[2], v, strict=True)), i, y) for i, y, v in ok if i != a[0] and len(v) == len(a[2]))
        for place, (p, pid, _) in enumerate([s for s in scored if s[2] == a[1]][:positives], 1):
            fit = [s for s in scored if s[2] != a[1] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a[0], pid, rank, nid, -p, -s, place) for rank, (s, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("clustered", [False, True])
def test_hard_negatives(spark, clustered, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 4)
    monkeypatch.setattr(hn, "WAVE_BYTES", 8000)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 24))
    rows = []
    for i in range(700):
        v = centres[i % 6] * rnd.uniform(0.2, 2) + rnd.normal(size=24) * 0.2 if clustered else rnd.normal(size=24)
        rows.append((i, int(rnd.integers(0, 3)), [float(x) for x in v]))
    rows += [(100, 1, None), (200, None, rows[0][2]), (300, 1, [float("nan")] * 24), (400, 1, [None, 1.0]), (None, 1, rows[1][2]),
             rows[3], rows[3], rows[500], (800, 2, [0.0] * 24), (900, 1, [1.0, 2.0]), (901, 1, [2.0, 1.0]), (902, 0, [0.5, 0.5]), (1000, 1, []), (1001, 1, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, anchor string").repartition(5)
    got = found(hn.mine(df, df["vec_id"] % 100 == 0))
    assert got == brute_negatives(rows) and got
    assert hn.mine(df.limit(0), df["vec_id"] % 100 == 0).collect() == []


def test_angles_leave_rows_out_where_directions_differ():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(12, 64)) * 100
    vecs = np.floor(centres[rnd.integers(0, 12, 3000)] + rnd.normal(size=(3000, 64)) * 10)
    refs = hn.axes(64, vecs[:500])
    ids, labels = np.arange(3000), rnd.integers(0, 3, 3000)
    rows = hn.Shard.of(hn.Shard.row(ids, labels, vecs, refs))
    anchors = hn.Shard.of(hn.Shard.row(ids[:40], labels[:40], vecs[:40], refs))
    low, high = hn.bounds(anchors, slice(0, 40), rows)
    score = vecs[:40] @ vecs.T
    assert (low <= score).all() and (score <= high).all()
    tally = [0]
    hn.scan(anchors, rows, [[hn.Best(5)] for _ in range(40)], True, tally)
    assert tally[0] < 0.1 * 40 * 3000
