"""Recurring lines in blocks, at document edges and beside copies."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillsight.llm import line_dedup

BLOCK = ["All rights are held by the house", "Terms of use hold for every reader", "Write to the desk for any question", "Printed in the old town hall"]


def prose(rnd, lines=4):
    return ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(3)) + " " + " ".join(
        "".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(9)) for _ in range(lines)]


def gone(spark, rows):
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r["doc_id"]: set((dict(rows)[r["doc_id"]] or "").split("\n")) - set(r["_kept"].split("\n")) for r in got}


@pytest.mark.parametrize("place", ["head", "middle", "foot"])
def test_block_in_different_documents(spark, place):
    rnd = random.Random(1)
    rows = []
    for i in range(12):
        own = prose(rnd)
        at = {"head": 0, "middle": 2, "foot": 4}[place]
        rows.append((i, "\n".join(own[:at] + BLOCK + own[at:])))
    assert all(x == set(BLOCK) for x in gone(spark, rows).values())


def test_short_lines(spark):
    """One or two tokens are judged like longer lines; blank lines and
    variable fields alone stay."""
    rnd = random.Random(7)
    rows = []
    for i in range(12):
        own = prose(rnd)
        rows.append((i, "\n".join([own[0], "Share", own[1], "", "Read more", str(i), own[2], "Page 7"] + [f"only{i}"] * 3)))
    assert all(x == {"Share", "Read more"} for x in gone(spark, rows).values())


def test_very_long_line(spark):
    rnd = random.Random(8)
    long = " ".join(prose(rnd, 40_000))
    rows = [(i, "\n".join([long if i < 6 else "short", *prose(rnd, 2)])) for i in range(8)]
    assert {i: x == {long} for i, x in gone(spark, rows).items()} == {i: i < 6 for i in range(8)}


def test_line_beside_copies(spark):
    rnd = random.Random(2)
    one = prose(rnd, 5)
    rows = [(i, "\n".join(one[:2] + BLOCK[:1] + one[2:])) for i in range(60)]
    for i in range(100, 140):
        own = prose(rnd)
        rows.append((i, "\n".join(own[:2] + BLOCK[:1] + own[2:])))
    assert all(x == {BLOCK[0]} for x in gone(spark, rows).values())


def test_copies_and_near_copies_stay(spark):
    rnd = random.Random(3)
    one, rows = prose(rnd, 12), []
    for i in range(80):
        words = [x.split() for x in one]
        words[rnd.randrange(12)][rnd.randrange(10)] = f"edit{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"
        rows.append((i, "\n".join(map(" ".join, words))))
    rows += [(100 + i, "\n".join(prose(random.Random(4), 6))) for i in range(20)]
    assert not any(gone(spark, rows).values())


def test_line_in_copies_of_several_documents(spark):
    rnd, rows = random.Random(5), []
    for i in range(8):
        text = "\n".join(prose(rnd, 3) + BLOCK[:2] + prose(rnd, 3))
        rows += [(10 * i + k, text) for k in range(7)]
    assert all(x == set(BLOCK[:2]) for x in gone(spark, rows).values())


SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute_lines(rows):
    """Places of the lines that the rule drops, by document; only the hashes of
    the sampled windows are taken from the module."""
    parsed, samples = {}, {}
    for i, text in rows:
        lines = [tuple("*" if re.search(r"[0-9@]|://", w) else w for w in SPACES.split(x) if w) for x in text.split("\n")]
        parsed[i] = lines
    leaf = lambda x: (len(x), x[:line_dedup.DEPTH])
    usable = {i: [(k, x) for k, x in enumerate(lines) if len(x) >= line_dedup.MIN_TOKENS] for i, lines in parsed.items()}
    popular = Counter(f for own in usable.values() for f in {leaf(x) for _, x in own})
    usable = {i: [(k, x) for k, x in own if popular[leaf(x)] >= line_dedup.MIN_DOCS] for i, own in usable.items()}
    docs = Counter(x for own in usable.values() for x in {x for _, x in own})
    seen = Counter()
    for x, n in docs.items():
        seen.update({(leaf(x), k, w): n for k, w in enumerate(x)})
    template = {}
    for x in docs:
        fixed = frozenset((k, w) for k, w in enumerate(x) if w != "*" and seen[leaf(x), k, w] >= line_dedup.MIN_DOCS)
        if fixed and len(fixed) >= len(x) * line_dedup.CONSTANT:
            template[x] = (leaf(x), fixed)
    around, holders, number = defaultdict(set), defaultdict(set), Counter()
    for x, t in template.items():
        number[t] += docs[x]
    texts = dict(rows)
    for i, own in usable.items():
        full = [k for k, x in enumerate(parsed[i]) if x]
        met = set()
        for k, x in own:
            holders[x].add(texts[i])
            if x not in met and x in template:
                at = full.index(k)
                around[template[x]].add((parsed[i][full[at - 1]] if at else None, parsed[i][full[at + 1]] if at + 1 < len(full) else None))
            met.add(x)
        if own:
            data = np.frombuffer(texts[i].encode(), dtype=np.uint8)
            samples[i] = set(line_dedup._samples(line_dedup.Lines(data, np.array([0, len(data)]), line_dedup.DEPTH), np.array([0]))[0].tolist())
    common = Counter(v for s in samples.values() for v in s)
    kind, group = {}, Counter()
    for i, s in samples.items():
        rare = [(common[v], v) for v in s if common[v] < line_dedup.MIN_DOCS]
        own = len(rare) >= line_dedup.OWN * len(s)
        kind[texts[i]] = (own, max(rare)[1] if own else min((common[v], v) for v in s if common[v] >= line_dedup.MIN_DOCS)[1])
        group[kind[texts[i]]] += 1
    kind = {t: c for t, c in kind.items() if c[0] or 2 * group[c] >= common[c[1]]}
    bad = {t for t, n in number.items() if n >= line_dedup.MIN_DOCS and len(around[t]) >= line_dedup.SURROUNDINGS * n}
    bad |= {t for x, t in template.items() if len({kind[h][1] for h in holders[x] if h in kind}) >= line_dedup.MIN_DOCS}
    return {i: {k for k, x in own if template.get(x) in bad} for i, own in usable.items()}


def test_lines_of_real_rows(spark):
    """op7 and the pipeline's second stage on sf0.001 against brute force."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_lines(rows)
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}
    assert any(want.values())
    got = line_dedup_query(spark, sf)
    assert got == {i: (len(t.split("\n")), len(want[i]), left[i]) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, sf).collect()} == left


def line_dedup_query(spark, sf):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.op7_line_templates(spark, sf).collect()}
