"""One very long row beside short ones: bounded time and memory, right results."""

import time

import numpy as np
import pytest

from tillsight.llm import html_blocks, html_cut, ngram_join, url_filter
from tillsight.llm.bpe import Automaton


def _within(seconds, fn):
    t = time.time()
    out = fn()
    assert time.time() - t < seconds
    return out


RULES = [("com", "/", "allow"), ("bad.com", "/x", "block"), ("a.bad.com", "/", "block"), ("d.com", "/x", "allow"), ("bad.com", "/x/y", "allow")]


def _fits(host, path):
    """Longest rule by trying each; equally long ones go to the longer host."""
    best = [(len(h) + len(p), len(h), i) for i, (h, p, _) in enumerate(sorted(RULES))
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(best)[2] if best else -1


def test_long_host():
    rules = url_filter.RuleSet(RULES)
    hosts = ["a." * 500_000 + "bad.com", "a.bad.com", "bad.com", "xbad.com", "d.com", "a" * 1_000_000, ".", "", "com", "..bad.com"]
    paths = ["/x/y", "/x", "/x", "/x", "/xx", "/x", "/", "/", "", "/x"]
    got = _within(10, lambda: rules.judge(hosts, paths))
    assert got == [_fits(h, p) if h else -1 for h, p in zip(hosts, paths)]


def test_ties_are_the_same_at_both_sizes(spark):
    # a.bad.com + / and bad.com + /x... have equal lengths
    rules = spark.createDataFrame([("a.bad.com", "/", "block"), ("bad.com", "/xx", "allow"), ("b.a.bad.com", "", "allow")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(
        [("a.bad.com", "/xx"), ("b.a.bad.com", "/xx"), ("c.bad.com", "/xx"), ("a." * 20_000 + "bad.com", "/xx")])], "page_id long, url string")
    small = sorted(map(tuple, url_filter.url_verdicts(urls, rules).select("page_id", "rule", "verdict").collect()))
    large = sorted(map(tuple, url_filter.url_verdicts(urls, rules, broadcast_bytes=0).select("page_id", "rule", "verdict").collect()))
    assert small == large
    assert [r[1] for r in small] == ["a.bad.com/", "b.a.bad.com", "bad.com/xx", "a.bad.com/"]


def test_deep_nesting():
    page = "<div class='x'>" * 100_000 + "<p>" + "word " * 50 + "</p>" + "</section>" * 100_000 + "</div>" * 50_000 + "<nav>a menu</nav>"
    text = _within(10, lambda: html_cut.main_text(page))
    assert text == ("word " * 50).strip()
    page = "".join(f"<div>text {i} here" for i in range(20_000))
    assert len(_within(10, lambda: html_blocks.scan(page))) == 20_000
    _within(10, lambda: html_cut.main_text(page))


def test_many_alternating_blocks():
    n = 40_000
    rng = np.random.default_rng(0)
    source, sink = np.where(np.arange(n) % 2, 3, 0.5) * rng.random(n), np.where(np.arange(n) % 2, 0.5, 3) * rng.random(n)
    edges = [(i, i + 1, 0.4) for i in range(n - 1)]
    side = _within(10, lambda: html_cut.min_cut(source.tolist(), sink.tolist(), edges))
    # the cheapest labelling of a chain, by its places from left to right
    cost = np.zeros((n, 2))
    cost[0] = source[0], sink[0]
    for i in range(1, n):
        for k in (0, 1):
            cost[i, k] = (source[i], sink[i])[k] + min(cost[i - 1, k], cost[i - 1, 1 - k] + 0.4)
    own = sum(sink[i] if x else source[i] for i, x in enumerate(side)) + 0.4 * sum(a != b for a, b in zip(side, side[1:]))
    assert own == pytest.approx(cost[-1].min(), abs=1e-6)


def test_very_long_word():
    letters = "abcde"
    vocab = {c: i for i, c in enumerate(letters)} | {c + "</w>": 5 + i for i, c in enumerate(letters)}
    merges = [("a", "b"), ("ab", "c"), ("d", "e</w>"), ("ab", "ab"), ("abc", "de</w>")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    auto = Automaton(vocab, merges, "</w>")

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for pair in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == pair:
                    parts[i:i + 2] = ["".join(pair)]
                i += 1
        return [vocab[x] for x in parts]

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 8, 200):
        word = "".join(rng.choice(list(letters), n))
        assert auto.walk(word.encode()) == plain(word)
    word = "".join(rng.choice(list(letters), 1_000_000))
    ids = _within(10, lambda: auto.walk(word.encode()))
    assert "".join(auto.labels[i] for i in ids) == word + "</w>"


def test_links_through_a_null_id(spark):
    words = [f"w{i}" for i in range(120)]
    a, b, c = words, words[:113] + [f"b{i}" for i in range(7)], words[:106] + [f"b{i}" for i in range(14)]

    def grams(x):
        return {tuple(x[i:i + 5]) for i in range(len(x) - 4)}

    def close(x, y):
        return 100 * len(grams(x) & grams(y)) >= 80 * len(grams(x) | grams(y))

    assert close(a, b) and close(b, c) and not close(a, c)
    alone = [f"z{i}" for i in range(50)]
    df = spark.createDataFrame([(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, " ".join(alone)), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.near_duplicates(df).collect()}
    assert got[1, 116] == 1 and got[2, 116] == 1 and got[None, 116] == 1 and got[None, 46] is None and got[5, 0] == 5
