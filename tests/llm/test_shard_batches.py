"""A shard's string is put together from whole batches, not segment by segment."""
import numpy as np
import pyarrow as pa

from tillsight.llm import common
from tillsight.llm import suffix_dedup as SD


def runs(batch, pieces, length):
    out = list(SD._shard(length, {})(iter(batch.slice(lo, hi - lo) for lo, hi in pieces)))
    return {a: list(zip(x, y, strict=True)) for b in out for a, x, y in zip(*(b.column(n).to_pylist() for n in ("anchor", "first", "last")), strict=True)}


def test_shard_against_brute_force_and_cuts():
    rng = np.random.default_rng(5)
    length, texts = 6, [bytes(rng.integers(97, 100, rng.integers(6, 30)).tolist()) for _ in range(60)] + [b"\xff\x00" * 8, b"only once", b"twice here"]
    copies = [1] * 62 + [2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(63)), pa.array(range(63)), pa.array(copies), pa.array(texts, pa.binary())], names=["anchor", "segment", "copies", "content"])
    seen = {}
    for t, n in zip(texts, copies, strict=True):
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + n
    want = {}
    for k, t in enumerate(texts):
        at = [i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1]
        edges = [i for i in at if i - 1 not in at], [i + 1 for i in at if i + 1 not in at]
        if at:
            want[k] = list(zip(*edges, strict=True))
    assert runs(batch, [(0, 63)], length) == want
    assert runs(batch, [(0, 10), (10, 10), (10, 41), (41, 63)], length) == want


def test_no_python_value_is_made_for_each_segment(monkeypatch):
    """The batches are cut by bytes, and each cut is handled at once."""
    cuts = []
    monkeypatch.setattr(SD, "chunks", lambda b, col: cuts.append(col) or common.chunks(b, col, 100))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([1, 1]), pa.array([b"x" * 90, b"x" * 90], pa.binary())], names=["anchor", "segment", "copies", "content"])
    assert runs(batch, [(0, 2)], 50) == {1: [(0, 41)], 2: [(0, 41)]}
    assert cuts == ["content"]
