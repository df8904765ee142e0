"""Before a shard is sorted, windows whose surroundings of the anchor are unlike
any others' leave its string; what is found stays the same."""
import numpy as np
import pyarrow as pa

from tillsight.llm import suffix_dedup as SD

LENGTH, GRAM = 40, 8


def shard(texts):
    """Segments of the texts (one row each, equal ones once), as a shard gets them."""
    rows = {}
    for k, t in enumerate(texts):
        data = np.frombuffer(t, dtype=np.uint8)
        _, first, last, key, own = SD.segments(data, np.array([0, len(t)]), LENGTH, GRAM)
        for s, e, a, x in zip(first.tolist(), last.tolist(), key.astype(np.int64).tolist(), own.astype(np.int64).tolist(), strict=True):
            rows.setdefault((a, x), [0, t[s:e + LENGTH], []])
            rows[a, x][0] += 1
            rows[a, x][2].append((k, s))
    cols = [pa.array([k[0] for k in rows]), pa.array([k[1] for k in rows]), pa.array([v[0] for v in rows.values()]), pa.array([v[1] for v in rows.values()], pa.binary())]
    return rows, pa.RecordBatch.from_arrays(cols, names=["anchor", "segment", "copies", "content"])


def found(rows, batches):
    out = set()
    for b in SD._shard(LENGTH, {}, GRAM)(iter(batches)):
        for a, x, first, last in zip(*(b.column(n).to_pylist() for n in ("anchor", "segment", "first", "last")), strict=True):
            out |= {(k, s + i) for k, s in rows[a, x][2] for f, to in zip(first, last, strict=True) for i in range(f, to)}
    return out


def repeated(texts):
    at = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - LENGTH + 1):
            at.setdefault(t[i:i + LENGTH], []).append((k, i))
    return {x for v in at.values() if len(v) > 1 for x in v}


def test_only_what_may_be_repeated_is_sorted(monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda n: bytes(rng.integers(0, 256, n).tolist())
    short, long = word(12), word(70)
    texts = [word(60) + short + word(60) for _ in range(12)] + [word(20) + long + word(30) for _ in range(4)] + [long[:55]] * 3
    rows, batch = shard(texts)
    sorted_sizes, sort = [], SD.repeated_windows
    monkeypatch.setattr(SD, "repeated_windows", lambda t, *a, **k: sorted_sizes.append(len(t)) or sort(t, *a, **k))
    want = repeated(texts)
    assert want and found(rows, [batch]) == want
    assert found(rows, [batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)]) == want
    whole = sum(len(v[1]) + 1 for v in rows.values())
    assert max(sorted_sizes) < whole / 3


def test_few_letters_against_brute_force():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        base = [bytes(rng.integers(97, 99, 120).tolist()) for _ in range(4)]
        texts = [b"".join(base[i][a:a + n] for i, a, n in zip(rng.integers(0, 4, 4), rng.integers(0, 60, 4), rng.integers(5, 60, 4), strict=True)) for _ in range(12)]
        texts = [t for t in texts if len(t) >= LENGTH] + [b"a" * 90, b"ab" * 50]
        rows, batch = shard(texts)
        assert found(rows, [batch]) == repeated(texts)
