"""External induced suffix sorting with common-prefix values.

The string lies in a file. Its LMS substrings are named, the string of names is
sorted first (recursively by the same method where it is longer than memory
allows, else in memory), and the order of the LMS suffixes then induces that of
all others: one pass in ascending order for the suffixes that are larger than
their successor (type L), one in descending order for the smaller ones (type
S). Both passes are driven by priority queues of tuples (key, position,
common-prefix value) that spill to disk: what has been put into them under
smaller keys comes out first, and equal keys in the order of arrival. At the
top level the tuples carry the length of the prefix shared with the tuple
before them, which an induced suffix gets as the least value since the last
tuple of its bucket, plus one.

Suffixes need only be sorted by their first ``limit`` symbols; values are cut
there. Suffixes that share more than that stand together in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Names that are sorted in memory; tuples that a queue holds before it spills.
MEMORY_NAMES, MEMORY_TUPLES = 1 << 22, 1 << 22
BATCH = 1 << 18
_TUPLE = np.dtype([("pos", np.int64), ("lcp", np.int32)])
_KEYED = np.dtype([("key", np.int64), ("seq", np.int64), ("pos", np.int64)])
NONE = np.int64(1 << 62)


class Column:
    """An array that is only appended to, in a file once it is long."""

    def __init__(self, dtype, memory: int):
        self.dtype, self.memory, self.parts, self.size, self.file = np.dtype(dtype), memory, [], 0, None

    def append(self, x: np.ndarray) -> None:
        if not len(x):
            return
        x = np.ascontiguousarray(x, dtype=self.dtype)
        self.size += len(x)
        if self.file is None:
            self.parts.append(x)
            if self.size > self.memory:
                self.file = tempfile.TemporaryFile()
                for p in self.parts:
                    self.file.write(p.tobytes())
                self.parts = []
        else:
            self.file.write(x.tobytes())

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        self.file.flush()
        return np.memmap(self.file, dtype=self.dtype, mode="r+", shape=(self.size,))


class BucketQueue:
    """Priority queue for few keys (below 2^16): a first-in first-out list a key, whose
    parts go to a file when too many tuples wait."""

    def __init__(self, keys: int, memory: int):
        self.lists: list[list] = [[] for _ in range(keys)]
        self.memory, self.held, self.at, self.file = memory, 0, 0, None

    def push(self, keys: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        x = np.empty(len(pos), dtype=_TUPLE)
        by = np.argsort(keys.astype(np.uint16), kind="stable")
        x["pos"], x["lcp"], keys = pos[by], lcp[by], keys[by]
        cut = np.flatnonzero(np.diff(keys)) + 1
        for k, part in zip(keys[np.concatenate([[0], cut])].tolist() if len(keys) else (), np.split(x, cut), strict=False):
            self.lists[k].append(part)
        self.held += len(x)
        if self.held > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for parts in self.lists:
                for i, p in enumerate(parts):
                    if isinstance(p, np.ndarray):
                        start = self.file.seek(0, 2)
                        self.file.write(p.tobytes())
                        parts[i] = (start, len(p))
            self.held = 0

    def pop(self):
        """(key, tuples) of the least key, some at a time; None at the end."""
        while self.at < len(self.lists) and not self.lists[self.at]:
            self.at += 1
        if self.at == len(self.lists):
            return None
        out, n = [], 0
        mine = self.lists[self.at]
        while mine and n < BATCH:
            p = mine.pop(0)
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(p[1] * _TUPLE.itemsize), dtype=_TUPLE)
            else:
                self.held -= len(p)
            if n + len(p) > 2 * BATCH:  # a long part comes in pieces
                mine.insert(0, p[BATCH:])
                self.held += len(p) - BATCH
                p = p[:BATCH]
            out.append(p)
            n += len(p)
        return self.at, np.concatenate(out) if len(out) > 1 else out[0]


class RunQueue:
    """Priority queue for many keys: sorted runs, in files when long, whose
    heads are merged."""

    def __init__(self, memory: int):
        self.memory, self.runs, self.seq = memory, [], 0

    def push(self, keys: np.ndarray, pos: np.ndarray) -> None:
        if not len(pos):
            return
        x = np.empty(len(pos), dtype=_KEYED)
        x["key"], x["pos"], x["seq"] = keys, pos, self.seq + np.arange(len(pos))
        self.seq += len(pos)
        self._add(x[np.argsort(keys, kind="stable")])

    def _add(self, x: np.ndarray) -> None:
        self.runs.append([x, 0])
        short = [r for r in self.runs if not isinstance(r[0], np.memmap)]
        if len(short) > 24:
            self.runs = [r for r in self.runs if isinstance(r[0], np.memmap)]
            x = np.concatenate([r[0][r[1]:] for r in short])
            x = x[np.lexsort((x["seq"], x["key"]))]
            if len(x) > self.memory:
                with tempfile.TemporaryFile() as f:
                    f.write(x.tobytes())
                    f.flush()
                    x = np.memmap(f, dtype=_KEYED, mode="r", shape=(len(x),))
            if len(x):
                self.runs.append([x, 0])

    def pop(self, most: int = BATCH):
        """Tuples in order, all of those up to some key; None at the end."""
        self.runs = [r for r in self.runs if r[1] < len(r[0])]
        if not self.runs:
            return None
        step = max(64, most // len(self.runs))
        while True:
            heads = [np.asarray(r[0][r[1]:r[1] + step]) for r in self.runs]
            more = [h["key"][-1] for h, r in zip(heads, self.runs, strict=True) if r[1] + len(h) < len(r[0])]
            bound = min(more, default=NONE)  # keys below it are all here
            cuts = [int(np.searchsorted(h["key"], bound)) for h in heads]
            if sum(cuts):
                break
            step *= 4
        for r, c in zip(self.runs, cuts, strict=True):
            r[1] += c
        x = np.concatenate([h[:c] for h, c in zip(heads, cuts, strict=True)])
        return x[np.lexsort((x["seq"], x["key"]))]

    def back(self, x: np.ndarray) -> None:
        """Tuples that were popped too early."""
        if len(x):
            self.runs.append([x, 0])


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True for type S. The end of the string counts as its least symbol."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # last places of runs
    out = np.zeros(n, dtype=bool)
    last = np.concatenate([change, [n - 1]])
    kind = np.zeros(len(last), dtype=bool)
    kind[:-1] = t[change] < t[change + 1]
    out[:] = np.repeat(kind, np.diff(np.concatenate([[-1], last])))
    return out


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, ``limit`` at most. ``t``
    holds 16-bit symbols; four are compared at a time."""
    n, out = len(t), np.zeros(len(a), dtype=np.int32)
    words = np.lib.stride_tricks.as_strided(np.frombuffer(t, dtype=np.uint64, count=1), (n - 3,), (2,)) if n >= 4 else None
    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo:lo + (1 << 16)].astype(np.int64), b[lo:lo + (1 << 16)].astype(np.int64)
        own, todo, done = out[lo:lo + (1 << 16)], np.arange(len(i)), 0
        while len(todo) and done < limit:
            x, y = i[todo] + done, j[todo] + done
            near = np.maximum(x, y) + 8 > n
            if near.any():  # symbol by symbol at the end of the string
                for k in np.flatnonzero(near):
                    p, q, c = int(x[k]), int(y[k]), 0
                    while c < limit and max(p, q) + c < n and t[p + c] == t[q + c]:
                        c += 1
                    own[todo[k]] += c
                todo, x, y = todo[~near], x[~near], y[~near]
            d = words[x] ^ words[y] if words is not None else x
            e = words[x + 4] ^ words[y + 4] if words is not None else x
            first = d == 0
            d = np.where(first, e, d)
            low = d & (~d + np.uint64(1))
            run = np.where(d == 0, 4, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 4) + 4 * first
            own[todo] += run.astype(np.int32)
            todo = todo[run == 8]
            done += 8
    return np.minimum(out, limit)


def names_of(t: np.ndarray, kind: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Ranks of the LMS substrings, equal ones alike."""
    n, m = len(t), len(lms)
    length = np.append(lms[1:], n - 1) - lms + 1
    bits = max(2, int(2 * symbols + 2).bit_length())
    width = max(1, 62 // bits)
    rank, todo, done = np.zeros(m, dtype=np.int64), np.arange(m), 0
    while len(todo):
        key = np.zeros(len(todo), dtype=np.int64)
        for k in range(done, done + width):
            at = np.minimum(lms[todo] + k, n - 1)
            code = np.where(k < length[todo], (t[at].astype(np.int64) + 1) * 2 + kind[at], 0)
            key = (key << bits) | code
        by = np.lexsort((key, rank[todo])) if done else np.argsort(key)
        todo, key = todo[by], key[by]
        old = rank[todo]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(todo))
        start_old = np.maximum.accumulate(np.where(new_old, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[todo] = old + start - start_old
        alone = new & np.concatenate([new[1:], [True]])
        done += width
        todo = todo[~alone & (length[todo] > done)]
    return np.unique(rank, return_inverse=True)[1].astype(np.int64)


def order_in_memory(r: np.ndarray, limit: int) -> np.ndarray:
    """Suffixes of ``r`` sorted by their first ``limit`` symbols or more, by
    prefix doubling on the ties that are left."""
    m = len(r)
    by = np.argsort(r)
    rank = np.empty(m, dtype=np.int64)
    new = np.concatenate([[True], r[by][1:] != r[by][:-1]])
    rank[by] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    place = by  # sorted positions; ties are blocks
    alone = new & np.concatenate([new[1:], [True]])
    todo = np.flatnonzero(~alone)  # places in the order
    span = 1
    while len(todo) and span < limit:
        pos = place[todo]
        second = np.where(pos + span < m, rank[np.minimum(pos + span, m - 1)], -1)
        first = rank[pos]
        s = np.argsort(first * (m + 1) + second + 1)
        pos, first, second = pos[s], first[s], second[s]
        place[todo] = pos
        new_first = np.concatenate([[True], first[1:] != first[:-1]])
        new = new_first | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(todo))
        fresh = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_first, at, 0))
        rank[pos] = fresh
        alone = new & np.concatenate([new[1:], [True]])
        todo = todo[~alone]
        span *= 2
    return place


class Carried:
    """Common-prefix values of induced tuples, by target symbol."""

    def __init__(self, symbols: int, limit: int):
        self.least = np.zeros(symbols, dtype=np.int32)  # since the last tuple of the bucket; 0 where there is none yet
        self.limit = limit

    def step(self, lcp: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """``lcp``: values of the tuples scanned in this step; those at the
        places ``at`` induce into the buckets ``target``."""
        out = np.zeros(len(at), dtype=np.int32)
        now = np.minimum(self.least, lcp.min() if len(lcp) else self.limit)
        if len(at):
            by = np.argsort(target.astype(np.uint16), kind="stable")
            t = target[by]
            cut = np.flatnonzero(np.diff(t)) + 1
            long = np.append(lcp, np.int32(self.limit))
            for own in np.split(by, cut):
                c, q = int(target[own[0]]), at[own]
                mins = np.minimum.reduceat(long, np.concatenate([[0], q + 1]))
                mins[0] = min(mins[0], self.least[c])
                out[own] = mins[:-1]
                now[c] = mins[-1]
        self.least = now
        return out


def _scan_buckets(t, queue, symbols, limit, seeds_last, target_of, memory):
    """Drive a pass over a BucketQueue with keys 2 * rank + 1 for the tuples it
    was filled with and 2 * rank for induced ones (``seeds_last``: both kinds
    of one symbol stand side by side, the induced ones first)."""
    pos_out, lcp_out, key_out = Column(np.int64, memory), Column(np.int32, memory), np.zeros(symbols, dtype=np.int64)
    carried = Carried(symbols, limit)
    last_pos, last_key = -1, -1
    while (got := queue.pop()) is not None:
        key, x = got
        pos, lcp = x["pos"].copy(), x["lcp"].copy()
        if key != last_key:  # the first of a bucket
            lcp[0] = common_prefix(t, np.array([last_pos]), pos[:1], limit)[0] if last_pos >= 0 and last_key >> 1 == key >> 1 else 0
        last_pos, last_key = int(pos[-1]), key
        if not key & 1:
            pos_out.append(pos)
            lcp_out.append(lcp)
            key_out[key >> 1] += len(pos)
        before = np.maximum(pos - 1, 0)
        rank = target_of(t[before])
        here = key >> 1
        ok = (pos > 0) & ((rank > here) | ((rank == here) & (not key & 1)))
        at = np.flatnonzero(ok)
        value = np.minimum(carried.step(lcp, at, rank[at]) + 1, limit)
        if len(at):
            queue.push(2 * rank[at], before[at], value)
    return pos_out, lcp_out, key_out


def _scan_runs(t, queue, target_of, memory):
    """The same pass over a RunQueue, without common-prefix values. Tuples
    popped together are final up to the least key that they induce into."""
    pos_out, key_out = Column(np.int64, memory), Column(np.int64, memory)
    while (x := queue.pop()) is not None:
        key, pos = x["key"], x["pos"]
        before = np.maximum(pos - 1, 0)
        rank = target_of(t[before])
        ok = (pos > 0) & ((rank > key >> 1) | ((rank == key >> 1) & (key & 1 == 0)))
        target = np.where(ok, 2 * rank, NONE)
        final = key <= np.minimum.accumulate(target)
        n = len(final) if final.all() else int(final.argmin())
        queue.back(x[n:])
        key, pos, ok = key[:n], pos[:n], ok[:n]
        own = key & 1 == 0
        pos_out.append(pos[own])
        key_out.append(key[own])
        queue.push(target[:n][ok], before[:n][ok])
    return pos_out.array(), key_out.array()


def lms_order(t: np.ndarray, kind: np.ndarray, lms: np.ndarray, symbols: int, limit: int, names_in_memory: int, memory: int) -> np.ndarray:
    """The LMS suffixes in order."""
    names = names_of(t, kind, lms, symbols)
    count = int(names.max()) + 1 if len(names) else 0
    if count == len(names):
        out = np.empty(len(names), dtype=np.int64)
        out[names] = lms
        return out
    if len(names) <= names_in_memory:
        return lms[order_in_memory(names, limit)]
    with tempfile.TemporaryFile() as f:
        f.write(names.tobytes())
        f.flush()
        del names
        reduced = np.memmap(f, dtype=np.int64, mode="r", shape=(len(lms),))
        return lms[order_of_names(reduced, count, limit, names_in_memory, memory)]


def order_of_names(t: np.ndarray, symbols: int, limit: int, names_in_memory: int, memory: int) -> np.ndarray:
    """Suffixes of a string of names, sorted by recursive induction."""
    n = len(t)
    kind = smaller_than_next(t)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    seeds = lms_order(t, kind, lms, symbols, limit, names_in_memory, memory) if len(lms) else lms
    queue = RunQueue(memory)
    queue.push(2 * t[n - 1:].astype(np.int64), np.array([n - 1]))
    queue.push(2 * t[seeds].astype(np.int64) + 1, seeds)
    large, large_key = _scan_runs(t, queue, lambda s: s.astype(np.int64), memory)
    queue = RunQueue(memory)
    top = symbols - 1
    queue.push(2 * (top - (large_key[::-1] >> 1)) + 1, np.ascontiguousarray(large[::-1]))
    small, small_key = _scan_runs(t, queue, lambda s: top - s.astype(np.int64), memory)
    key = np.concatenate([large_key, 2 * (top - (small_key[::-1] >> 1)) + 1])
    return np.concatenate([large, small[::-1]])[np.argsort(key, kind="stable")]


def sorted_suffixes(t: np.ndarray, symbols: int, limit: int, names_in_memory: int = MEMORY_NAMES, memory: int = MEMORY_TUPLES):
    """(positions, common prefix with the one before) of all suffixes of ``t``
    (symbols 0 .. symbols - 1), in order, bucket by bucket: yields pieces."""
    n = len(t)
    if not n:
        return
    kind = smaller_than_next(t)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    queue = BucketQueue(2 * symbols, memory)
    queue.push(2 * t[n - 1:].astype(np.int64), np.array([n - 1]), np.zeros(1, np.int32))
    if len(lms):
        seeds = lms_order(t, kind, lms, symbols, limit, names_in_memory, memory)
        for lo in range(0, len(seeds), 4 * BATCH):
            own = seeds[max(0, lo - 1):lo + 4 * BATCH]
            value = common_prefix(t, own[:-1], own[1:], limit)
            own, value = (own, np.append(np.int32(0), value)) if lo == 0 else (own[1:], value)
            queue.push(2 * t[own].astype(np.int64) + 1, own, value)
        del seeds
    del kind, lms
    large, large_lcp, large_n = _scan_buckets(t, queue, symbols, limit, True, lambda s: s.astype(np.int64), memory)
    large, large_lcp = large.array(), large_lcp.array()
    queue = BucketQueue(2 * symbols, memory)
    top, end = symbols - 1, len(large)
    for lo in range(0, end, 4 * BATCH):
        a, b = max(0, end - lo - 4 * BATCH), end - lo
        own = large[a:b][::-1]
        value = large_lcp[a + 1:min(b + 1, end)][::-1]
        value = value if b < end else np.append(np.int32(0), value)
        queue.push(2 * (top - t[own].astype(np.int64)) + 1, own, value)
    small, small_lcp, small_n = _scan_buckets(t, queue, symbols, limit, True, lambda s: top - s.astype(np.int64), memory)
    small, small_lcp, small_n = small.array(), small_lcp.array(), small_n[::-1]
    a, b = 0, len(small)
    for c in range(symbols):
        x, y = int(large_n[c]), int(small_n[c])
        last = -1
        if x:
            yield large[a:a + x], large_lcp[a:a + x]
            last = int(large[a + x - 1])
        if y:
            own, value = small[b - y:b][::-1], small_lcp[b - y:b][::-1]
            first = common_prefix(t, np.array([last]), own[:1], limit) if last >= 0 else np.zeros(1, np.int32)
            yield own, np.concatenate([first, value[:-1]])
        a, b = a + x, b - y
