"""First centres of many k-means runs in the same passes over the points.

MLlib's k-means|| draws a first point, then twice adds about 2k points by
their squared distance, and reduces these to k. A fit does it in some seven jobs
of its own. Here every job does one step for all runs; the random numbers are
Spark's, made from the place of a point in its partition, so that each run
starts from the centres that ``KMeans(k=k, seed=seed, maxIter=0)`` would."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark import RDD

from tillsight.ml.silhouette import squares

STEPS = 2                       # MLlib's initSteps
GAP_EPSILON, GAP_MOST = 5e-11, 0.4  # Spark's sampler: least uniform, largest fraction that is drawn by gaps
MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1


def _signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return _signed(self.state >> (48 - n), 32)

    def integer(self) -> int:
        return self.bits(32)

    def long(self) -> int:
        high = self.bits(32) << 32
        return _signed(high + self.bits(32), 64)

    def below(self, bound: int) -> int:
        value = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * value) >> 31
        while value - value % bound + bound - 1 >= 1 << 31:
            value = self.bits(31)
        return value % bound

    def double(self) -> float:
        high = self.bits(26) << 27
        return (high + self.bits(27)) * 2.0 ** -53


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words."""
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & MASK32
        h ^= (k << 15 | k >> 17) * 0x1B873593 & MASK32
        h = ((h << 13 | h >> 19) & MASK32) * 5 + 0xE6546B64 & MASK32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & MASK32
    h = (h ^ h >> 13) * 0xC2B2AE35 & MASK32
    return h ^ h >> 16


def hashed_seed(seed: int) -> int:
    """First state of Spark's ``XORShiftRandom(seed)``."""
    data = (seed & MASK64).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _next(state):
    """The state after ``state``: an int, or an array of uint64."""
    if isinstance(state, int):
        state ^= state << 21 & MASK64
        state ^= state >> 35
        return state ^ (state << 4 & MASK64)
    state = state ^ (state << np.uint64(21))
    state ^= state >> np.uint64(35)
    return state ^ (state << np.uint64(4))


def _apply(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = tables[0][states & np.uint64(255)]
    for i in range(1, 8):
        out ^= tables[i][(states >> np.uint64(8 * i)) & np.uint64(255)]
    return out


@lru_cache(maxsize=64)
def _jump(power: int) -> np.ndarray:
    """2^power states on at once: a step is linear in the bits, so the tables
    give what each byte of a state becomes."""
    units = np.uint64(1) << np.arange(64, dtype=np.uint64)
    columns = _next(units) if power == 0 else _apply(_jump(power - 1), _apply(_jump(power - 1), units))
    tables = np.zeros((8, 256), dtype=np.uint64)
    for i in range(8):
        for bit in range(8):
            tables[i][np.arange(256) >> bit & 1 == 1] ^= columns[8 * i + bit]
    return tables


def uniforms(seed: int, first: int, count: int) -> np.ndarray:
    """``XORShiftRandom(seed).nextDouble()``: ``count`` from the ``first``."""
    state, skip = np.array([hashed_seed(seed)], dtype=np.uint64), 2 * first
    for power in range(skip.bit_length()):
        if skip >> power & 1:
            state = _apply(_jump(power), state)
    states, power = _next(state), 0
    while len(states) < 2 * count:
        states, power = np.concatenate([states, _apply(_jump(power), states)]), power + 1
    high, low = states[0:2 * count:2] & np.uint64((1 << 26) - 1), states[1:2 * count:2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(float) * 2.0 ** -53


class _Doubles:
    """The doubles of one stream, one after the other."""

    def __init__(self, seed: int):
        self.state = hashed_seed(seed)

    def double(self) -> float:
        self.state = _next(self.state)
        high = self.state & ((1 << 26) - 1)
        self.state = _next(self.state)
        return ((high << 27) + (self.state & ((1 << 27) - 1))) * 2.0 ** -53


def _sample(sizes: Sequence[int], fraction: float, seed: int) -> list[tuple[int, int]]:
    """(partition, place) of what ``RDD.sample(False, fraction, seed)`` keeps."""
    random, out = JavaRandom(seed), []
    for part, size in enumerate(sizes):
        stream, place = _Doubles(random.long()), -1
        if fraction >= 1:
            out += [(part, i) for i in range(size)]
        elif fraction > GAP_MOST:
            out += [(part, i) for i in range(size) if stream.double() <= fraction]
        else:
            while True:
                place += 1 + int(math.log(max(stream.double(), GAP_EPSILON)) / math.log1p(-fraction))
                if place >= size:
                    break
                out.append((part, place))
    return out


def first_place(sizes: Sequence[int], seed: int) -> tuple[int, int]:
    """(partition, place) of ``RDD.takeSample(False, 1, seed)``."""
    random, total = JavaRandom(seed), sum(sizes)
    if total <= 1:
        found = [(part, 0) for part, size in enumerate(sizes) if size]
    else:
        gamma = -math.log(1e-4) / total
        fraction = min(1.0, max(1e-10, 1 / total + gamma + math.sqrt(gamma * gamma + 2 * gamma / total)))
        found = _sample(sizes, fraction, random.integer())
        while not found:
            found = _sample(sizes, fraction, random.integer())
    for i in range(len(found) - 1, 0, -1):
        j = random.below(i + 1)
        found[i], found[j] = found[j], found[i]
    return found[0]


def least_squares(points: np.ndarray, centres: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of each point to its nearest centre, or ``least``."""
    least = np.full(points.shape[1], np.inf) if least is None else least.copy()
    for centre in centres:
        np.minimum(least, squares(points, centre), out=least)
    return least


def reduced(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """MLlib's local k-means++ of weighted points (rows), from seed 0."""
    random = JavaRandom(0)

    def until(shares, share):  # points whose shares, summed in turn, first reach the share
        total, i = 0.0, 0
        while i < len(shares) and total < share:
            total, i = total + shares[i], i + 1
        return i

    def total(shares):
        out = 0.0
        for x in shares:
            out += x
        return out

    centres = [points[until(weights, random.double() * total(weights)) - 1]]
    costs = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        shares = weights * costs
        centres.append(points[max(until(shares, random.double() * total(shares)) - 1, 0)])
        costs = np.minimum(costs, ((points - centres[-1]) ** 2).sum(1))
    centres, closest = np.array(centres), None
    for _ in range(rounds):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for j in range(k):
            mine = own == j
            centres[j] = (points[mine] * weights[mine, None]).sum(0) / weights[mine].sum() if weights[mine].sum() else points[random.below(len(points))]
        if closest is not None and (own == closest).all():
            break
        closest = own
    return centres


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def starts(blocks: RDD, parts: int, jobs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Centres (rows) for each job (k, seed). ``blocks`` has (partition, place of
    the first point, points with a row a column), of a table of so many ``parts``."""
    spark, jobs = blocks.context, list(jobs)
    sizes = [0] * parts
    for part, n in blocks.map(lambda b: (b[0], b[2].shape[1])).reduceByKey(lambda a, b: a + b).collect():  # a row a partition
        sizes[part] = n
    if not sum(sizes):
        raise ValueError("no points to cluster")
    depth = 1 if blocks.getNumPartitions() <= 64 else 2
    seeds = sorted({seed for _, seed in jobs})
    streams = {seed: _signed(_next(hashed_seed(seed)), 32) for seed in seeds}
    places = {seed: first_place(sizes, streams[seed]) for seed in seeds}

    def first(found: Iterator) -> Iterator:
        for part, at, points in found:
            for seed, (own, place) in places.items():
                if own == part and at <= place < at + points.shape[1]:
                    yield seed, points[:, place - at].copy()

    first_points = dict(blocks.mapPartitions(first).collect())  # a point a seed
    chosen = [[first_points[seed][None]] for _, seed in jobs]

    def costs(shared, points):
        """Each job's squared distances; jobs of a seed share the first point."""
        of = {seed: squares(points, point) for seed, point in first_points.items()}
        for i, (_, seed) in enumerate(jobs):
            yield i, least_squares(points, shared.value[i], of[seed]) if len(shared.value[i]) else of[seed]

    for step in range(STEPS):
        shared = spark.broadcast([np.concatenate(c[1:]) if len(c) > 1 else np.empty((0, len(c[0][0]))) for c in chosen])

        def summed(found: Iterator) -> Iterator:
            total = [0.0] * len(jobs)
            for _, _, points in found:
                for i, cost in costs(shared, points):
                    total[i] += float(cost.sum())
            yield total

        sums = blocks.mapPartitions(summed).treeReduce(_added, depth)

        def drawn(found: Iterator) -> Iterator:
            for part, at, points in found:
                random = {seed: uniforms(stream ^ step << 16 ^ part, at, points.shape[1]) for seed, stream in streams.items()}
                for i, cost in costs(shared, points):
                    if sums[i] > 0:
                        took = np.flatnonzero(random[jobs[i][1]] < 2.0 * cost * jobs[i][0] / sums[i])
                        if len(took):
                            yield i, part, at, points[:, took].T

        for i, _, _, points in sorted(blocks.mapPartitions(drawn).collect(), key=lambda r: r[:3]):  # about 2k points a job
            chosen[i].append(points)
        shared.unpersist()

    chosen = [np.array(list(dict.fromkeys(map(tuple, np.concatenate(c))))) for c in chosen]
    shared = spark.broadcast(chosen)

    def counted(found: Iterator) -> Iterator:
        counts = [np.zeros(len(c)) for c in shared.value]
        for _, _, points in found:
            for i, candidates in enumerate(shared.value):
                if len(candidates) > jobs[i][0]:
                    away = np.array([squares(points, c) for c in candidates])
                    hot = np.count_nonzero(away == away.min(0), axis=1)
                    counts[i] += hot if hot.sum() == points.shape[1] else np.bincount(away.argmin(0), minlength=len(candidates))
        yield counts

    counts = blocks.mapPartitions(counted).treeReduce(_added, depth)
    shared.unpersist()
    return [c if len(c) <= k else reduced(c, n, k) for (k, _), c, n in zip(jobs, chosen, counts)]
