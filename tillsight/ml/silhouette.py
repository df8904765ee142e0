"""Mean Euclidean silhouette of clustered points, without pairs of points.

The sum of distances from a point x to a cell of n points with mean m and
variance v (summed over the columns) lies between ``n * |x - m|`` and
``n * sqrt(|x - m|^2 + v)`` (Jensen, both ways). Spark groups the points into
grid cells of their cluster; the cells form a tree by halving their
resolution, and a task walks it for a few neighbouring points at a time,
opening the cells whose two bounds lie apart. What comes out is an interval of
the mean silhouette. The grid is refined until it is narrow enough.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.ml.parallel import fit_all
from tillsight.session import materialize

TOLERANCE = 1e-3            # half width of the interval that ends the refinement
FIRST_CELLS = 50_000        # cells of the first grid
MOST_CELLS = 2_000_000      # cells of the finest grid (about 100 MB broadcast)
LEVELS = range(-6, 21)      # cell sides 2^6 to 2^-20
POINTS = 64                 # neighbouring points that walk the tree together
NODES = 1024                # nodes measured at a time: their distances stay in a core's cache
TOGETHER = 128              # the same for all clusterings at once
CHUNK = 1 << 18             # points that a task sorts by place at a time
SMALL = 1 / 256             # share of ``gap`` that a node may add to a cluster's mean distance, however wide its own bounds


def _keys(cols: Sequence[str], level: int):
    return [F.floor(F.col(c) * F.lit(2.0 ** level)).cast("long") for c in cols]


def cell_count(df: DataFrame, cols: Sequence[str], level: int, cluster: str = "cluster") -> int:
    """Approximate number of occupied cells of a level, from one pass."""
    return df.agg(F.approx_count_distinct(F.xxhash64(F.col(cluster), *_keys(cols, level)), 0.02)).first()[0]


def finest_level(df: DataFrame, cols: Sequence[str], most: int, counts: dict[int, int], cluster: str = "cluster") -> int:
    """The finest level with at most ``most`` occupied cells, else the coarsest,
    by halving: finer cells are never fewer. ``counts`` keeps what was counted."""
    low, high = LEVELS[0], LEVELS[-1]
    while low < high:
        mid = (low + high + 1) // 2
        if mid not in counts:
            counts[mid] = cell_count(df, cols, mid, cluster)
        low, high = (mid, high) if counts[mid] <= most else (low, mid - 1)
    return low


def cells(df: DataFrame, cols: Sequence[str], level: int, cluster: str = "cluster", products: bool = False) -> DataFrame:
    """One row per occupied cell: cluster, key of each column, points, sums of
    the offsets from the cell's corner and of their squares, or of the products
    of any two as well."""
    side = 2.0 ** -level
    keyed = df.select(F.col(cluster).alias("_c"), *cols, *[k.alias(f"_k{i}") for i, k in enumerate(_keys(cols, level))])
    off = [F.col(c) - F.col(f"_k{i}") * F.lit(side) for i, c in enumerate(cols)]
    square = off[0] * off[0]
    for o in off[1:]:
        square = square + o * o
    both = [F.sum(off[i] * off[j]).alias(f"_p{i}{j}") for i, j in zip(*np.triu_indices(len(cols)))] if products else []
    return keyed.groupBy("_c", *[f"_k{i}" for i in range(len(cols))]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(o).alias(f"_s{i}") for i, o in enumerate(off)], F.sum(square).alias("_q"), *both)


def build_tree(table: pd.DataFrame, dims: int, side: float) -> list[dict]:
    """Levels from the coarsest to the cells, each with the arrays ``c, n,
    mean, var`` of its nodes; node i of a level above the cells has the nodes
    ``kids[start[i]:start[i + 1]]`` of the next one."""
    key = table[[f"_k{i}" for i in range(dims)]].to_numpy(np.int64)
    n = table["_n"].to_numpy(float)
    off = table[[f"_s{i}" for i in range(dims)]].to_numpy(float) / n[:, None]
    var = np.where(n > 1, np.maximum(table["_q"].to_numpy(float) / n - (off * off).sum(1), 0.0), 0.0)
    tree = [{"c": table["_c"].to_numpy(np.int64), "n": n, "mean": key * side + off, "var": var}]
    while (key >> 1 != key).any():
        low = tree[-1]
        up, parent = np.unique(np.column_stack([low["c"], key >> 1]), axis=0, return_inverse=True)
        parent = parent.ravel()
        kids = np.argsort(parent, kind="stable")
        start = np.searchsorted(parent[kids], np.arange(len(up) + 1))
        total = np.add.reduceat(low["n"][kids], start[:-1])
        mean = np.add.reduceat((low["mean"] * low["n"][:, None])[kids], start[:-1]) / total[:, None]
        away = ((low["mean"] - mean[parent]) ** 2).sum(1) + low["var"]
        var = np.add.reduceat((away * low["n"])[kids], start[:-1]) / total
        key = up[:, 1:]
        tree.append({"c": up[:, 0], "n": total, "mean": mean, "var": var, "kids": kids, "start": start})
    return tree[::-1]


def squares(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None, work: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, summed column by column (the first axis of both)."""
    total = np.subtract(a[0], b[0], out=out)
    np.multiply(total, total, out=total)
    for x, y in zip(a[1:], b[1:]):
        off = np.subtract(x, y, out=work)
        total += np.multiply(off, off, out=off)
    return total


def open_nodes(tree: list[dict], centre: np.ndarray, radius: float, gap: float):
    """(c, n, mean, var) of nodes that cover all points and whose two bounds
    lie at most ``gap`` apart (of cells: whatever they do) for every place
    within ``radius`` of ``centre``."""
    taken = []
    at = np.arange(len(tree[0]["c"]))
    for depth, level in enumerate(tree):
        mean, var = level["mean"][at], level["var"][at]
        near = np.maximum(np.sqrt(squares(mean.T, centre)) - radius, 0.0)
        close = np.sqrt(near * near + var) - near <= gap if depth + 1 < len(tree) else np.ones(len(at), bool)
        taken.append([level[k][at[close]] for k in ("c", "n", "mean", "var")])
        far = at[~close]
        if not len(far):
            break
        first, many = level["start"][far], np.diff(level["start"])[far]
        ends = np.cumsum(many)
        at = level["kids"][np.repeat(first - ends + many, many) + np.arange(ends[-1])]
    return [np.concatenate(part) for part in zip(*taken)]


def distance_sums(tree: list[dict], points: np.ndarray, n_clusters: int, gap: float):
    """Bounds of the sum of distances from each point to each cluster 0..n-1."""
    centre = (points.min(0) + points.max(0)) / 2
    radius = float(np.sqrt(((points - centre) ** 2).sum(1).max()))
    c, n, mean, var = open_nodes(tree, centre, radius, gap)
    low, high = np.zeros((len(points), n_clusters)), np.zeros((len(points), n_clusters))
    mine, mean = points.T[:, :, None], np.ascontiguousarray(mean.T)
    space = np.empty((3, len(points), NODES))
    for i in range(0, len(c), NODES):
        part = slice(i, i + NODES)
        square, off, root = space[:, :, :len(c[part])]
        squares(mine, mean[:, part], square, off)
        weight = np.zeros((len(c[part]), n_clusters))
        weight[np.arange(len(weight)), c[part]] = n[part]
        low += np.sqrt(square, out=root) @ weight
        square += var[part]
        high += np.sqrt(square, out=root) @ weight
    return low, high


def point_bounds(own: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray):
    """Bounds of each point's silhouette (b - a) / max(a, b): it falls with the
    mean distance a to the others of its cluster and rises with the smallest
    mean distance b to another cluster. 0 where it is alone in its cluster."""
    rows = np.arange(len(own))
    mates = np.maximum(sizes[own] - 1, 1)
    a = [s[rows, own] / mates for s in (low, high)]
    b = []
    for s in (low, high):
        other = s / sizes
        other[rows, own] = np.inf
        b.append(other.min(1))

    def value(a, b):
        top = np.maximum(a, b)
        return np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)

    return value(a[1], b[0]), value(a[0], b[1])


def by_neighbour(points: np.ndarray) -> np.ndarray:
    """Places of the points in an order in which neighbours come together: that
    of the bits of their columns in turn."""
    spread = np.ptp(points, axis=0)
    grid = np.floor((points - points.min(0)) / np.where(spread > 0, spread, 1.0) * 1023.99).astype(np.int64)
    place = np.zeros(len(points), np.int64)
    for bit in range(9, -1, -1):
        for j in range(points.shape[1]):
            place = (place << 1) | ((grid[:, j] >> bit) & 1)
    return np.argsort(place, kind="stable")


def silhouette_interval(df: DataFrame, cols: Sequence[str], level: int, gap: float,
                        cluster: str = "cluster") -> tuple[float, float]:
    """Lower and upper bound of the mean silhouette from the grid of ``level``;
    nodes whose bounds are more than ``gap`` apart are opened down to its cells."""
    cols, spark = list(cols), df.sparkSession
    table = cells(df, cols, level, cluster).toPandas()  # as many rows as cells: at most MOST_CELLS by silhouette()
    ids, table["_c"] = np.unique(table["_c"], return_inverse=True)
    sizes = table.groupby("_c")["_n"].sum().sort_index().to_numpy(float)
    shared = spark.sparkContext.broadcast((build_tree(table, len(cols), 2.0 ** -level), ids, sizes))

    def judge(batches):
        tree, ids, sizes = shared.value
        for pdf in batches:
            own, points = np.searchsorted(ids, pdf["_c"].to_numpy()), pdf[cols].to_numpy(float)
            order = by_neighbour(points)
            total = np.zeros(2)
            for i in range(0, len(order), POINTS):
                at = order[i:i + POINTS]
                low, high = distance_sums(tree, points[at], len(ids), gap)
                total += [v.sum() for v in point_bounds(own[at], low, high, sizes)]
            yield pd.DataFrame({"low": [total[0]], "high": [total[1]], "n": [len(points)]})

    row = (df.select(F.col(cluster).alias("_c"), *cols).mapInPandas(judge, "low double, high double, n long")
           .agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n")).first())
    shared.unpersist()
    return row["low"] / row["n"], row["high"] / row["n"]


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str = "cluster",
               tolerance: float = TOLERANCE) -> tuple[float, float]:
    """Mean Euclidean silhouette of the rows and the half width of the interval
    that it was found in: the value is the interval's middle. ``cols`` are
    doubles, at most six; ``cluster`` is an integer. Rows with a null take no part.

    The first grid has at most FIRST_CELLS occupied cells; it is refined, and
    ``gap`` with it, until the half width is at most ``tolerance`` or the next
    grid would have more than MOST_CELLS (the half width then says so). Points
    that are alone in their cells, copies included, give the exact value. Fewer
    than two clusters: (nan, nan)."""
    df = df.select(cluster, *cols).dropna()
    if len(df.select(cluster).distinct().limit(2).collect()) < 2:
        return float("nan"), float("nan")
    counts, most, gap = {}, FIRST_CELLS, tolerance
    while True:
        level = finest_level(df, cols, most, counts, cluster)
        low, high = silhouette_interval(df, cols, level, gap, cluster)
        if (high - low) / 2 <= tolerance or most >= MOST_CELLS and gap <= tolerance / 64:
            return (low + high) / 2, (high - low) / 2
        most, gap = min(most * 8, MOST_CELLS), gap / 8


# ---------------------------------------------------------------------------
# Several clusterings of the same points in one walk
# ---------------------------------------------------------------------------
#
# Points with the same clusters in all clusterings are a class. One tree holds
# the cells of the classes; the sum of distances to a cluster is that to its
# classes. A node knows the covariance C of its points, v = tr C and the distance
# w of the farthest one from their mean m. With R = x - m, r = |R|, u = R / r and a
# point m + s of it, |R - s| is the sum of r q^n (P[n-2](c) - P[n](c)) / (2n - 1)
# for q = |s| / r: Taylor to the second term gives the mean distance
# r + (v - u'Cu) / 2r within third(w / r) w v / r^2 (0.1925 q^3 is the most of the
# third term, 2/7 q^n of each after it). From the middle of some neighbouring
# points, with places t about it, the same terms of |R + t - s| are a polynomial
# of t for all of them, within third((|t| + w) / r) (|t| + w) (|t|^2 + v) / r^2.


def third(q: np.ndarray) -> np.ndarray:
    return 0.19246 + 2 / 7 * q / (1 - q)


def build_moments(table: pd.DataFrame, dims: int, side: float, sizes: np.ndarray) -> list[dict]:
    """As ``build_tree``, with ``cov`` (products i <= j), ``wide`` (farthest
    point) and ``share`` (of the smallest cluster that the node's class is in,
    ``sizes`` by class) too."""
    key = table[[f"_k{i}" for i in range(dims)]].to_numpy(np.int64)
    first, second = np.triu_indices(dims)
    square = first == second
    n = table["_n"].to_numpy(float)
    off = table[[f"_s{i}" for i in range(dims)]].to_numpy(float) / n[:, None]
    cov = table[[f"_p{i}{j}" for i, j in zip(first, second)]].to_numpy(float) / n[:, None] - off[:, first] * off[:, second]
    cov = np.where((n > 1)[:, None], cov, 0.0)
    c, mean = table["_c"].to_numpy(np.int64), key * side + off

    def node(**also):
        cov[:, square] = np.maximum(cov[:, square], 0.0)
        var = cov[:, square].sum(1)
        far = np.sqrt((np.maximum(mean - key * side, (key + 1) * side - mean) ** 2).sum(1))
        return {"c": c, "n": n, "mean": mean, "cov": cov, "var": var, "wide": np.minimum(far, np.sqrt(n * var)), "share": n / sizes[c], **also}

    tree = [node()]
    while (key >> 1 != key).any():
        up, parent = np.unique(np.column_stack([c, key >> 1]), axis=0, return_inverse=True)
        parent = parent.ravel()
        kids = np.argsort(parent, kind="stable")
        start = np.searchsorted(parent[kids], np.arange(len(up) + 1))

        def total(values):
            return np.add.reduceat((values * n[:, None])[kids], start[:-1]) / above[:, None]

        above = np.add.reduceat(n[kids], start[:-1])
        middle = total(mean)
        away = mean - middle[parent]
        cov = total(cov + away[:, first] * away[:, second])
        c, key, n, mean, side = up[:, 0], up[:, 1:], above, middle, side * 2
        tree.append(node(kids=kids, start=start))
    return tree[::-1]


def opened(tree: list[dict], centre: np.ndarray, radius: float, gap: float) -> list[dict]:
    """Nodes that cover all points, for places within ``radius`` of ``centre``:
    those that a polynomial stands for, those to be measured with their
    covariance, and those with their variance alone."""
    taken: list[list] = [[], [], []]
    at = np.arange(len(tree[0]["c"]))
    for depth, level in enumerate(tree):
        mean, var, wide = level["mean"][at], level["var"][at], level["wide"][at]
        apart = np.sqrt(squares(mean.T, centre))
        away = np.maximum(apart - radius, 0.0)
        most = np.maximum(gap, gap * SMALL / level["share"][at])

        def error(t, r, reach):
            q = np.where(r > 2 * reach, reach / np.where(r > 0, r, 1.0), 0.5)
            return np.where(q < 0.5, third(q) * (t + wide) * (t * t + var) / np.where(r > 0, r, 1.0) ** 2, np.inf)

        by_form = error(0.6 * radius, apart, radius + wide) <= most
        by_cov = ~by_form & (level["n"][at] > 1) & (error(0.0, away, wide) <= most)
        by_var = ~by_form & ~by_cov & ((np.sqrt(away * away + var) - away <= 2 * most) if depth + 1 < len(tree) else True)
        for some, chosen in zip(taken, (by_form, by_cov, by_var)):
            some.append({k: level[k][at[chosen]] for k in ("c", "n", "mean", "cov", "var", "wide")})
        rest = at[~(by_form | by_cov | by_var)]
        if not len(rest):
            break
        first, many = level["start"][rest], np.diff(level["start"])[rest]
        ends = np.cumsum(many)
        at = level["kids"][np.repeat(first - ends + many, many) + np.arange(ends[-1])]
    return [{k: np.concatenate([x[k] for x in some]) for k in some[0]} for some in taken]


def class_sums(tree: list[dict], points: np.ndarray, member: np.ndarray, gap: float):
    """Bounds of the sum of distances from each point to each cluster, of which
    ``member`` (class, cluster) says what classes they have."""
    centre = (points.min(0) + points.max(0)) / 2
    points = points - centre
    far = np.sqrt((points ** 2).sum(1))
    radius, dims = float(far.max()), points.shape[1]
    form, cov, var = opened(tree, centre, radius, gap)
    first, second = np.triu_indices(dims)
    square, twice = (first == second).astype(float), np.where(first == second, 1.0, 2.0)
    full = np.zeros((dims, dims), np.int64)
    full[first, second] = full[second, first] = np.arange(len(first))
    products, ones = points[:, first] * points[:, second], np.ones((len(points), 1))

    r = centre - form["mean"]
    away = np.sqrt((r ** 2).sum(1))
    u = r / away[:, None]
    uu = u[:, first] * u[:, second]
    rest = third((radius + form["wide"]) / away) / away ** 2
    terms = np.column_stack([away + (form["var"] - (form["cov"] * uu * twice).sum(1)) / (2 * away), u, (square - uu) * twice / (2 * away)[:, None],
                             rest, rest * form["wide"], rest * form["var"], rest * form["wide"] * form["var"]])
    sums = (terms * form["n"][:, None]).T @ member[form["c"]]
    middle = np.concatenate([ones, points, products], axis=1) @ sums[:-4]
    width = np.column_stack([far ** 3, far ** 2, far, ones]) @ sums[-4:]

    mine, space = np.ascontiguousarray(points.T)[:, :, None], np.empty((2, len(points), NODES // 4))
    near = np.maximum(np.sqrt(((cov["mean"] - centre) ** 2).sum(1)) - radius, 0.0)
    width += (third(cov["wide"] / near) * cov["wide"] * cov["var"] / near ** 2 * cov["n"]) @ member[cov["c"]]
    mean = cov["mean"] - centre
    tilt = np.einsum("nij,nj->ni", cov["cov"][:, full], mean)  # (x - m)'C(x - m) by the products of x
    parts = np.concatenate([cov["cov"] * twice, -2 * tilt, (tilt * mean).sum(1)[:, None]], axis=1)
    forms, mean = np.concatenate([products, points, ones], axis=1), np.ascontiguousarray(mean.T)
    for i in range(0, len(near), NODES // 4):
        part = slice(i, i + NODES // 4)
        square, off = space[:, :, :len(near[part])]
        squares(mine, mean[:, part], square, off)
        across = forms @ parts[part].T
        across /= square
        np.subtract(cov["var"][part], across, out=across)
        np.sqrt(square, out=square)
        across /= square
        across *= 0.5
        square += across
        middle += square @ (member[cov["c"][part]] * cov["n"][part, None])
    low, high = middle - width, middle + width
    mean = np.ascontiguousarray((var["mean"] - centre).T)
    for i in range(0, len(var["c"]), NODES // 4):
        part = slice(i, i + NODES // 4)
        square, off = space[:, :, :len(var["c"][part])]
        weight = member[var["c"][part]] * var["n"][part, None]
        squares(mine, mean[:, part], square, off)
        low += np.sqrt(square, out=off) @ weight
        square += var["var"][part]
        high += np.sqrt(square, out=square) @ weight
    return np.maximum(low, 0.0), high


def _by_place(df: DataFrame, cols: Sequence[str], ends: Sequence[tuple[float, float]], rows: int) -> DataFrame:
    """Rows dealt out so that a task has neighbouring ones: in the order of the
    bits of their columns in turn, copies at random."""
    place = F.lit(0).cast("long")
    for j, (c, (low, high)) in enumerate(zip(cols, ends)):
        grid = F.floor((F.col(c) - F.lit(low)) * F.lit(1023.99 / ((high - low) or 1.0))).cast("long")
        for bit in range(10):
            place = place + F.shiftleft(F.shiftright(grid, bit).bitwiseAND(F.lit(1)), bit * len(cols) + j)
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // CHUNK))
    return df.withColumn("_place", place).repartitionByRange(parts, "_place", F.rand(1)).drop("_place")


def class_intervals(df: DataFrame, cols: Sequence[str], level: int, gap: float, widths: Sequence[int]) -> list[tuple[float, float]]:
    """Lower and upper bound of the mean silhouette of each clustering. ``_c``
    of ``df`` is the class: the clusters, of so many ``widths``, as the digits of a number."""
    cols, spark = list(cols), df.sparkSession
    table = cells(df, cols, level, "_c", products=True).toPandas()  # as many rows as cells: at most MOST_CELLS by silhouettes()
    codes, table["_c"] = np.unique(table["_c"], return_inverse=True)
    many = table.groupby("_c")["_n"].sum().sort_index().to_numpy(float)
    own, member, sizes, rest = [], [], [], codes
    for width in widths:  # for each clustering: the place of a class's cluster, of those that have points
        ids, place = np.unique(rest % width, return_inverse=True)
        own.append(place)
        member.append(np.eye(len(ids))[place])
        sizes.append(np.bincount(place, many))
        rest = rest // width
    least = np.min([s[o] for s, o in zip(sizes, own)], axis=0)
    ends = np.cumsum([0, *(len(s) for s in sizes)])
    shared = spark.sparkContext.broadcast((build_moments(table, len(cols), 2.0 ** -level, least), codes, own, np.concatenate(member, axis=1), sizes))

    def chunks(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= CHUNK:
                yield pd.concat(held)
                held, n = [], 0
        if n:
            yield pd.concat(held)

    def judge(batches):
        tree, codes, own, member, sizes = shared.value
        total, n = np.zeros((2, len(sizes))), 0
        for pdf in chunks(batches):
            classes, points = np.searchsorted(codes, pdf["_c"].to_numpy()), pdf[cols].to_numpy(float)
            order = by_neighbour(points)
            n += len(points)
            for i in range(0, len(order), TOGETHER):
                at = order[i:i + TOGETHER]
                low, high = class_sums(tree, points[at], member, gap)
                for j, size in enumerate(sizes):
                    if len(size) < 2:
                        continue
                    part = slice(ends[j], ends[j + 1])
                    total[:, j] += [v.sum() for v in point_bounds(own[j][classes[at]], low[:, part], high[:, part], size)]
        yield pd.DataFrame({"clustering": range(len(sizes)), "low": total[0], "high": total[1], "n": n})

    rows = (df.select("_c", *cols).mapInPandas(judge, "clustering int, low double, high double, n long")
            .groupBy("clustering").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n")).collect())  # a row a clustering
    shared.unpersist()
    return [(r["low"] / r["n"], r["high"] / r["n"]) for r in sorted(rows, key=lambda r: r["clustering"])]


def silhouettes(df: DataFrame, cols: Sequence[str], clusters: Sequence[str], tolerance: float = TOLERANCE) -> list[tuple[float, float]]:
    """``silhouette`` of several clusterings of the same rows, each a column of
    integers. Up to FIRST_CELLS rows they are taken one by one; a larger table
    is put in the order of place and walked once for all of them."""
    df, clusters = df.select(*clusters, *cols).dropna(), list(clusters)
    ends = df.agg(F.count(F.lit(1)), *(f(c) for c in (*clusters, *cols) for f in (F.min, F.max))).first()
    rows, ends = ends[0], list(zip(ends[1::2], ends[2::2]))
    if rows <= FIRST_CELLS:
        return fit_all(lambda c: silhouette(df, cols, c, tolerance), clusters)
    out: list[tuple[float, float]] = []
    while len(out) < len(clusters):
        code, widths, classes = F.lit(0).cast("long"), [], 1
        for c, (low, high) in list(zip(clusters, ends))[len(out):]:  # as many as their classes have numbers for
            if widths and classes * (high - low + 1) >= 1 << 62:
                break
            code = code + (F.col(c) - F.lit(low)).cast("long") * F.lit(classes).cast("long")
            widths.append(high - low + 1)
            classes *= widths[-1]
        placed = materialize(_by_place(df.select(code.alias("_c"), *cols), cols, ends[len(clusters):], rows))
        counts, most, gap, found = {}, min(2 * FIRST_CELLS, MOST_CELLS), tolerance / 16, {}
        while len(found) < len(widths):
            level = finest_level(placed, cols, most, counts, "_c")
            for i, (low, high) in enumerate(class_intervals(placed, cols, level, gap, widths)):
                if i not in found and ((high - low) / 2 <= tolerance or most >= MOST_CELLS and gap <= tolerance / 64):
                    found[i] = ((low + high) / 2, (high - low) / 2) if widths[i] > 1 else (float("nan"), float("nan"))
            most, gap = min(most * 8, MOST_CELLS), gap / 8
        out += [found[i] for i in range(len(widths))]
    return out
