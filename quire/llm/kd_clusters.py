"""Centroid clustering by the filtering algorithm over kd-trees.

Vectors become integers (``floor(scale * x)``), so sums, means and distances are exact and no result
depends on the order of rows, on partitions or on lost executors. Each task cuts its rows into blocks
and builds a kd-tree over each: its nodes hold counts, integer sums, sums of squares and bounding boxes.
The trees are written once below the shared folder. A round sends the centroids (``k`` x dimensions, the
only thing that is sent) down all trees: at a node, the candidate nearest to the middle of the box rules
out every candidate that is strictly farther from all of the box; a node with one candidate left is
assigned whole, from its sums, and the points of leaves that keep several are compared exactly, ties to
the smaller number. Tasks give k rows each, which are added in two steps; the driver sees k rows a round.

Kept are vectors of exactly ``dims`` components without null or non-finite ones; all others have no row in
the result. An empty table, or one without kept vectors, gives an empty result; fewer kept vectors than
``k`` are as many centroids. Rows with equal ids, and null ids, are vectors of their own (for the choice of
the first centroids, null ids come last and equal ids go by their components). Extra columns, whatever their
names, are left out. Vectors with integer components beyond 2^16 are handled in unbounded integers, exactly
but slowly; a distance or sum that no 64-bit integer holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.shared import written

#: Integers up to EXACT, in blocks of up to CELLS of them, have sums of squares and products below 2^53: float64 arithmetic is exact.
EXACT, CELLS = 1 << 16, 1 << 20
BLOCK, LEAF = 4096, 16
LIMB = 10**28


@dataclass
class Tree:
    """A balanced tree: at depth d the points are cut into 2^d ranges, and node i there is the range i. Nodes lie level by level."""

    points: np.ndarray  # in the order of the leaves; float64 (whole numbers), or Python's integers
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @property
    def depth(self) -> int:
        return depth_of(len(self.points))


def depth_of(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def bounds(n: int, level: int) -> np.ndarray:
    """Borders of the 2^level ranges."""
    return (np.arange((1 << level) + 1) * n) >> level


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of these vectors and their order in it: each range is halved at the median of its widest dimension."""
    n, order = len(points), np.arange(len(points))
    depth = depth_of(n)
    for level in range(depth):
        cut, finer = bounds(n, level), bounds(n, level + 1)
        for i in range(1 << level):
            own = order[cut[i] : cut[i + 1]]
            part = points[own]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            values = part[:, axis]
            middle = int(finer[2 * i + 1] - cut[i])
            order[cut[i] : cut[i + 1]] = own[np.argsort(values, kind="stable") if values.dtype == object else np.argpartition(values, middle)]
    points = points[order]
    square = (points * points).sum(1)
    levels = [bounds(n, level)[:-1] for level in range(depth + 1)]
    of = lambda f, x: np.concatenate([f.reduceat(x, at) for at in levels])
    return Tree(points, of(np.minimum, points), of(np.maximum, points), of(np.add, points), of(np.add, square)), order


def descend(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes assigned whole and their clusters; the other points and their clusters."""
    n, k = len(tree.points), len(centroids)
    difference = centroids[None] - centroids[:, None]  # [nearest, other]
    up, down = np.maximum(difference, 0), np.minimum(difference, 0)
    rise = (difference * (centroids[None] + centroids[:, None])).sum(2)
    norm = (centroids * centroids).sum(1)
    live, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    nodes, owners = [], []
    for level in range(tree.depth + 1):
        base = (1 << level) - 1
        low, high = tree.low[base + live], tree.high[base + live]
        middle = norm - (low + high) @ centroids.T  # a quarter of the distance to the box's middle, less what all share
        nearest = np.argmin(np.where(open_, middle, middle.max(1, keepdims=True) + 1), 1)
        for z in np.unique(nearest):
            own = nearest == z
            # the other's distance less the nearest's, at the corner of the box that favours the other most
            least = rise[z] - 2 * (high[own] @ up[z].T + low[own] @ down[z].T)
            open_[own] &= ~(least > 0)
        single = open_.sum(1) == 1
        nodes.append(base + live[single])
        owners.append(np.argmax(open_[single], 1))
        live, open_ = live[~single], open_[~single]
        if level < tree.depth:
            live, open_ = np.concatenate([2 * live, 2 * live + 1]), np.concatenate([open_, open_])
    cut = bounds(n, tree.depth)
    size = cut[live + 1] - cut[live]
    points = np.repeat(cut[live] - np.cumsum(size) + size, size) + np.arange(size.sum())
    distance = norm - 2 * (tree.points[points] @ centroids.T)
    choice = np.argmin(np.where(np.repeat(open_, size, 0), distance, distance.max(1, keepdims=True) + 1), 1)
    return np.concatenate(nodes), np.concatenate(owners), points, choice


def node_ranges(n: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    level = np.floor(np.log2(nodes + 1)).astype(np.int64)
    place = nodes + 1 - (1 << level)
    return (place * n) >> level, ((place + 1) * n) >> level


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Of each cluster: its vectors, their sum, and the sum of their squared distances, as whole numbers."""
    nodes, owners, points, choice = descend(tree, centroids)
    first, last = node_ranges(len(tree.points), nodes)
    count, sums, inertia = [], [], []
    for c, centroid in enumerate(centroids):
        whole, own = nodes[owners == c], points[choice == c]
        n = int((last - first)[owners == c].sum()) + len(own)
        total = tree.sums[whole].sum(0) + tree.points[own].sum(0)
        square = sum(map(int, tree.squares[whole])) + int((tree.points[own] * tree.points[own]).sum() if len(own) else 0)
        total, exact = [int(x) for x in total], [int(x) for x in centroid]
        count.append(n)
        sums.append(total)
        inertia.append(square - 2 * sum(a * b for a, b in zip(total, exact)) + n * sum(a * a for a in exact))
    return np.array(count), sums, inertia


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every point."""
    nodes, owners, points, choice = descend(tree, centroids)
    first, last = node_ranges(len(tree.points), nodes)
    size = last - first
    cluster = np.empty(len(tree.points), np.int32)
    cluster[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(owners, size)
    cluster[points] = choice
    gap = tree.points - centroids[cluster]
    return cluster, (gap * gap).sum(1)


# ----------------------------------------------------------------- trees as rows

TREE = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), *((c, pa.binary()) for c in ("points", "low", "high", "sums", "squares"))])
TREE_DDL = "ids array<bigint>, width int, points binary, low binary, high binary, sums binary, squares binary"


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole numbers as float64 where that is exact, else as Python's integers."""
    return values if not values.size or np.abs(values).max() <= EXACT else np.frompyfunc(int, 1, 1)(values)


def _packed(points: np.ndarray) -> np.ndarray:
    most = np.abs(points).max() if points.size else 0
    return points.astype(next(t for t, size in ((np.int8, 127), (np.int16, 32767), (np.int32, EXACT)) if most <= size))


def trees(kept: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """One row for each block of up to ``block`` rows of ``kept`` (id, vector: integers as doubles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            points = _integers(table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            tree, order = build(points)
            ids = table.column(0).combine_chunks().take(pa.array(order)).cast(pa.int64())
            row = {"ids": ids.to_pylist(), "width": dims}
            if points.dtype == object:  # rare: rebuilt from its points when it is read
                row |= {"points": tree.points.astype(np.float64).tobytes(), "low": None, "high": None, "sums": None, "squares": None}
            else:
                low, high, pts = _packed(tree.low), _packed(tree.high), _packed(tree.points)
                kind = pts.dtype
                row |= {"points": pts.tobytes(), "low": low.astype(kind).tobytes(), "high": high.astype(kind).tobytes(), "sums": tree.sums.astype(np.int64).tobytes(), "squares": tree.squares.astype(np.int64).tobytes()}
            return pa.RecordBatch.from_pylist([row], TREE)

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, block - sum(b.num_rows for b in waiting))
                waiting.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(b.num_rows for b in waiting) == block:
                    yield made()
        if waiting:
            yield made()

    return kept.mapInArrow(work, TREE_DDL)


def _read(row: dict) -> Tree:
    n, width = len(row["ids"]), row["width"]
    if row["low"] is None:
        return build(_integers(np.frombuffer(row["points"], np.float64).reshape(n, width)))[0]
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(row["points"]) // (n * width)]
    get = lambda c, t: np.frombuffer(row[c], t).astype(np.float64)
    return Tree(*(get(c, t).reshape(-1, width) for c, t in (("points", kind), ("low", kind), ("high", kind), ("sums", np.int64))), get("squares", np.int64))


def _centroids(tree: Tree, centroids: list[list[int]]) -> tuple[Tree, np.ndarray]:
    """Both in one arithmetic."""
    wide = max((abs(x) for c in centroids for x in c), default=0) > EXACT
    if tree.points.dtype == object or wide:
        if tree.points.dtype != object:
            tree = Tree(*(np.frompyfunc(int, 1, 1)(x) for x in (tree.points, tree.low, tree.high, tree.sums, tree.squares)))
        return tree, np.array([[int(x) for x in c] for c in centroids], object)
    return tree, np.array(centroids, np.float64)


def round_totals(forest: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int], int]]:
    """Of each centroid: the vectors nearest to it, their sum and their squared distances summed."""
    k, dims = len(centroids), len(centroids[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, inertia = [0] * k, [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            for row in batch.to_pylist():
                n, s, d = totals(*_centroids(_read(row), centroids))
                for c in range(k):
                    count[c] += int(n[c])
                    sums[c] = [a + b for a, b in zip(sums[c], s[c])]
                    inertia[c] += d[c]
        rows = [{"cluster": c, "limb": j, "parts": limb} for c in range(k) if count[c] for j, limb in enumerate(_limbs([count[c], inertia[c], *sums[c]]))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("parts", pa.list_(pa.string()))]))

    rows = forest.mapInArrow(work, "cluster int, limb int, parts array<string>").withColumn("salt", F.spark_partition_id() % 64)
    number = [F.col("parts")[i].cast("decimal(38,0)").alias(f"p{i}") for i in range(dims + 2)]
    total = [F.sum(f"p{i}").alias(f"p{i}") for i in range(dims + 2)]
    out = [[0] * (dims + 2) for _ in range(k)]
    for row in rows.select("cluster", "limb", "salt", *number).groupBy("cluster", "limb", "salt").agg(*total).groupBy("cluster", "limb").agg(*total).collect():  # k rows, times the limbs
        out[row[0]] = [x + int(y) * LIMB ** row[1] for x, y in zip(out[row[0]], row[2:])]
    return [(x[0], x[2:], x[1]) for x in out]


def _limbs(values: list[int]) -> list[list[str]]:
    """Decimal digits of whole numbers in limbs that Spark adds as decimals; one limb, but for very large numbers."""
    out = []
    while not out or any(values):
        out.append([str(abs(x) % LIMB * (1 if x >= 0 else -1)) for x in values])
        values = [abs(x) // LIMB * (1 if x >= 0 else -1) for x in values]
    return out


def cluster_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, salt: str = "1:", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (integers as text) and its sha256 for each kept vector."""
    if block * dims > CELLS:
        raise ValueError(f"block times dims must not exceed {CELLS}")
    own = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = own.where((F.size("vector") == dims) & F.forall("vector", finite))
    own = own.withColumn("vector", F.transform("vector", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0)))
    first = own.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last(), "vector").limit(k)
    centroids = [[int(x) for x in row.vector] for row in first.select("vector").collect()]  # k rows
    shape = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<string>, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], shape)
    forest = written(trees(own, dims, block), "trees")
    for _ in range(rounds):
        centroids = [[x // n for x in s] if n else old for (n, s, _), old in zip(round_totals(forest, centroids), centroids)]
    spread = [d for _, _, d in round_totals(forest, centroids)]
    held = lambda x: x if abs(x) < 1 << 63 else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cluster, distance = assigned(*_centroids(_read(row), centroids))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array([held(int(d)) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    out = forest.mapInArrow(work, "vec_id bigint, cluster int, distance bigint")
    per = lambda values: F.array(*values)[F.col("cluster")]
    return out.select(
        "vec_id", "cluster", "distance", per([F.lit(held(d)).cast("bigint") for d in spread]).alias("cluster_inertia"), F.lit(held(sum(spread))).cast("bigint").alias("inertia"),
        per([F.array(*(F.lit(str(x)) for x in c)) for c in centroids]).alias("centroid"),
        per([F.sha2(F.lit(",".join(map(str, c))).cast("binary"), 256) for c in centroids]).alias("centroid_sha256"),
    )
