"""Lloyd clustering with two trees: a cover tree over the vectors and one over the centroids.

Vectors are read in blocks of a few thousand, each with a cover tree: nested nets of its
vectors, found farthest first, in which the vectors of level i are more than 2^i apart and
within 2^(i+1) of one of the next level. The blocks are stored once. Each round builds the
same kind of tree over the centroids and walks both trees: a pair of nodes whose least
possible distance is beyond another candidate's greatest one is dropped; where one centroid
is left a whole subtree goes to it by its stored sum; leaves are compared exactly.

All vectors are integers and all sums are exact: blocks of small numbers in doubles that
cannot lose a bit, others in Python integers. Bounds are loosened by more than their rounding
error, so ties are decided by the exact comparison. A round sends sums of k clusters a task;
the driver holds the k centroids only.

Defined cases: vectors that are null, of another dimension or with null or non-finite
components are left out. Fewer vectors than clusters: as many clusters as vectors. Repeated
vec_ids and equal vectors keep a row each; null vec_ids are hashed as an empty text. Ties go to
the smaller centroid number; vectors of equal hash are taken in the order of their components.
A distance or sum beyond 64 bits is null. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch

#: Vectors of a block, and of a leaf on average.
BLOCK, LEAF, CENTROID_LEAF = 4096, 32, 1
#: Largest component whose squares sum exactly in doubles.
SMALL = 1 << 20
#: Integers are summed by Spark in limbs of 32 bits.
LIMBS = 6
BLOCKS = "ids array<long>, data binary, wide boolean, nodes binary, radius binary"


# -- cover trees ---------------------------------------------------------------------


@dataclass
class Tree:
    """Points in the order of the leaves; of each node its centre, the range of its points
    and of its children, and the distance of its farthest point."""

    points: np.ndarray
    nodes: np.ndarray  # centre, start, end, first child, last child (0, 0 for a leaf)
    radius: np.ndarray

    def __post_init__(self):
        self.near = self.points.astype(np.float64)
        self.exact = bool(len(self.points)) and np.abs(self.near).max() <= SMALL
        if self.exact:
            self.points = self.near
            self.square = (self.near**2).sum(1)
        self.length = np.sqrt((self.near**2).sum(1))

    def sums(self) -> np.ndarray:
        """Running sums of the points, exact."""
        out = np.zeros((len(self.points) + 1, self.points.shape[1]), self.points.dtype)
        np.cumsum(self.points, axis=0, out=out[1:])
        return out


def net(near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The farthest-first centres, the distance at which each was taken, and every point's
    nearest centre."""
    centres, taken = [0], [np.inf]
    distance = np.sqrt(((near - near[0]) ** 2).sum(1))
    owner = np.zeros(len(near), np.int64)
    while len(centres) < most and (far := distance.max()) > 0:
        new = int(distance.argmax())
        own = np.sqrt(((near - near[new]) ** 2).sum(1))
        closer = own < distance
        owner[closer] = len(centres)
        distance[closer] = own[closer]
        centres.append(new)
        taken.append(far)
    return np.array(centres), np.array(taken), owner


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """The order of the points in the leaves, and the tree."""
    near = points.astype(np.float64)
    centres, taken, owner = net(near, max(1, -(-len(points) // leaf)))
    level = np.floor(np.log2(taken, where=np.isfinite(taken), out=np.full(len(taken), np.inf)))
    children: list[dict[float, list[int]]] = [{} for _ in centres]
    for j in range(1, len(centres)):
        above = np.flatnonzero(level[:j] > level[j])
        parent = above[((near[centres[above]] - near[centres[j]]) ** 2).sum(1).argmin()]
        children[parent].setdefault(level[j], []).append(j)
    members = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[members], np.arange(len(centres) + 1))

    # nodes in breadth-first order: (centre, how many of its levels are above the node)
    steps = [sorted(c.items(), reverse=True) for c in children]
    nodes, order, first = [(0, 0)], [], []
    for j, depth in nodes:
        first.append(len(nodes))
        if depth < len(steps[j]):
            nodes += [(j, depth + 1), *((c, 0) for c in steps[j][depth][1])]
    table = np.zeros((len(nodes), 5), np.int64)
    stack = [(0, False)]
    while stack:
        i, done = stack.pop()
        j, depth = nodes[i]
        if done:
            table[i, 2] = len(order)
            continue
        table[i, 0], table[i, 1] = centres[j], len(order)
        stack.append((i, True))
        if depth < len(steps[j]):
            table[i, 3], table[i, 4] = first[i], first[i] + 1 + len(steps[j][depth][1])
            stack += [(c, False) for c in reversed(range(table[i, 3], table[i, 4]))]
        else:
            order += members[begin[j] : begin[j + 1]].tolist()
    at = np.array(order, np.int64)
    radius = np.array([np.sqrt(((near[at[s:e]] - near[c]) ** 2).sum(1).max()) for c, s, e in table[:, :3]])
    where = np.empty(len(at), np.int64)
    where[at] = np.arange(len(at))
    table[:, 0] = where[table[:, 0]]
    return at, Tree(points[at], table, radius)


# -- assignment ----------------------------------------------------------------------


class Centroids:
    """The centroids, lists of integers, and their tree."""

    def __init__(self, rows: list[list[int]]):
        exact = np.array(rows, dtype=object)
        self.order, self.tree = cover_tree(exact, CENTROID_LEAF)

    def within(self, nodes: list[int]) -> np.ndarray:
        """Places in the tree's order of the centroids of some nodes, by their number."""
        at = np.concatenate([np.arange(*self.tree.nodes[c, 1:3]) for c in nodes])
        return at[np.argsort(self.order[at])]


def assign(tree: Tree, centroids: Centroids) -> Iterator[tuple[int, int, object]]:
    """(start, end, clusters) over all of the tree's points: the nearest centroid's number,
    one for the range or an array."""
    other = centroids.tree
    kids = other.nodes[:, 4] > 0
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        q, near = stack.pop()
        centre, start, end, child, last = tree.nodes[q].tolist()
        while True:
            c = other.nodes[near, 0]
            d = np.sqrt(((other.near[c] - tree.near[centre]) ** 2).sum(1))
            slack = 1e-9 * (d + tree.radius[q] + other.radius[near]) + 1e-12 * (tree.length[centre] + other.length[c])
            reach = tree.radius[q] + other.radius[near] + slack
            near = near[d - reach <= (d + reach).min()]
            inner = near[kids[near]]
            if not len(inner) or (last and tree.radius[q] > other.radius[inner].max()):
                break
            near = np.concatenate([near[~kids[near]], *(np.arange(*other.nodes[i, 3:5]) for i in inner)])
        sizes = other.nodes[near, 2] - other.nodes[near, 1]
        if len(near) == 1 and sizes[0] == 1:
            yield start, end, int(centroids.order[other.nodes[near[0], 1]])
        elif last:
            stack += [(k, near) for k in range(child, last)]
        else:
            at = centroids.within(near.tolist())
            yield start, end, centroids.order[at[distances(tree, start, end, other, at).argmin(1)]]


def distances(tree: Tree, start: int, end: int, other: Tree, at: np.ndarray) -> np.ndarray:
    """Exact squared distances of points [start, end) to some centroids."""
    if tree.exact and other.exact:
        return tree.square[start:end, None] + other.square[at] - 2 * (tree.points[start:end] @ other.points[at].T)
    points, far = _integers(tree.points[start:end]), _integers(other.points[at])
    out = np.empty((len(points), len(far)), dtype=object)
    for k, row in enumerate(far):
        out[:, k] = ((points - row) ** 2).sum(1)
    return out


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def labels(tree: Tree, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and exact squared distance of each point."""
    cluster, distance = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), object)
    place = np.argsort(centroids.order)
    for start, end, found in assign(tree, centroids):
        cluster[start:end] = found
    for k in np.unique(cluster):
        mine = np.flatnonzero(cluster == k)
        part = Tree(tree.points[mine], tree.nodes[:0], tree.radius[:0])
        distance[mine] = distances(part, 0, len(mine), centroids.tree, place[k : k + 1])[:, 0]
    return cluster, distance


def totals(tree: Tree, centroids: Centroids, out: dict[int, list[int]]) -> None:
    """Add each cluster's count and component sums to `out`; whole subtrees by their sum."""
    running = tree.sums()
    for start, end, found in assign(tree, centroids):
        if isinstance(found, int):
            groups = [(found, end - start, running[end] - running[start])]
        else:
            groups = [(k, int((found == k).sum()), tree.points[start:end][found == k].sum(0)) for k in np.unique(found).tolist()]
        for k, n, values in groups:
            old = out.setdefault(k, [0] * (1 + len(values)))
            old[0] += n
            for i, v in enumerate(values.tolist(), 1):
                old[i] += int(v)


# -- blocks and rounds ---------------------------------------------------------------


def limbs(x: int) -> list[int]:
    """An integer in LIMBS parts of 32 bits, the last with its sign."""
    return [x >> 32 * i & 0xFFFFFFFF for i in range(LIMBS - 1)] + [x >> 32 * (LIMBS - 1)]


def whole(parts: list[int]) -> int:
    return sum(p << 32 * i for i, p in enumerate(parts))


def _blocks(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _of_size(batches, BLOCK):
            x = batch.column("x")
            values = np.floor(256 * x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            wide = bool(np.abs(values).max() >= 1 << 31)
            order, tree = cover_tree(values, LEAF)
            data = values[order] if wide else values[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("vec_id").take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()]), pa.array([wide]), pa.array([tree.nodes.astype(np.int32).tobytes()]), pa.array([tree.radius.tobytes()])],
                ["ids", "data", "wide", "nodes", "radius"],
            )

    return run


def _of_size(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - sum(b.num_rows for b in held))
            batch = batch.slice(part.num_rows)
            held.append(part)
            if sum(b.num_rows for b in held) == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in ("data", "wide", "nodes", "radius")}
            wide = row["wide"].as_py()
            data = np.frombuffer(row["data"].as_py(), np.float64 if wide else np.int32).reshape(-1, dim)
            points = _integers(data) if wide else data.astype(np.float64)
            yield batch.column("ids")[i].values, Tree(points, np.frombuffer(row["nodes"].as_py(), np.int32).reshape(-1, 5).astype(np.int64), np.frombuffer(row["radius"].as_py()))


def _gather(rows: DataFrame, run: Callable) -> dict[int, list[int]]:
    """Integers of each cluster, summed over all tasks: `run` makes {cluster: integers} of a
    task's blocks. The driver gets as many numbers as the centroids have."""

    def task(batches):
        out: dict[int, list[int]] = {}
        run(batches, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([[p for v in values for p in limbs(v)] for values in out.values()], pa.list_(pa.int64()))], ["cluster", "parts"])

    sums = rows.mapInArrow(task, "cluster int, parts array<long>").select("cluster", F.posexplode("parts").alias("pos", "part")).groupBy("cluster", "pos").agg(F.sum("part").alias("part"))
    flat: dict[int, dict[int, int]] = {}
    for r in sums.collect():
        flat.setdefault(r["cluster"], {})[r["pos"]] = r["part"]
    return {k: [whole([parts[i + j] for j in range(LIMBS)]) for i in range(0, len(parts), LIMBS)] for k, parts in flat.items()}


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x) of the vectors with `dim` finite components."""
    fine = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.col("embedding").alias("x"))


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return [np.floor(256 * np.array(r["x"])).tolist() for r in rows]


def long_or_none(x: int) -> int | None:
    return x if x < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector
    after `rounds` rounds from the k vectors of smallest hash."""
    kept = usable(vectors, dim)
    now = [[int(v) for v in row] for row in first_centroids(kept, k)]
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not now:
        return vectors.sparkSession.createDataFrame([], result)
    blocks = Scratch(vectors.sparkSession, "kmeans").stored(kept.mapInArrow(_blocks(dim), BLOCKS), "blocks")
    for _ in range(rounds):
        centroids = Centroids(now)

        def add(batches, out, centroids=centroids):
            for _, tree in _trees(batches, dim):
                totals(tree, centroids, out)

        for number, (n, *sums) in _gather(blocks, add).items():
            now[number] = [s // n for s in sums]
    last = Centroids(now)

    def inertia(batches, out):
        for _, tree in _trees(batches, dim):
            own, distance = labels(tree, last)
            for number in np.unique(own).tolist():
                old = out.setdefault(number, [0])
                old[0] += int(distance[own == number].sum())

    spread = {number: s for number, (s,) in _gather(blocks, inertia).items()}
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now]
    total = long_or_none(sum(spread.values()))

    def rows(batches):
        for ids, tree in _trees(batches, dim):
            own, distance = labels(tree, last)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(own, pa.int32()), pa.array([long_or_none(int(d)) for d in distance], pa.int64()), pa.array([long_or_none(spread[c]) for c in own.tolist()], pa.int64()), pa.array([total] * len(own), pa.int64()), pa.array([names[c] for c in own.tolist()])],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.mapInArrow(rows, result)
