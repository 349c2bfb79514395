"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its shingles of five words. Equal sets are one node. Each node has
a path of DEPTH MinHash values in each of TREES tries; two nodes that share a path's prefix
are candidates. The forest is cut at the floor, the longest prefix at which a pair at the
threshold is found with the target probability: below it nothing is needed. The subtrees
at the floor, joined into connected components, are dealt to tasks, each set once.

A task sorts the paths of each trie, reads the longest common prefixes off neighbours and
starts with whole paths. Candidates are verified exactly on their shingle sets. Then the
prefix is shortened by one value for the nodes whose estimated recall is still below the
target, and so on up to the floor. A node's recall at a depth is estimated from its links:
a link of similarity s is found there with probability 1 - (1 - s**depth)**TREES, so it
stands for as many missing ones, and one link at the threshold is taken to be missing. A
node with many close links thus stops early, one without goes up to the floor.

Texts that only share a template can hang together through many subtrees. A component of more
than PARTED blocks of BLOCK_NODES nodes is therefore looked at by single subtrees first, with paths alone: pairs
whose paths agree in so few values that a pair at the threshold falls below with probability
1e-8 (six standard deviations) part, and components are formed anew from the others.

A component that is still too large for one task, by nodes or by shingles, is cut into blocks,
and each pair of blocks is a task of its own, so no pair of rows is ever emitted: a task
returns one row per node with its number of links and the smallest node it hangs together with.

Defined cases: null or empty text has no shingles: a class of its own without links. A
text of one to four words is one shingle. Repeated rows are copies of each other. A row
with a null doc_id belongs to the class of the rows with its shingles; if none of them has
an id, it has a null class and no links. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import U64, Scratch, Words, chunks, fresh, map_batches, mix, randoms, salted_join, shuffle_partitions, window_hashes
from docquarry.llm.graphs import components

SHINGLE = 5
TREES, DEPTH = 16, 6
#: Shingles and nodes of a component that one task holds, or two blocks of them.
BLOCK_SHINGLES = 400_000
BLOCK_NODES = 2_000
#: Blocks of nodes from which a component is parted by paths first: up to that a set is sent
#: that often at most.
PARTED = 8
_VALUE = 4  # bytes of a MinHash value


def chance(similarity, depth: int, trees: int = TREES):
    """The probability that a pair shares a prefix of that depth in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def forest_floor(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs at the threshold are found with the target
    probability."""
    while depth > 1 and chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = Words(texts)
    hashes = words.hashes()
    every = window_hashes(hashes, n)
    out = []
    for first, count in zip(words.first.tolist(), words.counts.tolist(), strict=False):
        if count >= n:
            out.append(np.unique(every[first : first + count - n + 1]))
        elif count:
            out.append(mix(window_hashes(hashes[first : first + count], count) + U64(count)))
        else:
            out.append(np.zeros(0, U64))
    return out


_NODE = randoms(2, 77) | U64(1)
_MULTIPLIERS = randoms(TREES * DEPTH, 5) | U64(1)


def node_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a shingle set; None for the empty set."""
    if not len(shingles):
        return None
    return b"".join(int(mix(shingles * m).sum(dtype=U64)).to_bytes(8, "big") for m in _NODE)


def paths(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TREES * DEPTH) MinHash values of 32 bits; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_MULTIPLIERS)), ">u4")
    for k, m in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(flat * m, starts) >> U64(32)
    return out


def _utf8(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of the text), node and its paths, one after the other."""

    def run(batches):
        for batch in batches:
            texts = _utf8(batch["text"])
            nodes, found = [], []
            for a, b in chunks(list(map(len, texts))):
                sets = shingle_sets(texts[a:b])
                some = [i for i, s in enumerate(sets) if len(s)]
                nodes += [node_key(s) for s in sets]
                part: list = [None] * len(sets)
                if some:
                    for i, row in zip(some, paths([sets[i] for i in some]), strict=True):
                        part[i] = row.tobytes()
                found += part
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row_key": batch["row_key"], "node": nodes, "path": found})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    return map_batches(rows, run, "doc_id long, row_key long, node binary, path binary")


def candidate_edges(nodes: DataFrame, floor: int) -> DataFrame:
    """(u, v): each node with the smallest node of its subtree at the floor, in any trie."""

    def prefix(tree):
        return F.xxhash64(tree, F.substr("path", tree * DEPTH * _VALUE + 1, F.lit(floor * _VALUE)))

    leaves = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), prefix)).alias("prefix"))
    shared = leaves.groupBy("prefix").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter(F.col("hub") != F.col("top")).select("prefix", "hub")
    found = salted_join(leaves, shared, ["prefix"], ["node"])
    return found.select(F.col("node").alias("u"), F.col("hub").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def least_agreement(threshold: float) -> int:
    """Of TREES * DEPTH values, as many as a pair at the threshold shares but for 1e-8."""
    values = TREES * DEPTH
    return int(values * threshold - 6 * (values * threshold * (1 - threshold)) ** 0.5)


def agreeing(path: np.ndarray, side: np.ndarray, least: int) -> np.ndarray:
    """For each path the first of those that it hangs together with by pairs that share `least`
    values; if both sides occur only pairs between them count."""
    root = np.arange(len(path))
    one_side = len(set(side.tolist())) < 2
    left, right = [], []
    for i in range(len(path) - 1):
        near = np.flatnonzero((path[i + 1 :] == path[i]).sum(1) >= least) + i + 1
        near = near if one_side else near[side[near] != side[i]]
        left.append(np.full(len(near), i))
        right.append(near)
    return _roots(root, np.concatenate(left), np.concatenate(right)) if left else root


def refined(nodes: DataFrame, groups: DataFrame, threshold: float, floor: int, scratch: Scratch) -> DataFrame:
    """groups, with the components of more than PARTED blocks formed anew from pairs of one
    subtree whose paths agree. Only paths are sent, at most once a trie and pair of blocks."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > PARTED * BLOCK_NODES)
    if sizes.isEmpty():
        return groups
    large = scratch.stored(salted_join(groups, sizes, ["root"], ["node"]).select("node"), "large")
    every = large.join(nodes.select("node", "path"), "node")
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: F.xxhash64(tree, F.substr("path", tree * DEPTH * _VALUE + 1, F.lit(floor * _VALUE))))
    leaves = every.select("node", "path", F.explode(prefixes).alias("key"))
    blocks = F.ceil(F.count("*") / F.lit(BLOCK_NODES)).cast("int").alias("blocks")
    shared = leaves.groupBy("key").agg(blocks, F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = salted_join(leaves, shared, ["key"], ["node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("side"), "node", "path")
    dealt = tasks.repartition(shuffle_partitions(nodes.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    least = least_agreement(threshold)

    def run(batches):
        for (_, i, j), rows in _runs(batches, ["key", "i", "j"]):
            names, side = rows["node"].tolist(), rows["side"].to_numpy().astype(np.int8)
            if len(rows) < 2 or i != j and len(set(side.tolist())) < 2:
                continue
            path = np.frombuffer(b"".join(rows["path"]), np.uint32).reshape(len(rows), TREES * DEPTH)
            root = agreeing(path, side, least)
            away = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"u": [names[k] for k in away], "v": [names[k] for k in root[away]]})

    edges = scratch.stored(dealt.mapInPandas(run, "u binary, v binary").distinct(), "agreeing")
    rest = groups.join(large, "node", "left_anti")
    out = scratch.stored(rest.unionByName(components(edges, scratch, "refined")), "refined-groups")
    scratch.drop("large", "agreeing")
    return out


def _runs(batches, keys: list[str]):
    """Sorted rows by key, over the borders of batches."""
    held, key = [], None
    for batch in batches:
        for own, rows in batch.groupby(keys, sort=False):
            if own != key and held:
                yield key, pd.concat(held, ignore_index=True)
                held = []
            key = own
            held.append(rows)
    if held:
        yield key, pd.concat(held, ignore_index=True)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, path, shingles) of the wanted nodes, from the document `rep` of each."""

    def run(batches):
        for batch in batches:
            texts = _utf8(batch["text"])
            sets = [s for a, b in chunks(list(map(len, texts))) for s in shingle_sets(texts[a:b])]
            out = pd.DataFrame({"node": [node_key(s) for s in sets], "n": list(map(len, sets)), "path": batch["path"], "shingles": [s.tobytes() for s in sets], "want": batch["want"]})
            yield out[out["node"] == out["want"]].drop(columns="want")

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("rep_key"), "text").join(wanted.select("rep", "rep_key", "path", F.col("node").alias("want")), ["rep", "rep_key"])
    once = Window.partitionBy("rep", "rep_key").orderBy("want")
    return rows.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("text", "path", "want").mapInPandas(run, "node binary, n int, path binary, shingles binary")


# -- one task -------------------------------------------------------------------------


class Tries:
    """The paths of some nodes, sorted in each trie, with the length of the prefix that
    each shares with the one before."""

    def __init__(self, path: np.ndarray):
        """path: (nodes, TREES, DEPTH)."""
        self.order, self.common = [], []
        for tree in range(path.shape[1]):
            own = path[:, tree]
            order = np.lexsort(own.T[::-1])
            same = own[order][1:] == own[order][:-1]
            self.order.append(order)
            self.common.append(np.logical_and.accumulate(same, 1).sum(1))

    def groups(self, depth: int):
        """Node numbers of every subtree of two nodes or more at that depth."""
        for order, common in zip(self.order, self.common, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], common >= depth, [False]]).astype(np.int8)))
            for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                yield order[a : b + 1]


class Overlap:
    """Sizes of intersections of shingle sets, counted for the asked pairs only."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = number.astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(names), np.int32)

    def count(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common shingles of each pair (one[i], other[i]); `one` in ascending order."""
        out = np.empty(len(one), np.int64)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(one)) + 1, [len(one)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own, with_ = self.flat[self.start[one[a]] : self.start[one[a] + 1]], other[a:b]
            self.mark[own] = 1
            size = self.size[with_]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.repeat(self.start[with_] - begin, size) + np.arange(size.sum())
            out[a:b] = np.add.reduceat(self.mark[self.flat[at]], begin)
            self.mark[own] = 0
        return out


def linked_pairs(sets: list[np.ndarray], path: np.ndarray, side: np.ndarray, over: tuple[int, int], target: float, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets whose Jaccard similarity is at least over[0] / over[1], by
    descending the tries. side: 0 or 1 for each set; if both occur only pairs between the
    sides are looked at."""
    n, tries, overlap = len(sets), Tries(path), Overlap(sets)
    rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(cols)
    cols = rows if within else cols
    place = np.zeros(n, np.int64)
    place[rows], place[cols] = np.arange(len(rows)), np.arange(len(cols))
    seen = np.zeros((len(rows), len(cols)), bool)
    active = np.ones(n, bool)
    left, right, similar = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    threshold = over[0] / over[1]
    for depth in range(path.shape[2], floor - 1, -1):
        near = np.zeros_like(seen)
        for group in tries.groups(depth):
            if active[group].any():
                a, b = (group, group) if within else (group[side[group] == 0], group[side[group] == 1])
                near[np.ix_(place[a], place[b])] = True
        near &= ~seen
        near &= active[rows][:, None] | active[cols][None, :]
        if within:
            near = np.triu(near, 1)
        seen |= near
        i, j = np.nonzero(near)
        i, j = rows[i], cols[j]
        if len(i):
            both = overlap.count(i, j)
            either = overlap.size[i] + overlap.size[j] - both
            hit = both * over[1] >= over[0] * either
            left, right, similar = np.concatenate([left, i[hit]]), np.concatenate([right, j[hit]]), np.concatenate([similar, (both / either)[hit]])
        # each link found stands for 1 / chance links; one more is taken to be at the threshold
        lost = 1 / chance(similar, depth) - 1
        found = np.bincount(left, minlength=n) + np.bincount(right, minlength=n) + 1
        missing = np.bincount(left, lost, n) + np.bincount(right, lost, n) + 1 / chance(threshold, depth) - 1
        active = found / (found + missing) < target
        if not active.any():
            break
    return left, right


def _roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row number of each connected part."""
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(nodes: list[bytes], left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Rows (node, links, root) of one task."""
    links = np.bincount(left, minlength=len(nodes)) + np.bincount(right, minlength=len(nodes))
    root = _roots(np.arange(len(nodes)), left, right)
    return [(nodes[i], int(links[i]), nodes[root[i]]) for i in np.flatnonzero(links).tolist()]


def verify(sets: DataFrame, groups: DataFrame, over: tuple[int, int], target: float, floor: int) -> DataFrame:
    """sets: (node, n, path, shingles); groups: (node, root) of candidates. Returns rows
    (node, links, root, cut): the links that one task found for a node, the smallest node
    it hangs together with there, and whether its component was cut into blocks."""
    held = sets.select("node", "n").join(groups, "node")
    blocks = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_NODES))).cast("int")
    placed = salted_join(groups, held.groupBy("root").agg(blocks.alias("blocks")), ["root"], ["node"])
    placed = sets.join(placed, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = placed.withColumn("with", other).select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("side"), (F.col("blocks") > 1).alias("cut"), "node", "path", "shingles")
    dealt = tasks.repartition(shuffle_partitions(sets.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node")

    def run(batches):
        key, rows = None, []

        def done():
            side = np.array([r[1] for r in rows], np.int8)
            if len(rows) < 2 or key[1] != key[2] and len(set(side.tolist())) < 2:
                return []
            found = [np.frombuffer(r[3], U64) for r in rows]
            path = np.frombuffer(b"".join(r[2] for r in rows), ">u4").reshape(len(rows), TREES, DEPTH)
            left, right = linked_pairs(found, path.astype(np.uint32), side, over, target, floor)
            return [(*f, rows[0][4]) for f in _verify([r[0] for r in rows], left, right)]

        out: list[tuple] = []
        for batch in batches:
            for root, i, j, side, cut, node, path, shingles in batch.itertuples(index=False):
                if (root, i, j) != key:
                    out += done() if rows else []
                    key, rows = (root, i, j), []
                rows.append((node, side, path, shingles, cut))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["node", "links", "root", "cut"])
                out = []
        out += done() if rows else []
        yield pd.DataFrame(out, columns=["node", "links", "root", "cut"])

    return dealt.mapInPandas(run, "node binary, links long, root binary, cut boolean")


def join_classes(docs: DataFrame, threshold: tuple[int, int] = (4, 5), target: float = 0.9995) -> DataFrame:
    """One row per document: doc_id, row_key (a hash of its text), class_id (the smallest
    doc_id that links lead to), n_links (different texts within the threshold) and n_copies
    (documents with the same shingles, itself included)."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    floor = forest_floor(threshold[0] / threshold[1], target)
    signed = scratch.stored(sign(docs), "signatures")
    some = signed.filter(F.col("node").isNotNull())
    rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key")))
    nodes = scratch.stored(some.groupBy("node").agg(rep.alias("rep"), F.count("*").alias("n_copies"), F.first("path").alias("path")).select("node", "rep.doc_id", "rep.row_key", "n_copies", "path"), "nodes")
    groups = scratch.stored(components(candidate_edges(nodes, floor), scratch, "candidates"), "groups")
    groups = refined(nodes, groups, threshold[0] / threshold[1], floor, scratch)
    wanted = nodes.join(groups, "node").select("node", F.col("doc_id").alias("rep"), F.col("row_key").alias("rep_key"), "path")
    sets = scratch.stored(sets_of(docs, wanted), "shingle-sets")
    found = scratch.stored(verify(sets, groups, threshold, target, floor), "links")
    scratch.drop("shingle-sets", "groups", "refined-groups")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    whole = found.filter(~F.col("cut")).select("node", "root")
    if found.filter("cut").limit(1).count():
        whole = whole.unionByName(components(found.filter("cut").select(F.col("node").alias("u"), F.col("root").alias("v")), scratch, "cut"))
    ids = nodes.select("node", "doc_id")
    first = whole.join(ids, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = salted_join(whole, first, ["root"], ["node"]).join(links, "node").select("node", "class_id", "n_links")
    known = nodes.select("node", "doc_id", "n_copies").join(known, "node", "left").filter("n_copies > 1 OR class_id IS NOT NULL")
    known = scratch.stored(known.select("node", "n_copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    scratch.drop("links", "nodes")
    joined = salted_join(signed.select("doc_id", "row_key", "node"), known, ["node"], ["doc_id", "row_key"], "left")
    return joined.select("doc_id", "row_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all columns, of one document per class: the one whose
    doc_id names it, once. Rows with a null doc_id are kept."""
    classes = join_classes(docs.filter(F.col("doc_id").isNotNull()), **options)
    keep_id, keep_key, nth = fresh(docs, "keep_id"), fresh(docs, "keep_key"), fresh(docs, "nth")
    # the smallest text hash stands for a doc_id that has several texts of one class
    kept = classes.filter(F.col("doc_id") == F.col("class_id")).groupBy("class_id").agg(F.min("row_key").alias(keep_key)).withColumnRenamed("class_id", keep_id)
    keyed = docs.withColumn(nth, F.xxhash64("text"))
    chosen = keyed.join(kept, (F.col("doc_id").cast("long") == F.col(keep_id)) & (F.col(nth) == F.col(keep_key)))
    once = Window.partitionBy(keep_id, keep_key).orderBy(F.lit(0))
    chosen = chosen.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return chosen.select(*columns).unionByName(docs.filter(F.col("doc_id").isNull()))
