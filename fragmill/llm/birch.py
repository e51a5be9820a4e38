"""Describing a large table by clusters of similar records, from mergeable cluster features.

A cluster feature is (records, sum of vectors, sum of squared lengths). Each partition grows a tree of them with a
bounded number of leaf entries; the trees' entries are inserted into each other, a few partitions at a time, until one
tree is left; its entries are agglomerated by Ward's criterion; one pass assigns every record to the nearest centroid;
and each cluster is described by its size, its spread and the members nearest to its centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions.text import fold
from fragmill.llm import grams
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require


def vectors(values: list[str], size: int) -> np.ndarray:
    """Counts of 4-character substrings, hashed to ``size`` places, with their square roots scaled to length one."""
    codes, starts = grams.flatten([[v] for v in values])
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = (h >> np.uint64(40)).astype(np.int64) % size
    row = np.repeat(np.arange(len(values)), np.diff(starts))
    x = np.bincount(row * size + at, minlength=len(values) * size).reshape(len(values), size)
    x = np.sqrt(x.astype(np.float64))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Node:
    def __init__(self, size: int, width: int, leaf: bool):
        self.n, self.ls, self.ss = np.zeros(width + 1), np.zeros((width + 1, size)), np.zeros(width + 1)
        self.k, self.leaf, self.children = 0, leaf, []

    def nearest(self, x: np.ndarray) -> int:
        c = self.ls[: self.k] / self.n[: self.k, None]
        return int((np.einsum("ij,ij->i", c, c) - 2 * (c @ x)).argmin())

    def put(self, n: float, ls: np.ndarray, ss: float, child=None) -> None:
        self.n[self.k], self.ls[self.k], self.ss[self.k] = n, ls, ss
        self.k += 1
        if child is not None:
            self.children.append(child)

    def total(self):
        return self.n[: self.k].sum(), self.ls[: self.k].sum(0), self.ss[: self.k].sum()


class Tree:
    """A cluster feature tree: at most ``width`` entries a node and ``most`` leaf entries. Features of whole clusters are
    inserted like single vectors; one is absorbed by the nearest entry if their centroids are within the threshold.

    When there are more entries than allowed, Ward's criterion halves them, the threshold becomes half of the usual
    distance between neighbours, and the rest is inserted anew. (Raising the threshold alone, as the classical tree
    does, makes texts' vectors fall into one entry at once: all are about equally far apart.)
    """

    def __init__(self, size: int, width: int = 24, most: int = 512, threshold: float = 0.05):
        self.size, self.width, self.most, self.threshold = size, width, most, threshold
        self.root, self.entries = Node(size, width, True), 0

    def insert(self, n: float, ls: np.ndarray, ss: float) -> None:
        path, node = [], self.root
        x = ls / n
        while not node.leaf:
            i = node.nearest(x)
            path.append((node, i))
            node = node.children[i]
        merged = False
        if node.k:
            i = node.nearest(x)
            if ((node.ls[i] / node.n[i] - x) ** 2).sum() <= self.threshold**2:
                node.n[i] += n
                node.ls[i] += ls
                node.ss[i] += ss
                merged = True
        if not merged:
            node.put(n, ls, ss)
            self.entries += 1
        for up, i in path:
            up.n[i] += n
            up.ls[i] += ls
            up.ss[i] += ss
        while node.k > self.width:
            one, two = self._halves(node)
            if not path:
                self.root = Node(self.size, self.width, False)
                for part in (one, two):
                    self.root.put(*part.total(), part)
                break
            up, i = path.pop()
            up.n[i], up.ls[i], up.ss[i] = one.total()
            up.children[i] = one
            up.put(*two.total(), two)
            node = up
        if self.entries > self.most:
            self.grow()

    def insert_many(self, x: np.ndarray) -> None:
        """Vectors at once: those within the threshold of a leaf entry, by one product with all of them, are absorbed
        together; only the others go down the tree one by one."""
        held = [(node, i) for node in self._leaf_nodes() for i in range(node.k)]
        rest = np.arange(len(x))
        if held and len(x):
            c = np.array([node.ls[i] / node.n[i] for node, i in held])
            d = (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T
            best = d.argmin(1)
            near = d[rest, best] <= self.threshold**2
            label, rest = best[near], rest[~near]
            n, ss = np.bincount(label, minlength=len(held)), np.bincount(label, (x[near] ** 2).sum(1), len(held))
            sums = np.zeros((len(held), self.size))
            np.add.at(sums, label, x[near])
            for k in np.flatnonzero(n):
                node, i = held[k]
                node.n[i] += n[k]
                node.ls[i] += sums[k]
                node.ss[i] += ss[k]
            self._sum_up(self.root)
        for k in rest:
            self.insert(1.0, x[k], float(x[k] @ x[k]))

    def _leaf_nodes(self) -> list[Node]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            out += [node] if node.leaf else []
            stack += node.children
        return out

    def _sum_up(self, node: Node) -> None:
        for i, child in enumerate(node.children):
            self._sum_up(child)
            node.n[i], node.ls[i], node.ss[i] = child.total()

    def _halves(self, node: Node) -> tuple[Node, Node]:
        c = node.ls[: node.k] / node.n[: node.k, None]
        d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(2)
        a, b = np.unravel_index(d.argmax(), d.shape)
        out = Node(self.size, self.width, node.leaf), Node(self.size, self.width, node.leaf)
        near_b = d[:, b] < d[:, a]
        near_b[a], near_b[b] = False, True
        for i in range(node.k):
            out[int(near_b[i])].put(node.n[i], node.ls[i], node.ss[i], None if node.leaf else node.children[i])
        return out

    def leaves(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.leaf:
                yield from ((node.n[i], node.ls[i].copy(), node.ss[i]) for i in range(node.k))
            else:
                stack += node.children

    def grow(self) -> None:
        held = list(self.leaves())
        n, ls, ss = np.array([e[0] for e in held]), np.array([e[1] for e in held]), np.array([e[2] for e in held])
        label = ward(n, ls, self.most // 2)
        k = label.max() + 1
        n, ss = np.bincount(label, n, k), np.bincount(label, ss, k)
        sums = np.zeros((k, self.size))
        np.add.at(sums, label, ls)
        c = sums / n[:, None]
        d = (c**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * c @ c.T
        np.fill_diagonal(d, np.inf)
        self.threshold = max(self.threshold, 0.5 * float(np.sqrt(np.maximum(np.median(d.min(1)), 0))))
        self.root, self.entries = Node(self.size, self.width, True), 0
        for e in zip(n, sums, ss, strict=True):
            self.insert(float(e[0]), e[1], float(e[2]))


def _summaries(tree: Tree) -> pa.RecordBatch:
    held = list(tree.leaves())
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in held], pa.float64()), pa.array([e[1].tobytes() for e in held], pa.binary()), pa.array([e[2] for e in held], pa.float64()), pa.array([tree.threshold] * len(held), pa.float64())], names=["n", "ls", "ss", "threshold"])


def _first(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    tree = Tree(size, most=most)
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            values = whole.column(1).slice(lo, 500).to_pylist()
            tree.insert_many(vectors(values, size))
    yield _summaries(tree)


def _merged(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    tree = Tree(size, most=most)
    for batch in batches:
        t = batch.column(3).to_numpy()
        tree.threshold = max(tree.threshold, float(t.min()) if t.size else 0.0)
        for n, ls, ss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tree.insert(n, np.frombuffer(ls, np.float64), ss)
    yield _summaries(tree)


def ward(n: np.ndarray, ls: np.ndarray, k: int) -> np.ndarray:
    """The cluster number of each entry: the pair whose union adds least squared distance is joined until k are left."""
    c, w, label = ls / n[:, None], n.astype(float).copy(), np.arange(n.size)
    d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(2) if n.size else np.zeros((0, 0))
    cost = d * (w[:, None] * w[None, :]) / (w[:, None] + w[None, :]) if n.size else d
    np.fill_diagonal(cost, np.inf)
    for _ in range(max(0, n.size - k)):
        i, j = sorted(np.unravel_index(cost.argmin(), cost.shape))
        c[i] = (c[i] * w[i] + c[j] * w[j]) / (w[i] + w[j])
        w[i] += w[j]
        label[label == j] = i
        cost[j, :] = cost[:, j] = np.inf
        alive = np.flatnonzero(np.isin(np.arange(n.size), label))
        row = ((c[alive] - c[i]) ** 2).sum(1) * w[alive] * w[i] / (w[alive] + w[i])
        cost[i, alive] = cost[alive, i] = row
        cost[i, i] = np.inf
    return np.unique(label, return_inverse=True)[1]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    squares = (centroids**2).sum(1)
    for whole in batches:
        for lo in range(0, whole.num_rows, 2000):
            batch = whole.slice(lo, 2000)
            x = vectors(batch.column(1).to_pylist(), centroids.shape[1])
            d = np.maximum((x**2).sum(1)[:, None] + squares[None, :] - 2 * x @ centroids.T, 0)
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(np.round(np.sqrt(d[np.arange(best.size), best]), 9))], names=["id", "cluster", "distance"])


class Clustering:
    """Clusters of ``df`` (id, value) by the substrings of the folded value.

    Null values and values that fold to fewer than four characters are left out; an empty table has no cluster. Rows
    with the same id are rows of their own. ``leaves`` bounds a tree's entries, and with them what is merged, collected
    and agglomerated, whatever the number of records; ``k`` is the greatest number of clusters.
    """

    def __init__(self, df: DataFrame, id_col: str, value: str, k: int = 50, leaves: int = 400, size: int = 128, fan_in: int = 8):
        require(df, [id_col, value])
        rows = df.select(F.col(f"`{id_col}`").alias("id"), fold(F.col(f"`{value}`")).alias("value")).filter(F.length("value") >= grams.N)
        self.scratch = Scratch(df.sparkSession)
        self.rows = self.scratch.keep(rows)
        shape = "n double, ls binary, ss double, threshold double"
        held = self.scratch.keep(self.rows.mapInArrow(lambda it: _first(it, size, leaves), shape))
        parts = self.rows.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // fan_in)
            held = self.scratch.keep(held.repartition(parts).mapInArrow(lambda it: _merged(it, size, leaves), shape))
        entries = held.collect()  # at most ``leaves`` rows
        n, ls = np.array([e.n for e in entries]), np.array([np.frombuffer(e.ls, np.float64) for e in entries]).reshape(len(entries), size)
        label = ward(n, ls, k)
        many = label.max() + 1 if label.size else 0
        self.centroids = np.array([ls[label == i].sum(0) / n[label == i].sum() for i in range(many)]).reshape(many, size)

    def assigned(self) -> DataFrame:
        """(id, cluster, distance) of every record."""
        kind = self.rows.schema["id"].dataType.simpleString()
        if not len(self.centroids):
            return self.rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")).limit(0)
        held = self.rows.sparkSession.sparkContext.broadcast(self.centroids)
        return self.rows.mapInArrow(lambda it: _assigned(it, held.value), f"id {kind}, cluster int, distance double")

    def described(self, members: int = 3) -> DataFrame:
        """(cluster, size, spread, rank, id, distance): each cluster's size, mean distance and most typical members."""
        rows = self.scratch.keep(self.assigned())
        sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("distance"), 6).alias("spread"))
        w = Window.partitionBy("cluster").orderBy("distance", "id")
        top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= members)
        return top.join(sizes, "cluster").select("cluster", "size", "spread", "rank", "id", "distance")


def kept_together(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """(rows, groups, kept): of groups (id, grp) of similar records, the share of records that stand in the cluster
    (id, cluster) which holds most of their group. Null where there are no groups."""
    both = groups.join(clusters, "id").groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    each = both.groupBy("grp").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return each.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"), F.try_divide(F.sum("most"), F.sum("all")).alias("kept"))
