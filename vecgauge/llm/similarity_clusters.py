"""Clusters of similar vectors from mergeable cluster-feature trees.

Each block of vectors is condensed into a cluster-feature tree: every entry is a
summary (count, linear sum, square sum), nodes hold up to ``BRANCHING`` entries,
and a vector descends to the nearest entry and is absorbed there within a radius.
The radius starts at nothing and grows only while a tree has more leaves than
``LEAVES_PER_CLUSTER`` for each wanted cluster: then the entries nearest to each
other in their nodes are joined, the cheapest first, down to half the limit. So
a tree never has fewer leaves than half the limit while its block holds as many
distinct vectors, and k clusters come out for any k. Leaf summaries add, so those
of several blocks are inserted into one tree, a few blocks at a time, until one
set of leaves per group is left. Ward's criterion joins these leaves into k
clusters. One pass over all vectors then assigns each to its nearest centroid
and names the members nearest to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgauge.llm.vector_blocks import blocked, unit_matrix
from vecgauge.session import cut

BRANCHING = 32
#: A tree has at most so many leaves for each wanted cluster, and never a lower limit than ``MIN_LEAVES``.
LEAVES_PER_CLUSTER, MIN_LEAVES = 8, 256
FAN_IN = 8
#: Vectors that descend the tree together.
BATCH = 256


class _Node:
    """Up to ``BRANCHING`` entries; ``children`` is None in a node of leaves."""

    __slots__ = ("n", "linear", "square", "children")

    def __init__(self, n: np.ndarray, linear: np.ndarray, square: np.ndarray, children: list[_Node] | None):
        self.n, self.linear, self.square, self.children = n, linear, square, children

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n.sum(), self.linear.sum(0), self.square.sum()


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


def _stack(parts: list[tuple[float, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([p[0] for p in parts]), np.stack([p[1] for p in parts]), np.array([p[2] for p in parts])


def _pairs(n: np.ndarray, linear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries nearest to each other by Ward's cost: cost, first, second."""
    if len(n) < 2:
        return np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    cost = np.maximum(_gaps(linear / n[:, None], linear / n[:, None]), 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(1)
    first = np.flatnonzero((near[near] == np.arange(len(n))) & (np.arange(len(n)) < near))
    return cost[first, near[first]], first, near[first]


class FeatureTree:
    """Cluster-feature tree of a bounded number of leaves."""

    def __init__(self, dims: int, max_leaves: int):
        self.dims, self.max_leaves, self.radius = dims, max_leaves, 0.0
        self._clear()

    def _clear(self) -> None:
        self.root, self.size = _Node(np.zeros(0), np.zeros((0, self.dims)), np.zeros(0), None), 0

    def insert(self, n: np.ndarray, linear: np.ndarray, square: np.ndarray) -> None:
        """Absorb summaries into the nearest leaf that stays within the radius, else open leaves."""
        step = min(BATCH, max(1, self.max_leaves // 2))
        for at in range(0, len(n), step):
            self._add((n[at : at + step], linear[at : at + step], square[at : at + step]), absorb=True)
            if self.size > self.max_leaves:
                self._condense()

    def _add(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], absorb: bool) -> None:
        parts = self._descend(self.root, rows, absorb)
        while len(parts) > 1:  # the root was split
            self.root = _Node(*_stack([p.total() for p in parts]), parts)
            parts = self._split(self.root)

    def _descend(self, node: _Node, rows: tuple[np.ndarray, np.ndarray, np.ndarray], absorb: bool) -> list[_Node]:
        """Insert below ``node``; what it has become."""
        n, linear, square = rows
        if node.children is None:
            self._into_leaf(node, n, linear, square, absorb)
            return self._split(node)
        way = _gaps(linear / n[:, None], node.linear / node.n[:, None]).argmin(1)
        children: list[_Node] = []
        for i, child in enumerate(node.children):
            mine = way == i
            children += self._descend(child, (n[mine], linear[mine], square[mine]), absorb) if mine.any() else [child]
        node.children = children
        node.n, node.linear, node.square = _stack([c.total() for c in children])
        return self._split(node)

    def _into_leaf(self, node: _Node, n: np.ndarray, linear: np.ndarray, square: np.ndarray, absorb: bool) -> None:
        if not absorb:
            self.size += len(n)
            node.n, node.linear, node.square = np.append(node.n, n), np.vstack([node.linear, linear]), np.append(node.square, square)
            return
        waiting = np.arange(len(n))
        while len(waiting):
            if len(node.n):
                leaf = _gaps(linear[waiting] / n[waiting, None], node.linear / node.n[:, None]).argmin(1)
                joint = n[waiting] + node.n[leaf]
                spread = (square[waiting] + node.square[leaf]) / joint - (((linear[waiting] + node.linear[leaf]) / joint[:, None]) ** 2).sum(1)
                fits = spread <= self.radius**2 + 1e-12
                for mine, theirs in ((node.n, n), (node.linear, linear), (node.square, square)):
                    np.add.at(mine, leaf[fits], theirs[waiting[fits]])
                waiting = waiting[~fits]
            if len(waiting):  # the first one opens a leaf, and while nothing may be absorbed all but repeated ones do
                opening = waiting[:1] if self.radius else waiting[np.sort(np.unique(linear[waiting] / n[waiting, None], axis=0, return_index=True)[1])]
                node.n, node.linear, node.square = np.append(node.n, n[opening]), np.vstack([node.linear, linear[opening]]), np.append(node.square, square[opening])
                self.size += len(opening)
                waiting = np.setdiff1d(waiting, opening, assume_unique=True)

    def _split(self, node: _Node) -> list[_Node]:
        """Halve a node around its two most distant entries until each part has at most ``BRANCHING``."""
        if len(node.n) <= BRANCHING:
            return [node]
        centres = node.linear / node.n[:, None]
        one = _gaps(centres, centres.mean(0)[None, :])[:, 0].argmax()
        other = _gaps(centres, centres[one][None, :])[:, 0].argmax()
        side = _gaps(centres, centres[[one, other]]).argmin(1) == 1
        if side.all() or not side.any():
            side = np.arange(len(centres)) % 2 == 1
        out: list[_Node] = []
        for s in (~side, side):
            children = None if node.children is None else [c for c, x in zip(node.children, s, strict=True) if x]
            out += self._split(_Node(node.n[s], node.linear[s], node.square[s], children))
        return out

    def leaf_nodes(self, node: _Node | None = None) -> list[_Node]:
        node = node or self.root
        return [node] if node.children is None else [x for c in node.children for x in self.leaf_nodes(c)]

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = self.leaf_nodes()
        return np.concatenate([x.n for x in nodes]), np.concatenate([x.linear for x in nodes]), np.concatenate([x.square for x in nodes])

    def _condense(self) -> None:
        """Join leaves that are nearest to each other in their nodes, the cheapest first, until half the limit is left."""
        while self.size > self.max_leaves // 2:
            nodes = self.leaf_nodes()
            base = np.cumsum([0, *(len(x.n) for x in nodes)])
            n, linear, square = self.leaves()
            found = [(c, a + b, o + b) for x, b in zip(nodes, base, strict=False) for c, a, o in [_pairs(x.n, x.linear)]]
            cost, first, second = (np.concatenate([f[i] for f in found]) for i in range(3))
            if not len(cost):  # every node has a single entry
                cost, first, second = _pairs(n, linear)
            cheapest = np.argsort(cost, kind="stable")[: self.size - self.max_leaves // 2]
            first, second = first[cheapest], second[cheapest]
            for x in (n, linear, square):
                x[first] += x[second]
            kept = np.ones(len(n), bool)
            kept[second] = False
            spread = square[first] / n[first] - ((linear[first] / n[first, None]) ** 2).sum(1)
            self.radius = max(self.radius, float(np.sqrt(max(0.0, spread.max()))))
            self._clear()
            rows = n[kept], linear[kept], square[kept]
            for at in range(0, len(rows[0]), BATCH):
                self._add(tuple(x[at : at + BATCH] for x in rows), absorb=False)


def ward(n: np.ndarray, linear: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of each leaf; joins by the least growth of the within-cluster squares until k are left.

    Chains of nearest neighbours find the joins without a table of all pairs;
    the cheapest of them are carried out.
    """
    size, n, centre = len(n), n.astype(float).copy(), linear / n[:, None]
    alive, joins, chain = np.ones(size, bool), [], []
    name = np.arange(size)  # the leaf that stands for what has been joined here
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        at = chain[-1]
        cost = ((centre - centre[at]) ** 2).sum(1) * (n * n[at] / (n + n[at]))
        cost[~alive], cost[at] = np.inf, np.inf
        near = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            other = chain[-2]
            joins.append((float(cost[other]), name[at], name[other]))
            centre[at] = (n[at] * centre[at] + n[other] * centre[other]) / (n[at] + n[other])
            n[at] += n[other]
            alive[other] = False
            chain = chain[:-2]
        else:
            chain.append(near)
    group = np.arange(size)

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for _, a, b in sorted(joins, key=lambda j: j[0])[: max(0, size - max(1, k))]:
        group[top(a)] = top(b)
    return np.unique([top(i) for i in range(size)], return_inverse=True)[1]


LEAVES = "grp string, node int, nodes int, k int, n double, linear array<double>, square double"


def _frame(grp: str, node: int, nodes: int, k: int, tree: FeatureTree) -> pd.DataFrame:
    n, linear, square = tree.leaves()
    return pd.DataFrame({"grp": grp, "node": node, "nodes": nodes, "k": k, "n": n, "linear": list(linear), "square": square})


def _max_leaves(k: int) -> int:
    return max(MIN_LEAVES, LEAVES_PER_CLUSTER * k)


def _condense(key, part: pd.DataFrame) -> pd.DataFrame:
    x = unit_matrix(part.sort_values("id")["vec"])
    k = int(part["k"].iloc[0])
    tree = FeatureTree(x.shape[1], _max_leaves(k))
    tree.insert(np.ones(len(x)), x, (x**2).sum(1))
    return _frame(key[0], key[1], int(part["blocks"].iloc[0]), k, tree)


def _merge(key, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["node", "n", "square"], ascending=[True, False, True])
    linear = np.stack(part["linear"].to_numpy())
    k = int(part["k"].iloc[0])
    tree = FeatureTree(linear.shape[1], _max_leaves(k))
    tree.insert(part["n"].to_numpy(), linear, part["square"].to_numpy())
    return _frame(key[0], key[1], -(-int(part["nodes"].iloc[0]) // FAN_IN), k, tree)


def _centroids(key, part: pd.DataFrame) -> pd.DataFrame:
    linear, n = np.stack(part["linear"].to_numpy()), part["n"].to_numpy()
    group = ward(n, linear, int(part["k"].iloc[0]))
    total, size = np.zeros((group.max() + 1, linear.shape[1])), np.zeros(group.max() + 1)
    np.add.at(total, group, linear)
    np.add.at(size, group, n)
    return pd.DataFrame({"grp": key[0], "cluster": np.arange(len(size)), "centroid": list(total / size[:, None])})


def _assign(typical: int):
    def run(key, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(model):
            return pd.DataFrame(columns=["grp", "id", "cluster", "distance", "place"], dtype=object)
        x, c = unit_matrix(part["vec"]), np.stack(model["centroid"].to_numpy())
        d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]))
        at = d.argmin(1)
        out = pd.DataFrame({"grp": key[0], "id": part["id"].to_numpy(), "cluster": model["cluster"].to_numpy()[at], "distance": np.round(d[np.arange(len(x)), at], 9)})
        out = out.sort_values(["cluster", "distance", "id"])
        out["place"] = out.groupby("cluster").cumcount()
        return out

    return run


def similarity_clusters(vectors: DataFrame, chosen_k: DataFrame, block_rows: int = 4000, typical: int = 5) -> DataFrame:
    """``grp, id, cluster, distance, place``: every vector of each group that has a ``k``.

    ``vectors`` has ``grp, id, vec`` (see ``usable_vectors``), ``chosen_k`` has
    ``grp, k``, each group once. Vectors count by direction. ``place`` is the
    rank by distance within the cluster and block. A group of at most k distinct
    vectors gets one cluster for each; k below 1 counts as 1; groups without k,
    with a null k or without vectors give no rows. A task holds one block, or the
    leaves of ``FAN_IN`` trees, whose number follows k. The assignment is written
    to the shared folder, as callers use it more than once.
    """
    wanted = chosen_k.where("grp is not null and k is not null").select("grp", F.greatest(F.col("k"), F.lit(1)).cast("int").alias("k"))
    parts = cut(blocked(vectors, block_rows).join(wanted, "grp"))
    leaves = parts.groupBy("grp", F.col("block").alias("node")).applyInPandas(_condense, LEAVES)
    widest = parts.agg(F.max("blocks")).first()[0] or 1
    while widest > 1:
        above = leaves.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        leaves = above.groupBy("grp", "node").applyInPandas(_merge, LEAVES)
        widest = -(-widest // FAN_IN)
    models = leaves.groupBy("grp").applyInPandas(_centroids, "grp string, cluster int, centroid array<double>")
    blocks = parts.select(F.col("grp").alias("g"), F.col("block").alias("b")).distinct()
    copies = models.join(blocks, F.col("grp") == F.col("g")).select(F.col("g").alias("grp"), F.col("b").alias("block"), F.col("cluster").alias("cluster"), "centroid")
    return cut(
        parts.groupBy("grp", "block").cogroup(copies.groupBy("grp", "block"))
        .applyInPandas(_assign(typical), "grp string, id long, cluster int, distance double, place int")
    )


def describe_clusters(assigned: DataFrame, typical: int = 5) -> DataFrame:
    """``grp, cluster, n_members, mean_distance, typical``: size and the ids nearest to the centroid.

    Only the nearest few of each block are compared, never a whole cluster.
    """
    near = F.when(F.col("place") < typical, F.struct("distance", "id"))
    return assigned.groupBy("grp", "cluster").agg(
        F.count("*").alias("n_members"), F.avg("distance").alias("mean_distance"), F.slice(F.array_sort(F.collect_list(near)), 1, typical).alias("near")
    ).select("grp", "cluster", "n_members", "mean_distance", F.transform("near", lambda x: x["id"]).alias("typical"))


def neighbours_in_order(assigned: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """``grp, cluster, person_a, person_b``: members next to each other in order of id.

    The rows are range-partitioned by group, cluster and id, whatever their
    distribution; within a range the next member follows by a window, and the
    last of a range is joined to the first of the next one that holds the cluster.
    """
    ranges = max(1, assigned.count() // chunk_rows)
    rows = cut(assigned.select("grp", "cluster", "id").repartitionByRange(ranges, "grp", "cluster", "id").withColumn("chunk", F.spark_partition_id()))
    inside = Window.partitionBy("grp", "cluster", "chunk").orderBy("id")
    between = Window.partitionBy("grp", "cluster").orderBy("chunk")
    near = rows.select("grp", "cluster", F.col("id").alias("person_a"), F.lead("id").over(inside).alias("person_b"))
    edges = rows.groupBy("grp", "cluster", "chunk").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    far = edges.select("grp", "cluster", F.col("last").alias("person_a"), F.lead("first").over(between).alias("person_b"))
    return near.unionByName(far).where("person_b is not null")
