"""Decision trees: large nodes are split level by level from histograms, small ones grow whole in one last job.

A tree is a small dict kept by the driver, node id -> Node; the children of node i are 2i and 2i + 1. It
is applied as one expression over constant arrays, so scoring never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmine.operators import splits
from tabmine.operators.frame import literal_array, parts_for
from tabmine.sources.files import stored


@dataclass
class Node:
    counts: list[float]
    feature: int | None = None
    threshold: float | None = None
    ratio: float = 0.0

    @property
    def label(self) -> int:
        """The majority class, the lowest of equals."""
        return max(range(len(self.counts)), key=lambda c: (self.counts[c], -c))


@dataclass
class Tree:
    classes: int
    nodes: dict[int, Node] = field(default_factory=dict)

    def leaf_of(self, x: Column) -> Column:
        """The leaf id of a feature vector."""
        return Walk([self]).node(x)

    def leaves(self, node: int = 1) -> list[int]:
        return [node] if self.nodes[node].feature is None else [*self.leaves(2 * node), *self.leaves(2 * node + 1)]


class Walk:
    """Trees as constant arrays of nodes: a vector goes down by as many array look-ups as the trees are deep."""

    def __init__(self, trees: list[Tree]):
        self.keys: list[int] = []  # tree * ROOM + node id, by place
        self.roots, feature, threshold, left, self.depth = [], [], [], [], 0
        for t, tree in enumerate(trees):
            self.roots.append(len(self.keys))
            order, at = [1], 0
            while at < len(order):  # the children of a node are neighbours
                if tree.nodes[order[at]].feature is not None:
                    order += [2 * order[at], 2 * order[at] + 1]
                at += 1
            place = {i: len(self.keys) + k for k, i in enumerate(order)}
            for i in order:
                n = tree.nodes[i]
                feature.append(-1 if n.feature is None else n.feature)
                threshold.append(0.0 if n.threshold is None else float(n.threshold))
                left.append(-1 if n.feature is None else place[2 * i])
                self.keys.append(t * ROOM + i)
            self.depth = max(self.depth, max(order).bit_length() - 1)
        self.feature, self.threshold, self.left = literal_array(feature, "int"), literal_array(threshold), literal_array(left, "int")

    def place(self, x: Column, tree: Column | None = None) -> Column:
        """The place of the leaf of x in ``keys``."""
        start = F.lit(0) if tree is None else literal_array(self.roots, "int")[tree]
        if not self.depth:
            return start

        def down(at: Column, _: Column) -> Column:
            right = (x[self.feature[at]] > self.threshold[at]).cast("int")
            return F.when(self.feature[at] < 0, at).otherwise(self.left[at] + right)

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), start.cast("int"), down)

    def node(self, x: Column) -> Column:
        """The leaf id of x in the first tree."""
        return literal_array(self.keys, "int")[self.place(x)]


#: Node ids of one tree lie below this.
ROOM = 1 << 32


def grow(
    rows: DataFrame, classes: int, features: int, max_depth: int = 10, min_rows: int = 2, min_score: float = 1e-5,
    criterion: str = "ratio", candidates: int | None = None, **sizes: int,
) -> Tree:
    """Grow a tree; a node stays a leaf at ``max_depth``, below ``min_rows``, when pure or below ``min_score``."""
    return grow_all(rows.withColumn("tree", F.lit(0)), 1, classes, features, max_depth, min_rows, min_score, criterion, candidates, **sizes)[0]


def grow_all(
    rows: DataFrame, trees: int, classes: int, features: int, max_depth: int = 10, min_rows: int = 2, min_score: float = 1e-5,
    criterion: str = "ratio", candidates: int | None = None, small: int | None = None, bins: int = 256,
) -> list[Tree]:
    """Grow several trees at once; column tree (0, 1, ...) tells whose training row it is.

    Nodes of over ``small`` rows (about four million cells, unless given) are split level by level: histograms over
    ``bins`` bins a feature tell which bins can hold the best cut, and only those are read by value. Of two children the
    smaller is counted and the other is the parent less it. Nodes of at most ``small`` rows are left for one
    last job, in which a task grows all that is below a node. The trees are those of trying every cut of every
    node, whatever the sizes. x must be free of nulls. No rows, or rows of one class, give a single leaf.
    """
    rows = rows.select("x", "y", F.col("tree").cast("int").alias("tree")).persist()
    out = [Tree(classes, {1: Node([0.0] * classes)}) for _ in range(trees)]
    for r in rows.groupBy("tree", "y").agg(F.count("*").alias("n")).collect():  # trees times classes
        out[r.tree].nodes[1].counts[r.y] = float(r.n)
    small = max(1024, (1 << 22) // max(1, features)) if small is None else small
    edges, above, left_over = None, None, set()

    def at(keys: set[int]) -> DataFrame:
        """The rows that lie in these nodes, as (node, y, x)."""
        walk = Walk(out)
        key = literal_array([k if k in keys else -1 for k in walk.keys], "long")[walk.place(F.col("x"), F.col("tree"))]
        return rows.select(key.alias("node"), "y", "x").filter("node >= 0")

    def add(found: DataFrame) -> None:
        for s in sorted(found.collect(), key=lambda s: s.node):  # the splits; parents come before children
            if round(s.score, 9) >= min_score:
                tree, i = out[s.node // ROOM], s.node % ROOM
                n = tree.nodes[i]
                n.feature, n.threshold, n.ratio = s.fi, s.threshold, s.score
                tree.nodes[2 * i], tree.nodes[2 * i + 1] = Node([float(c) for c in s.left]), Node([float(c) for c in s.right])

    for depth in range(max_depth):
        may = lambda n: sum(n.counts) >= min_rows and max(n.counts) < sum(n.counts)
        opened = {t * ROOM + i: sum(n.counts) for t, tree in enumerate(out) for i, n in tree.nodes.items() if i >> depth == 1 and may(n)}
        left_over |= {k for k, n in opened.items() if n <= small}
        large = {k for k, n in opened.items() if n > small}
        if not large:
            break
        if candidates is not None:
            counts = splits.lowest(at(large), classes, features, candidates)
        else:
            edges = splits.bin_edges(rows, features, bins) if edges is None else edges
            above = stored(_histograms(out, at, large, above, edges, classes, bins), "histograms")
            marked = stored(splits.open_bins(above, classes, min_score, criterion), "bins")
            counts = stored(splits.refined(at(large), edges, marked, classes, bins), "values")
        add(splits.best_splits(splits.split_scores(counts, classes, criterion, candidates)))
    if left_over:
        add(splits.subtrees(at(left_over), ROOM, max_depth, classes, min_rows, min_score, criterion, candidates))
    rows.unpersist()
    return out


def _histograms(out: list[Tree], at: Callable, large: set[int], above: DataFrame | None, edges: list, classes: int, bins: int) -> DataFrame:
    """Histograms of the nodes ``large``, from those of their parents and a count of the smaller child of each."""
    if above is None:
        return splits.histograms(at(large), edges, classes, bins)
    size = lambda k: sum(out[k // ROOM].nodes[k % ROOM].counts)
    less = {min(k, k ^ 1, key=lambda j: (size(j), j)) for k in large}
    rest = {k ^ 1 for k in less} & large  # the parent less the smaller child
    scanned = splits.histograms(at(less), edges, classes, bins)
    scanned = stored(scanned, "counted")
    parent = {k // ROOM * ROOM + k % ROOM // 2: k & 1 for k in rest}
    node, odd = F.col("node"), F.col("node").isin([p for p, side in parent.items() if side])
    whole = above.filter(node.isin(list(parent))).withColumn("node", node + node % ROOM + odd.cast("long"))
    minus = scanned.withColumns({"node": node.bitwiseXOR(F.lit(1)), "n": -F.col("n")}).filter(node.isin(list(rest)))
    every = scanned.filter(node.isin(list(large))).unionByName(whole).unionByName(minus)
    return every.groupBy("node", "fi", "b", "y").agg(F.sum("n").alias("n")).filter("n > 0")


def edges(rows: DataFrame, features: int, n: int) -> list[np.ndarray] | None:
    """Edges of the bins in which ``n`` values of each feature are scored, from quantiles of all rows; None if one bin is enough."""
    parts = parts_for(n)
    return None if parts == 1 else splits.bin_edges(rows, features, parts)


def split_scores(cells: DataFrame, classes: int, edges: list[np.ndarray] | None, criterion: str = "ratio", candidates: int | None = None) -> DataFrame:
    """(node, fi, threshold, score, n_left, n_right, left, right) of all cuts of cells (node, fi, v, y), summed bin by bin if there are ``edges``."""
    counts = splits.counted(cells, classes)
    if edges is not None:
        of = F.array(*[literal_array(e.tolist()) for e in edges])[F.col("fi")]
        counts = counts.withColumn("b", F.size(F.filter(of, lambda e: e < F.col("v"))))
    return splits.split_scores(counts, classes, criterion, candidates, binned=edges is not None)


def prune_stats(tree: Tree, validation: DataFrame) -> DataFrame:
    """(node, n, as_subtree, as_leaf) for the nodes that validation rows pass: how many are right either way."""
    leaf = tree.leaf_of(F.col("x"))
    label = F.map_from_arrays(literal_array(list(tree.nodes), "int"), literal_array([n.label for n in tree.nodes.values()], "int"))
    path = F.transform(F.sequence(F.lit(0), F.lit(max(tree.nodes).bit_length() - 1)), lambda up: F.floor(F.col("leaf") / F.pow(F.lit(2.0), up)).cast("int"))
    passed = validation.withColumn("leaf", leaf).select("y", "leaf", F.explode(F.filter(path, lambda i: i > 0)).alias("node"))
    return passed.groupBy("node").agg(
        F.count("*").alias("n"), F.count_if(label[F.col("leaf")] == F.col("y")).alias("as_subtree"), F.count_if(label[F.col("node")] == F.col("y")).alias("as_leaf")
    )


def prune(tree: Tree, validation: DataFrame) -> Tree:
    """Reduced-error pruning, top down: a node becomes a leaf if validation accuracy doesn't drop.

    A node that no validation row passes is left as it is. A new leaf holds its validation counts.
    """
    stats = {r.node: r for r in prune_stats(tree, validation).collect()}  # a row per node
    per_class = {}
    leaf = tree.leaf_of(F.col("x"))
    for r in validation.groupBy(leaf.alias("leaf"), "y").agg(F.count("*").alias("n")).collect():  # leaves times classes
        at = r.leaf
        while at:
            per_class.setdefault(at, [0.0] * tree.classes)[r.y] += float(r.n)
            at //= 2
    out = Tree(tree.classes)

    def copy(i: int) -> None:
        n = tree.nodes[i]
        s = stats.get(i)
        if n.feature is not None and s is not None and s.as_leaf >= s.as_subtree:
            out.nodes[i] = Node(per_class[i])
            return
        out.nodes[i] = Node(list(n.counts), n.feature, n.threshold, n.ratio)
        if n.feature is not None:
            copy(2 * i)
            copy(2 * i + 1)

    copy(1)
    return out


def predict(rows: DataFrame, tree: Tree) -> DataFrame:
    """(row_id, y, leaf, pred, proba); proba are the leaf's class shares."""
    out = predict_all(rows.withColumn("tree", F.lit(0)), [tree])
    return out.select("row_id", "y", F.col("node").cast("int").alias("leaf"), "pred", "proba")


def predict_all(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """``rows`` (row_id, tree, y, x) with node, pred and proba by the tree that each row names."""
    walk = Walk(trees)
    nodes = [trees[k // ROOM].nodes[k % ROOM] for k in walk.keys]
    labels = literal_array([n.label for n in nodes], "int")
    shares = literal_array([c / max(1.0, sum(n.counts)) for n in nodes for c in n.counts])
    out = rows.withColumn("__at", walk.place(F.col("x"), F.col("tree")))
    proba = F.slice(shares, F.col("__at") * trees[0].classes + 1, F.lit(trees[0].classes))
    node = literal_array(walk.keys, "long")[F.col("__at")] % ROOM
    return out.withColumns({"node": node, "pred": labels[F.col("__at")], "proba": proba}).drop("__at")


def importance(rows: DataFrame, classes: int, features: int, max_depth: int = 6) -> list[float]:
    """Share of the rows of all splits by feature: an entropy-gain tree of 20 lowest thresholds per feature."""
    tree = grow(rows, classes, features, max_depth, min_score=0.001, criterion="gain", candidates=20)
    found = [0.0] * features
    for n in tree.nodes.values():
        if n.feature is not None:
            found[n.feature] += sum(n.counts)
    whole = sum(found)
    return [v / whole if whole else 0.0 for v in found]
