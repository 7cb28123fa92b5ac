"""Trees from histograms, from lowest values and from whole small nodes are the same trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmine.operators import splits, tree


def points(spark, x, y, trees=None):
    return spark.createDataFrame(
        [(i, [float(v) for v in r], int(c), int(t)) for i, (r, c, t) in enumerate(zip(x, y, trees if trees is not None else [0] * len(y)))],
        "row_id long, x array<double>, y int, tree int",
    ).repartition(3)


def plain(x, y, classes, depth, criterion, least):
    """A tree by trying every cut, as {node: (feature, threshold)}."""
    def h(c):
        p = c[c > 0] / c.sum()
        return float(-(p * np.log2(p)).sum())

    found, todo = {}, [(1, np.arange(len(y)))]
    while todo:
        node, at = todo.pop()
        if node.bit_length() > depth or len(at) < 2 or len(set(y[at])) < 2:
            continue
        every, best = np.bincount(y[at], minlength=classes), None
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for a, b in zip(values, values[1:]):
                left = np.bincount(y[at][x[at, f] <= a], minlength=classes)
                pl = left.sum() / len(at)
                score = h(every) - pl * h(left) - (1 - pl) * h(every - left)
                if criterion == "ratio":
                    score /= h(np.array([left.sum(), len(at) - left.sum()]))
                if best is None or round(score, 9) > best[0]:
                    best = round(score, 9), f, (a + b) / 2
        if best is None or best[0] < least:
            continue
        found[node] = best[1:]
        go = x[at, best[1]] > best[2]
        todo += [(2 * node, at[~go]), (2 * node + 1, at[go])]
    return found


def shape(grown):
    return {i: (n.feature, n.threshold) for i, n in grown.nodes.items() if n.feature is not None}


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=300), rng.integers(0, 4, 300), np.round(rng.normal(size=300), 1), np.zeros(300)], axis=1)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] > 2) + rng.integers(0, 2, 300) * (rng.random(300) < 0.2)
    return x, y.astype(int)


@pytest.mark.parametrize("criterion", ["ratio", "gain"])
def test_histograms_find_every_best_cut(spark, odd, criterion):
    x, y = odd
    want = plain(x, y, 4, 3, criterion, 1e-5)
    assert len(want) > 5
    for sizes in ({}, {"small": 0, "bins": 8}, {"small": 60, "bins": 5}):
        got = tree.grow(points(spark, x, y), 4, 4, max_depth=3, criterion=criterion, **sizes)
        assert shape(got) == want, sizes
        assert all(sum(n.counts) > 0 for n in got.nodes.values())


def test_lowest_thresholds(spark, odd):
    x, y = odd
    every = [tree.grow(points(spark, x, y), 4, 4, max_depth=3, candidates=3, **s) for s in ({}, {"small": 0})]
    assert shape(every[0]) == shape(every[1]) and shape(every[0])
    assert [n.counts for n in every[0].nodes.values()] == [every[1].nodes[i].counts for i in every[0].nodes]


def test_several_trees(spark, odd):
    x, y = odd
    t = np.arange(300) % 2
    got = tree.grow_all(points(spark, x, y, t), 2, 4, 4, max_depth=3, small=20, bins=6)
    assert [shape(g) for g in got] == [plain(x[t == k], y[t == k], 4, 3, "ratio", 1e-5) for k in range(2)]
    assert tree.grow_all(points(spark, x, y, t).limit(0), 2, 4, 4)[1].nodes.keys() == {1}


def test_few_bins_stay_open(spark):
    """Few bins stay open where one cut is far better than all others."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (x[:, 1] > 0.7).astype(int)
    rows = points(spark, x, y).withColumn("node", F.lit(1).cast("long"))
    edges = splits.bin_edges(rows, 2, 32)
    bins = splits.open_bins(splits.histograms(rows, edges, 2, 32), 2, 1e-5, "gain").filter("open").collect()
    assert len(bins) <= 3 and {r.fi for r in bins} == {1}


def test_cuts_summed_bin_by_bin(spark, odd):
    """Bins given by hand, empty and one-value ones among them, leave the cuts as they are."""
    x, y = odd
    cells = points(spark, x, y).select((F.col("row_id") % 2).alias("node"), "y", F.posexplode("x").alias("fi", "v"))
    bins = [np.array([-9.0, -0.5, 0.0, 0.7, 9.0]), np.array([0.0, 1.0, 2.0]), np.array([0.1]), np.array([])]
    for candidates in (None, 2):
        got = [sorted(tree.split_scores(cells, 3, e, "gain", candidates).collect()) for e in (None, bins)]
        assert got[0] == got[1] and got[0]
