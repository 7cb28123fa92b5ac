"""Neighbours by cells around pivots equal brute force and compare far fewer pairs."""

import numpy as np
import pytest

from tabmine.operators import knn, pivots


def points(spark, x, y):
    rows = [(i, [float(v) for v in r], int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y int, fold int").repartition(3)


def brute(x, y, k, metric, queries, apart=False):
    out = set()
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) if metric == "euclidean" else np.abs(x - x[i]).sum(axis=1)
        near = sorted((round(v, 9), j) for j, v in enumerate(d) if not apart or j % 3 != i % 3)[:k]
        out |= {(i, r + 1, j, int(y[j])) for r, (_, j) in enumerate(near)}
    return out


@pytest.fixture(scope="module")
def clusters():
    """Twenty clusters, a third of all rows one repeated point, and a grid with many equal distances."""
    rng = np.random.default_rng(2)
    spread = rng.uniform(-50, 50, size=(20, 3))[rng.integers(0, 20, 500)] + rng.normal(size=(500, 3))
    x = np.vstack([spread, np.tile([[3.0, 3.0, 3.0]], (300, 1)), rng.integers(0, 3, size=(100, 3))])
    return x, rng.integers(0, 4, len(x))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_equal_to_brute_force(spark, clusters, metric):
    x, y = clusters
    rows = points(spark, x, y)
    some = range(0, len(x), 7)
    found, seen = pivots.neighbors(rows.filter("row_id % 7 = 0"), rows, 4, metric, size=90)
    assert {(r.qid, r["rank"], r.tid, r.y) for r in found.collect()} == brute(x, y, 4, metric, some)
    assert seen.all_rows == len(some) * len(x) and seen.rows < 0.4 * seen.all_rows and seen.blocks > 0


def test_groups_and_few_rows(spark, clusters):
    x, y = clusters[0][450:560], clusters[1][450:560]
    rows = points(spark, x, y)
    found = knn.neighbors(rows, rows, 3, group="fold", size=25, most=10)
    assert {(r.qid, r["rank"], r.tid, r.y) for r in found.collect()} == brute(x, y, 3, "euclidean", range(len(x)), True)
    few, seen = pivots.neighbors(rows.limit(5), rows.filter("row_id < 2"), 4)
    assert few.count() == 10 and seen.rows == 10
    assert pivots.neighbors(rows, rows.limit(0))[0].count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("grouped", [False, True])
def test_routes_by_beacons_are_those_of_all_pivots(clusters, metric, grouped):
    x = clusters[0]
    centres = np.unique(x[::8], axis=0)
    d = pivots.distances(x, centres, metric)
    beacons = pivots.beacons_of(centres)
    assert len(beacons) < len(centres)
    home, least, _, _ = pivots.homes(x, centres, beacons, metric)
    assert (home == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    count = lambda rows: np.bincount(home[rows], minlength=len(centres))
    near, far = np.full(len(centres), np.inf), np.zeros(len(centres))
    np.minimum.at(near, home, least)
    np.maximum.at(far, home, least)
    fold = np.arange(len(x)) % 3
    cells = pivots.Cells(centres, metric, count(slice(None)), near, far, {g: count(fold == g) for g in range(3)} if grouped else {})
    limit = np.random.default_rng(3).uniform(0, 20, len(x))
    limit[::50] = np.inf
    for bound in (None, limit):
        group = fold if grouped else None
        want = np.nonzero(cells.reached(x, group, 4, bound))
        got = cells.routes(x, group, 4, bound)
        assert sorted(zip(*got, strict=True)) == list(zip(*want, strict=True))
