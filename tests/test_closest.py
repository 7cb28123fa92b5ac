"""Nearest rows by screening in single precision equal those of comparing all pairs in full."""

import numpy as np
import pytest

from tabmine.operators import knn, pivots
from tabmine.operators.batches import distances
from tabmine.operators.closest import closest

draw = np.random.default_rng(7)
CASES = {
    "grid": draw.integers(0, 3, (240, 3)).astype(float),
    "wide": draw.normal(size=(240, 20)),
    "far off": draw.normal(size=(240, 5)) + 1e6,
    "copies": np.repeat(draw.normal(size=(6, 4)), 40, axis=0),
    "tiny": draw.normal(size=(90, 4)) * 1e-20,
    "huge": draw.normal(size=(90, 4)) * 1e20,
    "few": draw.normal(size=(3, 2)),
}


def block(x, low, seed):
    rng = np.random.default_rng(seed)
    return {"x": x, "row_id": rng.permutation(len(x)) + low, "y": rng.integers(0, 5, len(x)), "g": rng.integers(0, 3, len(x))}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize(("group", "limited"), [(None, False), ("g", False), (None, True), ("g", True)])
def test_equal_to_all_pairs(case, metric, group, limited):
    q, t = block(CASES[case][::3], 0, 1), block(CASES[case], 1000, 2)
    limit = np.random.default_rng(3).uniform(0, 2, len(q["x"])) if limited else None
    got = closest(q, t, 5, metric, group, limit)
    d, want = distances(q["x"], t["x"], metric), set()
    for i in range(len(d)):
        on = [j for j in range(len(t["x"])) if (not group or q["g"][i] != t["g"][j]) and (not limited or d[i, j] <= limit[i])]
        want |= {(q["row_id"][i], b) for _, b in sorted((round(d[i, j], 9), t["row_id"][j]) for j in on)[:5]}
    assert set(zip(got["qid"].tolist(), got["tid"].tolist(), strict=True)) == want


def test_unlike_rows_meet_in_blocks_and_like_ones_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    wide = rng.normal(size=(400, 30))
    near = rng.uniform(-100, 100, size=(20, 2))[rng.integers(0, 20, 400)] + rng.normal(size=(400, 2))
    called = []
    real = pivots.neighbors
    monkeypatch.setattr(pivots, "neighbors", lambda *a: called.append(1) or real(*a))
    for x, by_cells in ((wide, False), (near, True)):
        rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "row_id long, x array<double>, y int")
        called.clear()
        found = {(r.qid, r["rank"], r.tid) for r in knn.neighbors(rows, rows, 3, size=90, most=100).collect()}
        assert bool(called) == by_cells
        d = distances(x, x, "euclidean")
        assert found == {(i, r + 1, j) for i in range(len(x)) for r, (_, j) in enumerate(sorted((round(v, 9), j) for j, v in enumerate(d[i]))[:3])}
