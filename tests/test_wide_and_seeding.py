"""Leading components without a covariance matrix; starting centres by oversampling."""

import numpy as np
import pytest

from tabmine.operators import kmeans, linalg


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "row_id long, x array<double>, y int").repartition(3)


def test_leading_components_are_the_dense_ones(spark):
    x = np.random.default_rng(3).normal(size=(150, 40)) * np.linspace(1, 2, 40) + 5
    rows = points(spark, x)
    want, got = linalg.pca(rows), linalg.leading(rows, 4)
    assert np.allclose(got.variances, want.variances[:4]) and np.allclose(got.ratios, want.ratios[:4])
    assert np.allclose(got.vectors, want.vectors[:4], atol=1e-6) and np.allclose(got.mean, want.mean)


def test_wide_and_poor_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 1200))  # rank 3
    got = linalg.leading(points(spark, x), 3)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3] ** 2 / 59
    assert np.allclose(got.variances, want) and got.ratios.sum() == pytest.approx(1)
    flat = linalg.leading(points(spark, np.ones((5, 4))), 2)
    assert np.allclose(flat.variances, 0)
    with pytest.raises(ValueError):
        linalg.leading(points(spark, np.zeros((0, 2))), 1)


def test_oversampled_starts(spark):
    rng = np.random.default_rng(6)
    middles = rng.uniform(-100, 100, size=(6, 2))
    x = np.vstack([m + rng.normal(size=(30, 2)) for m in middles] + [np.tile(middles[0], (100, 1))])
    rows = points(spark, x)
    runs = kmeans.oversampled(rows, 6, [1, 2, 3])
    assert [len(r) for r in runs] == [6, 6, 6]
    assert runs == kmeans.oversampled(rows, 6, [1, 2, 3])
    centres, inertia = kmeans.fit(rows, runs)
    near = np.sqrt(((np.array(centres)[:, None] - middles[None]) ** 2).sum(-1)).min(axis=0)
    assert near.max() < 1.5 and inertia < 3 * len(x)
    few = kmeans.oversampled(points(spark, [[0.0], [0.0], [1.0]]), 5, [1])
    assert sorted(c[0] for c in few[0]) == [0.0, 1.0]
    assert kmeans.oversampled(points(spark, np.zeros((0, 1))), 3, [1, 2]) == [[], []]
