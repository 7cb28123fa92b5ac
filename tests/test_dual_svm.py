"""Kernel machines in the dual against a plain solver on small data, and on held-out rows."""

import numpy as np
import pytest

from tabmine.operators import dual_svm, svm


def _solve(k, s, c, steps=20_000):
    """One pair's alphas by cyclic coordinate ascent, to convergence."""
    q, a = (k + 1) * s[:, None] * s[None, :], np.zeros(len(s))
    slope = np.ones(len(s))
    for step in range(steps):
        i = step % len(s)
        d = min(max(a[i] + slope[i] / q[i, i], 0.0), c) - a[i]
        a[i] += d
        slope -= d * q[i]
    return a


def _data(n=90, seed=3):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 3, n)
    x = draw.normal(0, 1.0, (n, 4)) + np.array([[0, 0, 0, 0], [2, 1, 0, 0], [-1, 2, 1, 0]])[y]
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = _data()
    return spark.createDataFrame([(f"r{k}", v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "row_id string, x array<double>, y int")


@pytest.mark.parametrize(("kernel", "working", "block_rows"), [("linear", 40, 30), ("rbf", 40, 20), ("poly", 600, 200)])
def test_alphas_and_decisions_reach_the_optimum(rows, kernel, working, block_rows):
    x, y = _data()
    machine = dual_svm.train(rows, [0, 1, 2], kernel, 0.3, 1.0, 2, 1.0, 1e-4, 40, working, block_rows)
    assert machine.gap.max() <= 1e-4
    got = {r.row_id: np.array(r.decision) for r in machine.decide(rows).collect()}
    value = dual_svm.kernel_of(kernel, 0.3, 1.0, 2)
    for p, (a, b) in enumerate(machine.pairs):
        own = np.flatnonzero((y == a) | (y == b))
        s = np.where(y[own] == a, 1.0, -1.0)
        alpha = _solve(value(x[own], x[own]), s, 1.0)
        want = (value(x, x[own]) + 1) @ (alpha * s)
        assert np.abs(np.array([got[f"r{k}"][p] for k in range(len(x))]) - want).max() < 0.05
        dual = lambda v: v.sum() - 0.5 * (v * s) @ (value(x[own], x[own]) + 1) @ (v * s)  # noqa: B023, E731
        mine = {r.sv_id: r.alpha[p] for r in machine.vectors.collect()}
        learned = np.array([mine.get(f"r{k}", 0.0) for k in own])
        assert dual(learned) >= dual(alpha) * (1 - 2e-4) and learned.min() >= 0 and learned.max() <= 1
        assert machine.intercept[p] == pytest.approx((learned * s).sum(), abs=1e-6)


def test_many_support_vectors_meet_rows_in_blocks(rows):
    machine = dual_svm.train(rows, [0, 1, 2], "rbf", 0.3)
    key = lambda out: sorted((r.row_id, r.pred, tuple(np.round(r.decision, 9))) for r in out.collect())
    assert key(machine.predict(rows)) == key(machine.predict(rows, most=3))


def test_decision_over_broadcast_and_blocks(spark, rows):
    vectors = rows.limit(20).selectExpr("row_id as sv_id", "x as v", "y - 0.5D as coef")
    key = lambda out: {r.row_id: round(r.decision, 9) for r in out.collect()}
    assert key(svm.decision(rows, vectors, 0.5, 0.1)) == key(svm.decision(rows, vectors, 0.5, 0.1, most=3))


def test_held_out_rows_and_missing_classes(spark, rows):
    x, y = _data(60, 8)
    new = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "row_id int, x array<double>, y int")
    for kernel in ("linear", "rbf", "poly"):
        out = dual_svm.train(rows, [0, 1, 2], kernel, 0.3, degree=2).predict(new).collect()
        assert np.mean([r.pred == r.y for r in out]) > 0.75
    machine = dual_svm.train(rows.filter("y < 2"), [0, 1, 2, 7], "rbf", 0.3)
    assert {r.pred for r in machine.predict(new).collect()} <= {0, 1, 2} and machine.gap.max() <= 1e-3
    empty = dual_svm.train(rows.limit(0), [0, 1], "rbf")
    assert empty.vectors.count() == 0 and {r.pred for r in empty.predict(new).collect()} == {0}
    with pytest.raises(ValueError, match="kernel"):
        dual_svm.train(rows, [0, 1], "sigmoid")


@pytest.mark.parametrize(("kernel", "working", "block_rows"), [("linear", 40, 30), ("rbf", 40, 20)])
def test_working_sets_and_whole_pairs_say_the_same(rows, kernel, working, block_rows):
    key = lambda machine: np.array([r.decision for r in sorted(machine.decide(rows).collect())])
    sets = dual_svm.train(rows, [0, 1, 2], kernel, 0.3, 1.0, 2, 1.0, 1e-5, 60, working, block_rows, alone=0)
    whole = dual_svm.train(rows, [0, 1, 2], kernel, 0.3, 1.0, 2, 1.0, 1e-5, alone=500)
    assert whole.rounds == 1 and sets.rounds > 1 and max(whole.gap.max(), sets.gap.max()) <= 1e-5
    assert np.abs(key(sets) - key(whole)).max() < 0.02


def test_many_support_vectors_of_a_polynomial():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 64))
    x, s = x / np.linalg.norm(x, axis=1)[:, None], draw.choice([-1.0, 1.0], 900)
    value = dual_svm.kernel_of("poly", 1.0, 1.0, 3)
    assert np.allclose(value(x, x[:5]), (x @ x[:5].T + 1) ** 3)
    for size in (2000, 300):
        alpha, number, (asum, quad, hinge) = dual_svm.sweeps(x, s, value, 1.0, 1e-3, 100, size)
        assert number == 1 if size > 900 else number < 40
        q = (value(x, x) + 1) * s[:, None] * s[None, :]
        assert quad == pytest.approx(alpha @ q @ alpha) and hinge == pytest.approx(np.maximum(1 - q @ alpha, 0).sum())
        assert quad / 2 + hinge - (asum - quad / 2) <= 1e-3 * (quad / 2 + hinge) and (alpha > 0).mean() > 0.5
