"""Perceptrons by local steps: gradients of mini-batches, serial runs, averaged shares, held-out accuracy."""

import numpy as np
import pytest

from tabmine.operators import batches, local_steps, mlp


def _frame(spark, x, y):
    return spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y int")


def _data(n, seed):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 4, n)
    x = draw.normal(0, 1, (n, 6))
    x[:, 0] += np.where(y % 2, 2.0, -2.0) * np.where(y < 2, 1, -1)
    x[:, 1] += np.where(y < 2, 2.0, -2.0)
    return x, y


@pytest.mark.parametrize("optimiser", ["sgd", "momentum", "adam"])
def test_one_share_is_a_serial_run(spark, optimiser):
    x, y = _data(100, 1)
    model = local_steps.train(_frame(spark, x, y), [5], 4, optimiser, 0.05, epochs=4, decay=1e-3)
    opt, draw = mlp.Optimiser(optimiser, 0.05), np.random.default_rng([42, 0, 0])
    weights, losses = mlp.initial([6, 5, 4]), []
    order = np.arange(100)  # rows of a share are in the order of their ids
    for _ in range(4):
        mixed, loss = order[draw.permutation(100)], 0.0
        for k in range(0, 100, 32):
            some = mixed[k : k + 32]
            found = mlp.loss_and_gradient(weights, x[some], y[some], "relu")
            loss += found[1]
            penalty = mlp.flat([(w, np.zeros_like(b)) for w, b in weights])
            weights = mlp.unpack(opt.step(mlp.flat(weights), found[2:] / len(some) + 1e-3 * penalty), weights)
        losses.append(loss / 100)
    assert np.allclose(mlp.flat(model.weights), mlp.flat(weights)) and np.allclose(model.history, losses)


@pytest.mark.parametrize(("optimiser", "rate"), [("sgd", 0.1), ("adam", 0.01)])
def test_averaged_shares_are_as_good_as_a_serial_run(spark, optimiser, rate):
    x, y = _data(1600, 2)
    test = _frame(spark, *_data(800, 3))
    accuracy = []
    for most in (100_000, 300):
        model = local_steps.train(_frame(spark, x, y), [12], 4, optimiser, rate, epochs=20, sync=4, most=most)
        accuracy.append(np.mean([r.pred == r.y for r in model.predict(test).collect()]))
        assert len(model.history) == 20 and model.history[-1] < model.history[0]
    assert accuracy[0] > 0.9 and accuracy[1] > accuracy[0] - 0.01


def test_odd_inputs_and_sums_in_levels(spark):
    x, y = _data(3, 4)
    with pytest.raises(ValueError, match="no rows"):
        local_steps.train(_frame(spark, x, y).limit(0), [3], 4, epochs=2)
    twice = _frame(spark, x, y).unionByName(_frame(spark, x, y))
    assert len(local_steps.train(twice, [3], 4, epochs=2, batch=1, most=2).history) == 2
    parts = spark.range(0, 300, 1, 100).selectExpr("array(double(id), 1D) as s")
    assert batches.added_up(parts).tolist() == [44850.0, 300.0]
    assert batches.added_up(parts.limit(0)).tolist() == []
