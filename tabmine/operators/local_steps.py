"""Multilayer perceptrons by local steps: mini-batches inside tasks, weights averaged every few epochs.

Rows are dealt into shares of bounded size. In a round each share's task starts from the same weights, takes its
own mini-batch steps over some epochs, and hands its weights and optimiser moments back; their averages, weighted by
rows, start the next round. A round is one job, so the number of jobs depends on epochs / ``sync`` and not on
the number of batches. With one share the steps are those of a serial run, and all epochs are one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmine.operators import mlp
from tabmine.operators.batches import added_up, matrix
from tabmine.sources.files import stored


def shares(rows: DataFrame, most: int = 16_384) -> tuple[DataFrame, int]:
    """(share, x, y as bytes): one row for about ``most`` rows, dealt out by a hash of the id, and how many there are."""
    n = max(1, -(-rows.count() // most))
    key = F.pmod(F.xxhash64("row_id"), F.lit(n)).alias("share")
    dealt = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row_id", "y", "x"))).alias("r"))
    dealt = dealt.select("share", F.col("r.x").alias("x"), F.col("r.y").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = matrix(batch.column(1).slice(k, 1).flatten()), batch.column(2).slice(k, 1).flatten().to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([x.tobytes()]), pa.array([y.tobytes()])], names=["share", "x", "y"])

    return stored(dealt.mapInArrow(pack, "share long, x binary, y binary"), "shares"), n


def steps(x: np.ndarray, y: np.ndarray, weights: mlp.Weights, opt: mlp.Optimiser, activation: str, batch: int, epochs: int, decay: float, draw: np.random.Generator) -> tuple[mlp.Weights, list[float]]:
    """Weights after some epochs of shuffled mini-batches, and each epoch's mean loss before its steps."""
    vector, losses = mlp.flat(weights), []
    kept = mlp.flat([(np.ones_like(w), np.zeros_like(b)) for w, b in weights])  # biases don't decay
    for _ in range(epochs):
        order, loss = draw.permutation(len(y)), 0.0
        for first in range(0, len(y), batch):
            at = order[first : first + batch]
            found = mlp.loss_and_gradient(mlp.unpack(vector, weights), x[at], y[at], activation)
            loss += found[1]
            vector = opt.step(vector, found[2:] / found[0] + decay * kept * vector)
        losses.append(loss / max(1, len(y)))
    return mlp.unpack(vector, weights), losses


def train(
    rows: DataFrame, hidden: list[int], classes: int, optimiser: str = "adam", rate: float = 1e-3, epochs: int = 200, batch: int = 32, sync: int = 5,
    activation: str = "relu", decay: float = 0.0, seed: int = 42, most: int = 16_384,
) -> mlp.Model:
    """A perceptron trained on ``rows`` (row_id, x, y); shares of about ``most`` rows average every ``sync`` epochs.

    The history has the mean loss of each epoch over all rows. No rows are an error, equal ones count each time.
    """
    rows = rows.select("row_id", "x", "y")
    first = rows.first()
    if first is None:
        raise ValueError("no rows to train on")
    weights = mlp.initial([len(first.x), *hidden, classes], activation, seed)
    dealt, n = shares(rows, most)
    sync = epochs if n == 1 else sync
    size, names = len(mlp.flat(weights)), {"sgd": [], "momentum": ["v"], "adam": ["m", "v"]}[optimiser]
    state: dict = {}
    history: list[float] = []
    for done in range(0, epochs, sync):
        now = min(sync, epochs - done)

        def run(batches: Iterator[pa.RecordBatch], weights=weights, state=state, done=done, now=now) -> Iterator[pa.RecordBatch]:
            for batch_ in batches:
                for share, x, y in zip(*(c.to_pylist() for c in batch_.columns), strict=True):
                    y = np.frombuffer(y, dtype=np.int64)
                    opt = mlp.Optimiser(optimiser, rate, state=dict(state))
                    new, losses = steps(np.frombuffer(x).reshape(len(y), -1), y, weights, opt, activation, batch, now, decay, np.random.default_rng([seed, done, share]))
                    moments = [opt.state.get(k, np.zeros(size)) for k in names]
                    out = len(y) * np.concatenate([[1.0, opt.state.get("t", 0)], losses, mlp.flat(new), *moments])
                    yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["s"])

        found = added_up(dealt.mapInArrow(run, "s array<double>"))
        found = found / found[0]
        history += found[2 : 2 + now].tolist()
        parts = np.split(found[2 + now :], 1 + len(names))
        weights = mlp.unpack(parts[0], weights)
        state = dict(zip(names, parts[1:], strict=True)) | ({"t": int(round(found[1]))} if optimiser == "adam" else {})
    return mlp.Model(weights, activation, history)
