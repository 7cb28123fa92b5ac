"""Multilayer perceptron: synchronous data-parallel steps, gradients summed over tasks, small weights on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmine.functions.columns import argmax
from tabmine.operators.batches import scored, summed

Weights = list[tuple[np.ndarray, np.ndarray]]


def _act(name: str, z: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(z, 0)
    return np.tanh(z) if name == "tanh" else 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _slope(name: str, z: np.ndarray) -> np.ndarray:
    a = _act(name, z)
    return (z > 0).astype(float) if name == "relu" else 1 - a * a if name == "tanh" else a * (1 - a)


def forward(weights: Weights, x: np.ndarray, activation: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Inputs and sums of each layer, and the class probabilities."""
    inputs, sums, a = [], [], x
    for k, (w, b) in enumerate(weights):
        inputs.append(a)
        sums.append(a @ w + b)
        a = _act(activation, sums[-1]) if k < len(weights) - 1 else sums[-1]
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return inputs, sums, e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(weights: Weights, x: np.ndarray, y: np.ndarray, activation: str) -> np.ndarray:
    """Rows, summed cross-entropy and the gradient of that sum, as one vector."""
    inputs, sums, p = forward(weights, x, activation)
    rows = np.arange(len(x))
    loss = -np.log(p[rows, y] + 1e-15).sum()
    back = p.copy()
    back[rows, y] -= 1
    parts: list[np.ndarray] = []
    for k in range(len(weights) - 1, -1, -1):
        parts = [(inputs[k].T @ back).ravel(), back.sum(axis=0), *parts]
        if k:
            back = (back @ weights[k][0].T) * _slope(activation, sums[k - 1])
    return np.concatenate([[float(len(x)), loss], *parts])


def initial(sizes: list[int], activation: str = "relu", seed: int = 42) -> Weights:
    """Variance 2 / inputs for relu, 1 / inputs otherwise; biases 0."""
    draw, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        scale = np.sqrt((2.0 if activation == "relu" else 1.0) / a)
        out.append((draw.normal(0.0, scale, (a, b)), np.zeros(b)))
    return out


def waves(sizes: list[int]) -> Weights:
    """Deterministic weights (sines of the place) for checks."""
    return [(np.sin(np.arange(a * b, dtype=float) + 1 + k).reshape(a, b), np.cos(np.arange(b, dtype=float) + k)) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]


def unpack(vector: np.ndarray, weights: Weights) -> Weights:
    out, at = [], 0
    for w, b in weights:
        out.append((vector[at : at + w.size].reshape(w.shape), vector[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for pair in weights for v in pair])


@dataclass
class Optimiser:
    """sgd, momentum or adam (bias-corrected) on one flat vector."""

    name: str = "adam"
    rate: float = 1e-3
    momentum: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.999
    state: dict = field(default_factory=dict)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        s = self.state
        if self.name == "sgd":
            return w - self.rate * g
        if self.name == "momentum":
            s["v"] = self.momentum * s.get("v", 0.0) - self.rate * g
            return w + s["v"]
        s["t"] = s.get("t", 0) + 1
        s["m"] = self.beta1 * s.get("m", 0.0) + (1 - self.beta1) * g
        s["v"] = self.beta2 * s.get("v", 0.0) + (1 - self.beta2) * g * g
        m, v = s["m"] / (1 - self.beta1 ** s["t"]), s["v"] / (1 - self.beta2 ** s["t"])
        return w - self.rate * m / (np.sqrt(v) + 1e-8)


@dataclass
class Model:
    weights: Weights
    activation: str
    history: list[float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with proba and pred."""
        w, a = self.weights, self.activation
        out = scored(rows, lambda x: forward(w, x, a)[2], "proba")
        return out.withColumn("pred", argmax(F.col("proba")))


def gradient(rows: DataFrame, weights: Weights, activation: str) -> tuple[int, float, np.ndarray]:
    """(rows, mean loss, mean gradient) over all rows, one vector per task."""
    found = summed(rows, lambda x, y: loss_and_gradient(weights, x, y, activation))
    if not len(found):
        return 0, 0.0, np.zeros(len(flat(weights)))
    return int(found[0]), float(found[1] / found[0]), found[2:] / found[0]


def train(
    rows: DataFrame, hidden: list[int], classes: int, optimiser: str = "adam", rate: float = 1e-2, epochs: int = 10, batches: int = 2,
    activation: str = "relu", decay: float = 0.0, seed: int = 42,
) -> Model:
    """Mini-batches are hash buckets of the row id, dealt anew each epoch: few and large, since each is a job.

    The history has the mean loss of each epoch's batches before their steps.
    """
    rows = rows.select("row_id", "x", "y").persist()
    weights = initial([len(rows.first().x), *hidden, classes], activation, seed)
    opt, history = Optimiser(optimiser, rate), []
    for epoch in range(epochs):
        losses = []
        for b in range(batches):
            part = rows if batches == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(seed + epoch), "row_id"), F.lit(batches)) == b)
            n, loss, g = gradient(part, weights, activation)
            if n:
                penalty = flat([(w, np.zeros_like(bias)) for w, bias in weights])
                weights = unpack(opt.step(flat(weights), g + decay * penalty), weights)
                losses.append((n, loss))
        history.append(sum(n * v for n, v in losses) / max(1, sum(n for n, _ in losses)))
    rows.unpersist()
    return Model(weights, activation, history)
