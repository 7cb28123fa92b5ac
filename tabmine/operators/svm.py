"""Support vector machines: one-versus-one linear SVMs by distributed subgradient steps, kernels by features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmine.functions import columns as C
from tabmine.operators.batches import block_pairs, scored, summed


def gamma(rows: DataFrame, how: str = "scale") -> DataFrame:
    """One row (d, var, gamma): 1 / (d var + 1e-10) over all cells, or 1 / d."""
    cells = rows.select(F.size("x").alias("d"), F.explode("x").alias("v"))
    one = cells.agg(F.max("d").alias("d"), F.var_pop("v").alias("var"))
    return one.withColumn("gamma", 1.0 / (F.col("d") * F.col("var") + 1e-10) if how == "scale" else 1.0 / F.col("d"))


def scale_gamma(rows: DataFrame) -> float:
    return gamma(rows).first().gamma


def hinge_gradient(x: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int]], w: np.ndarray, c: float) -> np.ndarray:
    """Per pair the loss and the gradient of C times the hinge sum, for weights w (pairs x (d + 1))."""
    out = np.zeros((len(pairs), w.shape[1] + 1))
    ones = np.hstack([x, np.ones((len(x), 1))])
    for k, (a, b) in enumerate(pairs):
        sign = np.where(y == a, 1.0, np.where(y == b, -1.0, 0.0))
        margin = sign * (ones @ w[k])
        hit = (sign != 0) & (margin < 1)
        out[k, 0] = c * (1 - margin[hit]).sum()
        out[k, 1:] = -c * (sign[hit] @ ones[hit])
    return out.ravel()


def kernel_features(rows: DataFrame, kernel: str = "linear", gamma: float | None = None, coef0: float = 1.0, degree: int = 3, size: int = 256, seed: int = 42) -> DataFrame:
    """``rows`` with x replaced by features whose dot products are the kernel (linear) or approach it (rbf, poly).

    ``gamma`` None is 1 / (d var), from all rows: give it when rows of another table must get the same features.
    """
    if kernel == "linear":
        return rows
    g = scale_gamma(rows) if gamma is None else gamma
    return fourier_features(rows, g, size, seed) if kernel == "rbf" else polynomial_features(rows, g, coef0, degree, size, seed)


@dataclass
class OneVsOne:
    """A linear decision w x + b per pair of classes, the first of the pair being the positive side."""

    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with pred by majority of the pairs' votes; ties go to the lowest class."""
        classes = sorted({c for p in self.pairs for c in p})
        pairs, w = self.pairs, self.weights

        def votes(x: np.ndarray) -> np.ndarray:
            z = np.hstack([x, np.ones((len(x), 1))]) @ w.T
            count = np.zeros((len(x), len(classes)))
            for k, (a, b) in enumerate(pairs):
                first = z[:, k] >= 0
                count[first, classes.index(a)] += 1
                count[~first, classes.index(b)] += 1
            return count

        out = scored(rows, votes, "votes")
        return out.withColumn("pred", F.array(*[F.lit(c) for c in classes])[C.argmax(F.col("votes"))])


    def predict_mapped(self, mapped) -> Callable[[DataFrame], DataFrame]:
        """A function that predicts rows after ``mapped``, the feature map the machine was trained on."""
        return lambda rows: self.predict(mapped(rows))


def train(rows: DataFrame, classes: list[int], c: float = 1.0, steps: int = 60, rate: float = 1.0) -> OneVsOne:
    """All pairs share each pass over the rows; the step is a subgradient of |w|^2 / 2 + C sum hinge, averaged."""
    rows = rows.select("x", "y").persist()
    pairs = list(combinations(sorted(classes), 2))
    d = len(rows.first().x)
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row per class
    n = np.array([max(1, sizes.get(a, 0) + sizes.get(b, 0)) for a, b in pairs], dtype=float)[:, None]
    w = np.zeros((len(pairs), d + 1))
    mean = np.zeros_like(w)
    for t in range(1, steps + 1):
        now = w.copy()
        g = summed(rows, lambda x, y, now=now: hinge_gradient(x, y, pairs, now, c)).reshape(len(pairs), -1)[:, 1:]
        keep = np.hstack([w[:, :-1], np.zeros((len(pairs), 1))])
        w = w - rate / np.sqrt(t) * (g / n + keep / n)
        if t > steps // 2:
            mean += w
    rows.unpersist()
    return OneVsOne(pairs, mean / max(1, steps - steps // 2))


def _width(rows: DataFrame) -> int:
    first = rows.first()
    return len(first.x) if first else 0


def fourier_features(rows: DataFrame, g: float, size: int = 100, seed: int = 42) -> DataFrame:
    """``rows`` with x replaced by random Fourier features whose dot products approach exp(-g |x - z|^2)."""
    d = _width(rows)
    draw = np.random.default_rng(seed)
    w, b = draw.normal(0.0, np.sqrt(2 * g), (d, size)), draw.uniform(0, 2 * np.pi, size)
    mapped = scored(rows, lambda x: np.sqrt(2.0 / size) * np.cos(x @ w + b), "z")
    return mapped.withColumn("x", F.col("z")).drop("z")


def polynomial_features(rows: DataFrame, g: float, coef0: float = 1.0, degree: int = 3, size: int = 256, seed: int = 42) -> DataFrame:
    """``rows`` with x replaced by a tensor sketch: dot products approach (g x z + coef0) ** degree.

    Each of ``degree`` count sketches adds the coordinates up in ``size`` signed buckets; their circular
    convolution, a product of Fourier transforms, sketches the product of that many dot products.
    """
    d = _width(rows) + 1
    draw = np.random.default_rng(seed)
    at, sign = draw.integers(0, size, (degree, d)), draw.choice([-1.0, 1.0], (degree, d))
    maps = np.zeros((degree, d, size))
    for k in range(degree):
        maps[k, np.arange(d), at[k]] = sign[k]

    def sketch(x: np.ndarray) -> np.ndarray:
        wide = np.hstack([np.sqrt(g) * x, np.full((len(x), 1), np.sqrt(coef0))])
        return np.fft.irfft(np.prod([np.fft.rfft(wide @ m, axis=1) for m in maps], axis=0), n=size, axis=1)

    return scored(rows, sketch, "z").withColumn("x", F.col("z")).drop("z")


def decision(rows: DataFrame, vectors: DataFrame, g: float, intercept: float = 0.0, most: int = 20_000) -> DataFrame:
    """(row_id, y, decision): sum of coef K(v, x) over support vectors (sv_id, v, coef), plus the intercept.

    Up to ``most`` support vectors are one broadcast row; beyond that blocks of them meet blocks of rows.
    """
    if vectors.limit(most + 1).count() <= most:
        model = vectors.agg(F.sort_array(F.collect_list(F.struct("sv_id", "coef", "v"))).alias("sv"))
        terms = F.transform("sv", lambda s: s["coef"] * C.rbf_kernel(F.col("x"), s["v"], F.lit(g)))
        return rows.crossJoin(F.broadcast(model)).select("row_id", "y", (C.total(terms) + intercept).alias("decision"))

    def part(a: dict, b: dict) -> dict:
        far = (a["x"] ** 2).sum(axis=1)[:, None] + (b["x"] ** 2).sum(axis=1)[None, :] - 2 * a["x"] @ b["x"].T
        return {"row_id": a["row_id"], "z": np.exp(-g * np.maximum(far, 0)) @ b["coef"]}

    kind = rows.schema["row_id"].dataType.simpleString()
    right = vectors.select(F.col("sv_id").alias("row_id"), "coef", F.col("v").alias("x"))
    parts = block_pairs(rows.select("row_id", "x"), right, part, f"row_id {kind}, z double", ["row_id", "x"], ["row_id", "coef", "x"], most=0)
    sums = parts.groupBy("row_id").agg((F.sum("z") + intercept).alias("decision"))
    return rows.select("row_id", "y").join(sums, "row_id").select("row_id", "y", "decision")
