"""Moments of many columns as one Gram matrix per task, and PCA."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmine.functions.columns import dot
from tabmine.operators.batches import array_of, summed


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sum of centred outer products) in two passes: means first, so that digits aren't lost."""
    first = summed(rows, lambda x, _: np.append(x.sum(axis=0), float(len(x))))
    if not len(first):
        raise ValueError("no rows")
    n, mean = int(first[-1]), first[:-1] / first[-1]
    gram = summed(rows, lambda x, _: ((x - mean).T @ (x - mean)).ravel()).reshape(len(mean), -1)
    return n, mean, gram


def correlation(rows: DataFrame) -> np.ndarray:
    """Pearson r of all pairs of a wide frame; NaN where a feature has no spread, as it is null in the profile."""
    _, _, gram = moments(rows)
    sd = np.sqrt(np.diag(gram))
    scale = np.outer(sd, sd)
    return np.divide(gram, scale, out=np.full_like(gram, np.nan), where=scale > 0)


@dataclass
class Pca:
    mean: np.ndarray
    vectors: np.ndarray  # a row per component
    variances: np.ndarray
    ratios: np.ndarray

    def explained(self) -> list[tuple[int, float, float, float]]:
        """(component, variance, ratio, cumulative ratio)."""
        run = np.cumsum(self.ratios)
        return [(k + 1, float(v), float(r), float(c)) for k, (v, r, c) in enumerate(zip(self.variances, self.ratios, run, strict=True))]

    def transform(self, rows: DataFrame, k: int) -> DataFrame:
        """``rows`` with pc1 ... pck of the centred vectors."""
        centred = F.zip_with("x", array_of(self.mean.tolist()), lambda v, m: v - m)
        return rows.withColumns({f"pc{j + 1}": dot(centred, array_of(self.vectors[j].tolist())) for j in range(k)})


def pca(rows: DataFrame) -> Pca:
    """Sample covariance, eigenvectors by falling variance; each one's largest loading is positive."""
    n, mean, gram = moments(rows)
    values, vectors = np.linalg.eigh(gram / max(1, n - 1))
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    top = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.where(vectors[np.arange(len(vectors)), top] < 0, -1.0, 1.0)[:, None]
    whole = values.sum()
    return Pca(mean, vectors, values, values / whole if whole else values)


def leading(rows: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-9, seed: int = 0) -> Pca:
    """The first ``k`` components of ``pca`` for wide vectors: no covariance matrix is made anywhere.

    Block Krylov steps from a random start: a round is one job that multiplies the covariance by k + 10 vectors, so a task
    returns d x (k + 10) numbers, and the driver holds the basis so far. Done when no component's residual
    exceeds ``tolerance`` of the largest variance; an error after ``rounds``. Ratios are of the whole variance.
    """
    first = summed(rows, lambda x, _: np.append(x.sum(axis=0), float(len(x))))
    if not len(first):
        raise ValueError("no rows")
    n, mean = int(first[-1]), first[:-1] / first[-1]
    d = len(mean)
    k = min(k, d)
    start = np.random.default_rng(seed).normal(size=(d, min(d, k + 10)))
    new, basis, images = np.linalg.qr(start)[0], np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(rounds):

        def product(x: np.ndarray, _y: np.ndarray, q: np.ndarray = new) -> np.ndarray:
            out, spread = np.zeros(q.shape), 0.0
            step = max(1, (1 << 21) // d)
            for at in range(0, len(x), step):
                part = x[at : at + step] - mean
                out += part.T @ (part @ q)
                spread += float((part * part).sum())
            return np.append(out.ravel(), spread)

        found = summed(rows, product) / max(1, n - 1)
        image, whole = found[:-1].reshape(new.shape), found[-1]
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        off = np.linalg.norm(images @ turn - vectors * values, axis=0)
        for _again in range(2):  # twice, so that the basis stays orthogonal
            image = image - basis @ (basis.T @ image)
        u, size, _ = np.linalg.svd(image, full_matrices=False)
        new = u[:, size > 1e-12 * max(values[0], 1e-300)][:, : d - basis.shape[1]]
        if off.max() <= tolerance * max(values[0], 0.0) or not new.shape[1]:
            break
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    else:
        raise RuntimeError(f"components are not found to {tolerance} in {rounds} rounds")
    vectors, values = vectors.T, np.maximum(values, 0.0)
    top = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.where(vectors[np.arange(k), top] < 0, -1.0, 1.0)[:, None]
    return Pca(mean, vectors, values, values / whole if whole else values)
