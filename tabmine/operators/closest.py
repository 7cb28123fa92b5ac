"""The nearest rows of one block to those of another: rough distances of all pairs, exact ones of those that may count."""

from __future__ import annotations

import numpy as np

#: Rows of a tile, so that rough distances stay in a core's cache.
TILES = {"euclidean": (512, 2048), "manhattan": (64, 1024)}


def _rough(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances, or squared ones less a row's own square, in the numbers' own precision."""
    if metric == "euclidean":
        out = a @ (-2 * b.T)
        out += (b * b).sum(axis=1)
        return out
    out, diff, columns = np.zeros((len(a), len(b)), a.dtype), np.empty((len(a), len(b)), a.dtype), np.ascontiguousarray(b.T)
    for j in range(a.shape[1]):
        np.subtract(columns[j][None, :], a[:, j, None], out=diff)
        np.abs(diff, out=diff)
        out += diff
    return out


def closest(
    q: dict, t: dict, k: int, metric: str = "euclidean", group: str | None = None, limit: np.ndarray | None = None, rows_at_once: int = 1 << 16
) -> dict:
    """qid, tid, y and dist of the k rows of ``t`` nearest to each of ``q``; distances equal to 9 digits are ties, by id.

    ``group`` names a column in which the two have to differ, ``limit`` has the largest distance that counts for each
    row of ``q``. All pairs are screened in single precision; those that its errors let be among the nearest so far, a
    few of a row in each tile, are compared in full by direct differences, so results are those of comparing all so.
    """
    x, y = np.asarray(q["x"], float), np.asarray(t["x"], float)
    if not len(x) or not len(y):
        x, y = np.zeros((len(x), 1)), np.zeros((len(y), 1))
    middle = y.mean(axis=0) if len(y) else 0.0
    a, b = x - middle, y - middle
    size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    kind = np.float32 if 1e-15 < size < 1e15 else np.float64
    norm = (lambda v: (v * v).sum(axis=1)) if metric == "euclidean" else (lambda v: np.abs(v).sum(axis=1))
    own, far = norm(a), norm(b)
    slack = 4 * np.finfo(kind).eps * (x.shape[1] + 8) * (own + far.max(initial=0))
    a, b = a.astype(kind), b.astype(kind)
    top = np.full(len(x), np.inf) if limit is None else limit + 1e-8 * (1 + limit)
    step_q, step_t = TILES[metric]
    out = []
    for i in range(0, len(x), step_q):
        part = slice(i, min(i + step_q, len(x)))
        bound, best = top[part].copy(), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, place in t, distance
        for j in range(0, len(y), step_t):
            rough = _rough(a[part], b[j : j + step_t], metric)
            if group:
                rough[q[group][part][:, None] == t[group][None, j : j + step_t]] = np.inf
            edge = (bound * bound - own[part] if metric == "euclidean" else bound) + slack[part]
            if (loose := np.isinf(edge)).any() and rough.shape[1] > k:  # a few columns tell how near k rows are at least
                some = np.partition(rough[loose, : max(1024, 8 * k)], min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
                edge[loose] = some + 2 * slack[part][loose] + 1e-8 * (1 + np.abs(some))
            rows, cols = np.nonzero(rough <= edge[:, None].astype(np.float64) if kind is np.float64 else rough <= np.nextafter(edge.astype(kind), np.float32(np.inf))[:, None])
            if group and len(rows):
                keep = q[group][i + rows] != t[group][j + cols]
                rows, cols = rows[keep], cols[keep]
            d = np.empty(len(rows))
            for s in range(0, len(rows), rows_at_once):
                diff = x[i + rows[s : s + rows_at_once]] - y[j + cols[s : s + rows_at_once]]
                d[s : s + rows_at_once] = np.sqrt((diff * diff).sum(axis=1)) if metric == "euclidean" else np.abs(diff).sum(axis=1)
            if limit is not None:
                keep = d <= top[part][rows]
                rows, cols, d = rows[keep], cols[keep], d[keep]
            if not len(rows):
                continue
            row, at, d = (np.concatenate(v) for v in zip(best, (rows, j + cols, d), strict=True))
            order = np.lexsort((t["row_id"][at], np.round(d, 9), row))
            row, at, d = row[order], at[order], d[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = [v[rank < k] for v in (row, at, d)]
            last = rank == k - 1
            bound[row[last]] = np.minimum(bound[row[last]], d[last] + 1e-8 * (1 + d[last]))
        out.append((i + best[0], best[1], best[2]))
    row, at, d = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return {"qid": q["row_id"][row], "tid": t["row_id"][at], "y": t["y"][at].astype(np.int32), "dist": d}
