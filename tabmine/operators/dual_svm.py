"""Kernel support vector machines in the dual: working sets solved in a task per pair, alphas kept beside the rows.

Every pair of classes is a machine: maximise sum a - 1/2 sum a_i a_j s_i s_j (K(x_i, x_j) + 1) over 0 <= a <= C, s being
+1 for the first class of the pair and -1 for the second. The 1 added to the kernel is a penalised intercept,
which leaves no constraint between rows. Rows lie in blocks that keep their alphas and decision values. A round
takes, for each pair, the rows of all blocks that break its conditions most, at most ``working`` of them, and
solves for their alphas in one task, the others standing still; all pairs at once. The changed rows, a bounded
number, go to every block, which adds what they change to its decision values. So the dual never falls, and the
gap between primal and dual, which bounds the distance from the optimum, ends the rounds. (Blocks that solve for
all their own rows at the same time and average take hundreds of rounds, since the blocks' changes overlap.)
Where most rows become support vectors, as with polynomials of unlike rows, working sets take very many rounds too. So
pairs of a bounded number of rows are solved whole, a pair in a task: up to ``WHOLE`` rows at once, beyond that by
sweeps over random blocks of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions import columns as C
from tabmine.operators.batches import block_pairs, matrix, scored
from tabmine.sources.files import stored

#: Rows of a pair that are solved for at once.
WHOLE = 2000

_STATE = "block long, ids array<{id}>, x binary, y binary, alpha binary, f binary, sums array<double>"
_WORST = "pair int, violation double, block long, at int, x array<double>, sign double, alpha double, f double"


def kernel_of(name: str = "rbf", gamma: float = 1.0, coef0: float = 1.0, degree: int = 3) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """K(A, B) of two matrices of rows: linear, rbf exp(-gamma |a - b|^2), or poly (gamma a b + coef0) ** degree."""
    if name not in ("linear", "rbf", "poly"):
        raise ValueError(f"no kernel is called {name}")

    def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = a @ b.T
        if name == "linear":
            return dot
        if name == "poly":
            base = gamma * dot + coef0
            return base if degree == 1 else base * base if degree == 2 else base * base * base if degree == 3 else base**degree
        far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * dot
        return np.exp(-gamma * np.maximum(far, 0))

    return value


def signs(y: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Rows by pairs: 1 for the pair's first class, -1 for its second, 0 for others."""
    return np.stack([(y == a).astype(float) - (y == b) for a, b in pairs], axis=1)


def violations(k: np.ndarray, s: np.ndarray, alpha: np.ndarray, f: np.ndarray, c: float) -> np.ndarray:
    """Rows by pairs: how far a row's own best alpha lies from its alpha, as a slope; ``k`` are the kernel's diagonal values plus 1."""
    curve = np.maximum(k, 1e-12)[:, None]
    return np.where(s != 0, np.abs(np.clip(alpha + (1 - s * f) / curve, 0, c) - alpha), 0) * curve


def ascend(q: np.ndarray, slope: np.ndarray, alpha: np.ndarray, c: float, steps: int = 200, tol: float = 1e-6) -> np.ndarray:
    """The alphas that maximise slope (a - alpha) - (a - alpha) q (a - alpha) / 2 within 0 and ``c``.

    Projected Newton steps: alphas that want to leave their interval stay, the others go to their joint optimum
    and are cut off at the ends, at half the way as long as that doesn't help; then a coordinate sweep.
    """
    a, slope, bend = alpha.copy(), slope.copy(), np.maximum(np.diag(q), 1e-12)
    for _ in range(steps):
        far = np.abs(np.clip(a + slope / bend, 0, c) - a) * bend
        if not len(far) or far.max() < tol:
            break
        free = np.flatnonzero(~((a <= 0) & (slope <= 0) | (a >= c) & (slope >= 0)))
        way = np.zeros(len(a))
        own = q[np.ix_(free, free)]
        way[free] = np.linalg.solve(own + np.diag(np.full(len(free), 1e-9 * bend.max())), slope[free])
        for part in 0.5 ** np.arange(12):
            d = np.clip(a + part * way, 0, c) - a
            moved = q @ d
            if slope @ d - d @ moved / 2 > 0:
                a, slope = a + d, slope - moved
                break
        for i in free.tolist():
            new = min(max(a[i] + slope[i] / bend[i], 0.0), c)
            slope -= (new - a[i]) * q[i]
            a[i] = new
    return a


@dataclass
class Machine:
    """A trained machine: its support vectors are a table (sv_id, x, y, alpha), alpha an array of one value per pair."""

    pairs: list[tuple[int, int]]
    vectors: DataFrame
    intercept: np.ndarray
    gap: np.ndarray
    rounds: int
    kernel: tuple[str, float, float, int]

    def decide(self, rows: DataFrame, most: int = 20_000) -> DataFrame:
        """``rows`` with decision, an array of one value per pair.

        Up to ``most`` support vectors are broadcast; beyond that blocks of them meet blocks of rows and the parts
        of a sum are added up per row.
        """
        pairs, bias, value = self.pairs, self.intercept, kernel_of(*self.kernel)
        if self.vectors.limit(most + 1).count() <= most:
            table = self.vectors.orderBy("sv_id").toArrow().combine_chunks()
            if not table.num_rows:
                return scored(rows, lambda x: np.tile(bias, (len(x), 1)), "decision")
            v, weight = (matrix(table[n].combine_chunks()) for n in ("x", "alpha"))
            weight = weight * signs(table["y"].to_numpy(), pairs)
            return scored(rows, lambda x: value(x, v) @ weight + bias, "decision")

        def part(a: dict, b: dict) -> dict:
            z, weight = np.zeros((len(a["x"]), len(pairs))), np.stack(b["alpha"]) * signs(b["y"], pairs)
            for i in range(0, len(z), 2000):
                for j in range(0, len(weight), 2000):
                    z[i : i + 2000] += value(a["x"][i : i + 2000], b["x"][j : j + 2000]) @ weight[j : j + 2000]
            return {"row_id": a["row_id"], "pair": np.tile(np.arange(len(pairs)), (len(z), 1)).tolist(), "z": z.tolist()}

        kind = rows.schema["row_id"].dataType.simpleString()
        vectors = self.vectors.withColumnRenamed("sv_id", "row_id")
        parts = block_pairs(rows.select("row_id", "x"), vectors, part, f"row_id {kind}, pair array<long>, z array<double>", ["row_id", "x"], ["row_id", "y", "alpha", "x"], most=0, whole=True)
        parts = parts.select("row_id", F.explode(F.arrays_zip("pair", "z")).alias("p")).groupBy("row_id", "p.pair").agg(F.sum("p.z").alias("z"))
        shift = F.array(*[F.lit(float(v)) for v in bias])[F.col("pair")]
        sums = parts.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pair", (F.col("z") + shift).alias("z")))).alias("p"))
        return rows.join(sums.select("row_id", F.transform("p", lambda p: p["z"]).alias("decision")), "row_id")

    def predict(self, rows: DataFrame, most: int = 20_000) -> DataFrame:
        """``rows`` with decision and pred, the class of most pairs' votes; ties go to the lowest class."""
        classes = sorted({c for p in self.pairs for c in p})
        won = lambda d, c: sum((F.when(d[k] >= 0, F.lit(a == c)).otherwise(F.lit(b == c)).cast("int") for k, (a, b) in enumerate(self.pairs) if c in (a, b)), F.lit(0))
        votes = F.array(*[won(F.col("decision"), c) for c in classes])
        return self.decide(rows, most).withColumn("pred", F.array(*[F.lit(c) for c in classes])[C.argmax(votes)])


def sweeps(
    x: np.ndarray, s: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray], c: float, tol: float, most: int, size: int = WHOLE, inner: int = 12
) -> tuple[np.ndarray, int, tuple[float, float, float]]:
    """One pair's alphas with a gap of at most ``tol``, the sweeps it took, at most ``most``, and the sums of alphas, of the quadratic form and of hinges.

    Up to ``size`` rows are solved for at once. More are cut at random into blocks anew in each sweep; a block's rows are
    solved for roughly, by coordinates, and the others' decision values follow. Kernel values are made when needed.
    """
    n, alpha, f, draw = len(x), np.zeros(len(x)), np.zeros(len(x)), np.random.default_rng(0)
    number, sums = 0, (0.0, 0.0, 0.0)
    while number < most:
        number += 1
        for w in np.array_split(draw.permutation(n), -(-n // size)):
            q, slope = (value(x[w], x[w]) + 1) * s[w][:, None] * s[w][None, :], (1 - s * f)[w]
            if n <= size:
                new = ascend(q, slope, alpha[w], c)
            else:
                new, bend = alpha[w], np.maximum(np.diag(q), 1e-12).tolist()
                for _ in range(inner):
                    for i, b in enumerate(bend):
                        if change := min(max(new[i] + slope[i] / b, 0.0), c) - new[i]:
                            slope -= change * q[i]
                            new[i] += change
            signed = (new - alpha[w]) * s[w]
            alpha[w] = new
            for first in range(0, n, 4096):  # bounds the kernel matrix
                f[first : first + 4096] += (value(x[first : first + 4096], x[w]) + 1) @ signed
        sums = float(alpha.sum()), float((alpha * s * f).sum()), float(np.maximum(1 - s * f, 0).sum())
        primal = sums[1] / 2 + c * sums[2]
        if primal <= 0 or primal - (sums[0] - sums[1] / 2) <= tol * primal:
            break
    return alpha, number, sums


def _whole(rows: DataFrame, pairs: list[tuple[int, int]], params: tuple, c: float, tol: float, most: int) -> Machine:
    """The machine of pairs that are solved for in a task each."""
    kind, value = rows.schema["row_id"].dataType.simpleString(), kernel_of(*params)
    names = ["pair", "row_id", "x", "y", "alpha", "sums"]

    def solve(key: tuple, one: pa.Table) -> pa.Table:
        one = one.sort_by("row_id").combine_chunks()
        x, y = matrix(one["x"].combine_chunks()), one["y"].to_numpy().astype(np.int64)
        s = signs(y, pairs)[:, key[0].as_py()]
        alpha, number, sums = sweeps(x, s, value, c, tol, most)
        at = np.append(np.flatnonzero(alpha > 0), 0)  # the last row has the sums
        learned, told = pa.array([*alpha[at[:-1]], None], pa.float64()), [None] * (len(at) - 1) + [[*sums, float((alpha * s).sum()), float(number)]]
        columns = [one[n].take(pa.array(at)).combine_chunks() for n in ("pair", "row_id", "x")]
        return pa.Table.from_arrays([*columns, pa.array(y[at]), learned, pa.array(told, pa.list_(pa.float64()))], names=names)

    of_class = {k: [p for p, pair in enumerate(pairs) if k in pair] for k in {k for p in pairs for k in p}}
    own = F.coalesce(*[F.when(F.col("y") == k, F.array(*map(F.lit, p))) for k, p in of_class.items()])
    dealt = rows.select(F.explode(own).alias("pair"), "row_id", "x", "y")
    solved = stored(dealt.groupBy("pair").applyInArrow(solve, f"pair int, row_id {kind}, x array<double>, y long, alpha double, sums array<double>"), "solved")
    asum, quad, hinge, bias, number = np.zeros((5, len(pairs)))
    for r in solved.filter("alpha is null").select("pair", "sums").collect():  # a row per pair
        asum[r.pair], quad[r.pair], hinge[r.pair], bias[r.pair], number[r.pair] = r.sums
    primal = quad / 2 + c * hinge
    gap = np.where(primal > 0, (primal - (asum - quad / 2)) / np.maximum(primal, 1e-12), 0.0)
    every = solved.filter("alpha is not null").groupBy(F.col("row_id").alias("sv_id"), "x", "y").agg(F.collect_list(F.struct("pair", "alpha")).alias("p"))
    alpha = F.transform(F.sequence(F.lit(0), F.lit(len(pairs) - 1)), lambda k: C.total(F.transform(F.filter("p", lambda v: v["pair"] == k), lambda v: v["alpha"])))
    return Machine(pairs, stored(every.select("sv_id", "x", "y", alpha.alias("alpha")), "vectors"), bias, gap, int(number.max(initial=0)), params)


def _packed(rows: DataFrame, pairs: int, block_rows: int) -> tuple[DataFrame, int]:
    """One row per block, and how many blocks there are."""
    kind = rows.schema["row_id"].dataType.simpleString()
    n = max(1, -(-rows.count() // block_rows))
    key = F.pmod(F.xxhash64("row_id"), F.lit(n)).alias("block")
    blocks = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row_id", "y", "x"))).alias("r"))
    blocks = blocks.select("block", F.col("r.row_id").alias("ids"), F.col("r.y").alias("y"), F.col("r.x").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x, y = matrix(one.column(3).flatten()), one.column(2).flatten().to_numpy().astype(np.int64)
                zero = np.zeros((len(y), pairs)).tobytes()
                ids = pa.array([one.column(1)[0].as_py()], one.column(1).type)
                none = pa.array([None], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([one.column(0), ids, *[pa.array([v]) for v in (x.tobytes(), y.tobytes(), zero, zero)], none], names=[f.split()[0] for f in _STATE.split(", ")])

    return stored(blocks.mapInArrow(pack, _STATE.format(id=kind)), "blocks"), n


def _blocks(batches: Iterator[pa.RecordBatch], pairs: int) -> Iterator[tuple]:
    """Each block's row, its x, y, alpha and f."""
    for batch in batches:
        for k in range(batch.num_rows):
            y = np.frombuffer(batch.column(3)[k].as_py(), dtype=np.int64)
            x, alpha, f = (np.frombuffer(batch.column(c)[k].as_py()) for c in (2, 4, 5))
            yield batch.slice(k, 1), x.reshape(len(y), -1), y, alpha.reshape(len(y), pairs), f.reshape(len(y), pairs)


def _added(table: DataFrame, column: str, n: int) -> np.ndarray:
    """The sum of an array column of n values: n rows come back."""
    out = np.zeros(n)
    for r in table.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def train(
    rows: DataFrame, classes: list[int], kernel: str = "rbf", gamma: float = 1.0, coef0: float = 1.0, degree: int = 3, c: float = 1.0, tol: float = 1e-3,
    rounds: int = 100, working: int = 600, block_rows: int = 500, alone: int | None = None,
) -> Machine:
    """All pairs of ``classes`` trained together on ``rows`` (row_id, x, y) until each pair's gap is at most ``tol`` of its primal value.

    If no pair has more than ``alone`` rows (20,000 for polynomials, 0 for other kernels, unless given), each is solved
    for in a task, and a round is a sweep over its rows. Beyond that a round is three jobs, whatever the number of pairs; no more than ``working`` rows a pair go through the driver
    to the blocks in it. ``rounds`` bounds the rounds, and the machine says what gap it reached. Pairs without rows
    have a gap of 0 and decide for their first class.
    """
    pairs = list(combinations(sorted(classes), 2))
    n_pairs, value, params = len(pairs), kernel_of(kernel, gamma, coef0, degree), (kernel, gamma, coef0, degree)
    alone = alone if alone is not None else 20_000 if kernel == "poly" else 0
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()} if alone else {}  # a row per class
    if alone and pairs and max(counts.get(a, 0) + counts.get(b, 0) for a, b in pairs) <= alone:
        return _whole(rows, pairs, params, c, tol, rounds)
    kind = rows.schema["row_id"].dataType.simpleString()
    state, blocks = _packed(rows.select("row_id", "y", "x"), n_pairs, block_rows)
    share = max(1, 2 * working // blocks)  # of a pair, from each block

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, y, alpha, f in _blocks(batches, n_pairs):
            s = signs(y, pairs)
            far = violations(np.array([value(v[None], v[None])[0, 0] for v in x]) + 1, s, alpha, f, c)
            for p in range(n_pairs):
                at = np.argsort(-far[:, p], kind="stable")[:share]
                at = at[far[at, p] > 0]
                if len(at):
                    columns = [np.full(len(at), p, np.int32), far[at, p], np.full(len(at), row.column(0)[0].as_py()), at.astype(np.int32)]
                    columns = [pa.array(v) for v in columns] + [pa.array(list(x[at]), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v[at, p]) for v in (s, alpha, f)]], names=[w.split()[0] for w in _WORST.split(", ")])

    def solve(one: pa.Table) -> pa.Table:
        x, (sign, alpha, f) = matrix(one["x"].combine_chunks()), (one[n].to_numpy() for n in ("sign", "alpha", "f"))
        new = ascend((value(x, x) + 1) * sign[:, None] * sign[None, :], 1 - sign * f, alpha, c)
        return one.select(["pair", "block", "at", "x"]).append_column("change", pa.array(new - alpha)).append_column("signed", pa.array((new - alpha) * sign))

    top = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("violation"), "block", "at"))
    gap, bias = np.zeros(n_pairs), np.zeros(n_pairs)
    for number in range(rounds + 1):
        if number == rounds:
            break
        some = state.mapInArrow(worst, _WORST).withColumn("top", top).filter(F.col("top") <= working).drop("top")
        changed = some.groupBy("pair").applyInArrow(solve, "pair int, block long, at int, x array<double>, change double, signed double").filter("change <> 0").toArrow()
        if not changed.num_rows:
            break
        place, row_of = np.unique(np.stack([changed["block"].to_numpy(), changed["at"].to_numpy()], axis=1), axis=0, return_inverse=True)
        x = np.zeros((len(place), len(changed["x"][0])))
        x[row_of] = matrix(changed["x"].combine_chunks())
        change, signed = np.zeros((len(place), n_pairs)), np.zeros((len(place), n_pairs))
        change[row_of, changed["pair"].to_numpy()], signed[row_of, changed["pair"].to_numpy()] = changed["change"].to_numpy(), changed["signed"].to_numpy()
        shared = rows.sparkSession.sparkContext.broadcast((place, x, change, signed))

        def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place, far, change, signed = shared.value
            for row, x, y, alpha, f in _blocks(batches, n_pairs):
                alpha, f, s = alpha.copy(), f.copy(), signs(y, pairs)
                own = place[:, 0] == row.column(0)[0].as_py()
                alpha[place[own, 1]] += change[own]
                for first in range(0, len(far), 4096):  # bounds the kernel matrix
                    f += (value(x, far[first : first + 4096]) + 1) @ signed[first : first + 4096]
                sums = np.concatenate([alpha.sum(axis=0), (alpha * s * f).sum(axis=0), (np.maximum(1 - s * f, 0) * (s != 0)).sum(axis=0), (alpha * s).sum(axis=0)])
                new = [pa.array([v.tobytes()]) for v in (alpha, f)]
                yield pa.RecordBatch.from_arrays([*row.columns[:4], *new, pa.array([sums.tolist()], pa.list_(pa.float64()))], names=row.schema.names)

        state = stored(state.mapInArrow(move, _STATE.format(id=kind)), "blocks")
        asum, quad, hinge, bias = _added(state, "sums", 4 * n_pairs).reshape(4, n_pairs)
        shared.destroy()
        primal = quad / 2 + c * hinge
        gap = np.where(primal > 0, (primal - (asum - quad / 2)) / np.maximum(primal, 1e-12), 0.0)
        if gap.max(initial=0.0) <= tol:
            break

    def support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, y, alpha, _ in _blocks(batches, n_pairs):
            at = np.flatnonzero((alpha > 0).any(axis=1))
            ids = row.column(1)[0].values.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x[at]), pa.list_(pa.float64())), pa.array(y[at]), pa.array(list(alpha[at]), pa.list_(pa.float64()))], names=["sv_id", "x", "y", "alpha"])

    vectors = stored(state.mapInArrow(support, f"sv_id {kind}, x array<double>, y long, alpha array<double>"), "vectors")
    return Machine(pairs, vectors, bias, gap, number + 1, params)
