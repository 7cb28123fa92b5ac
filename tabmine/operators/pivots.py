"""Nearest neighbours of large tables: cells around pivots, and only those that a query's k-th distance reaches.

Training rows belong to their nearest pivot. A query first meets the nearest cells that hold k rows; the k-th distance found there
bounds all others, and by the triangle inequality most cells can't hold a row that near. Results are exact. A cell
is dealt into blocks of a bounded size, so a cell with a third of all rows is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import order_key
from tabmine.operators.batches import distances, matrix, met, packed
from tabmine.operators.closest import closest
from tabmine.operators.frame import literal_array
from tabmine.sources.files import stored


@dataclass
class Visits:
    """Pairs of rows, and of blocks, whose distances were computed, and how many there are in all."""

    rows: int
    all_rows: int
    blocks: int


@dataclass
class Cells:
    """Pivots and what is known of their cells: nothing here grows with the rows."""

    pivots: np.ndarray
    metric: str
    n: np.ndarray  # rows a cell
    near: np.ndarray  # least and greatest distance of a cell's rows to its pivot
    far: np.ndarray
    grouped: dict[int, np.ndarray]  # rows a cell of each group

    def __post_init__(self) -> None:
        self.beacons = beacons_of(self.pivots)
        self.apart = distances(self.pivots[self.beacons], self.pivots, self.metric)

    def reached(self, x: np.ndarray, group: np.ndarray | None, k: int, limit: np.ndarray | None) -> np.ndarray:
        """Which cells each row of x goes to: those of the first round, or without them those that ``limit`` reaches."""
        d = distances(x, self.pivots, self.metric)
        order = np.argsort(d, axis=1, kind="stable")
        own = np.stack([self.n - self.grouped.get(g, 0) for g in group.tolist()]) if group is not None else np.broadcast_to(self.n, d.shape)
        before = np.cumsum(np.take_along_axis(own, order, axis=1), axis=1) - np.take_along_axis(own, order, axis=1)
        first = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(first, order, before < k, axis=1)
        if limit is None:
            return first & (own > 0)
        home = d.argmin(axis=1)
        least = d[np.arange(len(d)), home][:, None]
        bound = np.maximum(np.maximum(d - self.far, self.near - d), (d - least) / 2)
        if self.metric == "euclidean":  # how far the plane between two pivots is
            between = distances(self.pivots[home], self.pivots, self.metric)
            bound = np.maximum(bound, (d * d - least * least) / (2 * np.maximum(between, 1e-300)) * (between > 0))
        return ~first & (own > 0) & (bound <= (limit + 1e-8 * (1 + limit))[:, None])


    def routes(self, x: np.ndarray, group: np.ndarray | None, k: int, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """``reached`` as (row, cell) pairs, by row. Rows whose own cell has k rows look at cells near their beacon only."""
        home, least, beacon, r = homes(x, self.pivots, self.beacons, self.metric)
        own = self.n[home] - (np.array([self.grouped[g][c] if g in self.grouped else 0 for g, c in zip(group.tolist(), home.tolist(), strict=True)]) if group is not None else 0)
        plain = own >= k
        if limit is not None:
            plain &= np.isfinite(limit)
        odd = np.flatnonzero(~plain)
        rows, cells = np.nonzero(self.reached(x[odd], None if group is None else group[odd], k, None if limit is None else limit[odd])) if len(odd) else (odd, odd)
        found = [(odd[rows], cells)]
        if limit is None:
            found.append((np.flatnonzero(plain), home[plain]))
        else:
            edge = limit + 1e-8 * (1 + limit)
            for some in split_by(beacon, np.flatnonzero(plain)):
                b = beacon[some[0]]
                cols = np.flatnonzero((self.n > 0) & (self.apart[b] - self.far <= ((r + edge)[some]).max() * (1 + 1e-9)))
                d, near = distances(x[some], self.pivots[cols], self.metric), least[some][:, None]
                bound = np.maximum(np.maximum(d - self.far[cols], self.near[cols] - d), (d - near) / 2)
                if self.metric == "euclidean":
                    between = distances(self.pivots[home[some]], self.pivots[cols], self.metric)
                    bound = np.maximum(bound, (d * d - near * near) / (2 * np.maximum(between, 1e-300)) * (between > 0))
                rows, at = np.nonzero((bound <= edge[some][:, None]) & (cols[None, :] != home[some][:, None]))
                keep = np.ones(len(rows), bool)
                if group is not None:
                    keep = np.array([self.n[c] > (self.grouped[g][c] if g in self.grouped else 0) for g, c in zip(group[some[rows]].tolist(), cols[at].tolist(), strict=True)], dtype=bool)
                found.append((some[rows][keep], cols[at][keep]))
        row, cell = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], cell[order]


def beacons_of(pivots: np.ndarray) -> np.ndarray:
    """Numbers of three times the root of all pivots."""
    n = len(pivots)
    return np.unique(np.linspace(0, n - 1, min(n, int(3 * n**0.5))).astype(int))


def split_by(key: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` in groups of equal ``key``."""
    order = rows[np.argsort(key[rows], kind="stable")]
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []


def homes(x: np.ndarray, pivots: np.ndarray, beacons: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest pivot (the first of equals) and its distance, its nearest beacon and that distance.

    Beacons are some of the pivots, by number. A pivot over twice as far from a row's beacon as the row is can't be
    nearer than the beacon, so rows of a beacon are compared with the pivots around it.
    """
    d = distances(x, pivots[beacons], metric)
    beacon, r = d.argmin(axis=1), d.min(axis=1, initial=np.inf)
    home, least = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    between = distances(pivots[beacons], pivots, metric)
    for some in split_by(beacon, np.arange(len(x))):
        cols = np.flatnonzero(~(between[beacon[some[0]]] > 2 * r[some].max() * (1 + 1e-9)))
        d = distances(x[some], pivots[cols], metric)
        at = d.argmin(axis=1)
        home[some], least[some] = cols[at], d[np.arange(len(at)), at]
    return home, least, beacon, r


def choose(train: DataFrame, n: int, most: int = 4096, seed: int = 42) -> np.ndarray:
    """Different vectors of at most ``most`` rows, as many as the root of ``n``, drawn by hash."""
    rows = train.orderBy(order_key(seed, F.col("row_id")), "row_id").limit(max(1, min(most, int(n**0.5)))).select("x").collect()  # at most ``most``
    return np.unique(np.array([r.x for r in rows], dtype=float), axis=0)


def reach(queries: DataFrame, train: DataFrame, k: int, metric: str, most: int = 4096, seed: int = 42) -> float:
    """The share of ``most`` training rows, drawn by hash, that rows of their cells reach, as told on the driver by a few of ``queries``."""
    draw = lambda rows, n: rows.orderBy(order_key(seed, F.col("row_id")), "row_id").limit(n).select("x").collect()
    t, q = (np.array([r.x for r in draw(rows, n)], dtype=float) for rows, n in ((train, most), (queries, 256)))
    if not len(t) or not len(q):
        return 0.0
    centres = np.unique(t[: max(1, int(len(t) ** 0.5))], axis=0)
    d = distances(t, centres, metric)
    at, own = d.argmin(axis=1), d.min(axis=1)
    near, far = np.full(len(centres), np.inf), np.zeros(len(centres))
    np.minimum.at(near, at, own)
    np.maximum.at(far, at, own)
    counts = np.bincount(at, minlength=len(centres))
    cells = Cells(centres, metric, counts, near, far, {})
    between = distances(q, t, metric)
    limit = np.partition(between, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
    met_cells = cells.reached(q, None, k, None) | cells.reached(q, None, k, limit)
    return float((met_cells * counts).sum() / (len(q) * len(t)))


def in_cells(train: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """``train`` with the cell of each row and its distance to that pivot."""

    beacons = beacons_of(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // len(beacons))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                home, least, _, _ = homes(matrix(part.column("x")), pivots, beacons, metric)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(least)], names=[*part.schema.names, "cell", "__d"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema)
    return train.mapInArrow(run, f"{schema}, cell int, __d double")


def _routed(queries: DataFrame, cells: Cells, k: int, group: str | None, limit: str | None) -> DataFrame:
    """``queries`` once for each cell that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // len(cells.beacons))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                value = lambda name: part.column(name).to_numpy() if name else None  # noqa: B023, E731
                at, cell = cells.routes(matrix(part.column("x")), value(group), k, value(limit))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(cell.astype(np.int32))], names=[*part.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{schema}, cell int")


def neighbors(
    queries: DataFrame, train: DataFrame, k: int = 5, metric: str = "euclidean", group: str | None = None, size: int = 8000, pivots: int = 4096
) -> tuple[DataFrame, Visits]:
    """(qid, rank, tid, y, dist) as ``knn.neighbors`` has it, and what was compared for it.

    ``metric`` is euclidean or manhattan. Fewer than k rows to meet give fewer neighbours, empty sides none.
    """
    extra = [group] if group else []
    q, t = queries.select("row_id", *extra, "x"), train.select("row_id", "y", *extra, "x")
    schema = "qid long, tid long, y int, dist double"
    n, asked = t.count(), q.count()
    if not n or not asked:
        return q.sparkSession.createDataFrame([], f"{schema}, rank int"), Visits(0, 0, 0)
    centres = choose(t, n, pivots)
    t = stored(in_cells(t, centres, metric), "cells")
    stats = t.groupBy("cell", *extra).agg(F.count("*").alias("n"), F.min("__d").alias("near"), F.max("__d").alias("far")).collect()  # cells times groups
    counts, near, far = np.zeros(len(centres), dtype=np.int64), np.full(len(centres), np.inf), np.zeros(len(centres))
    grouped: dict[int, np.ndarray] = {}
    for r in stats:
        counts[r.cell] += r.n
        near[r.cell], far[r.cell] = min(near[r.cell], r.near), max(far[r.cell], r.far)
        if group:
            grouped.setdefault(r[group], np.zeros(len(centres), dtype=np.int64))[r.cell] += r.n
    cells = Cells(centres, metric, counts, near, far, grouped)
    parts_t = -(-counts // size)
    seen = Visits(0, n * asked, 0)

    def nearest(a: dict, b: dict) -> dict:
        return closest(a, b, k, metric, group, a.get("limit"))

    def meet(routed: DataFrame, names: list[str]) -> DataFrame:
        routed = stored(routed, "routed")
        going = np.zeros(len(centres), dtype=np.int64)
        for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row per cell
            going[r.cell] = r.n
        parts_q = -(-going // size)
        seen.rows += int((going * counts).sum())
        seen.blocks += int((parts_q * parts_t).sum())
        of = lambda parts: literal_array(parts.tolist(), "int")[F.col("cell")]
        copies = lambda parts, name: F.explode(F.sequence(F.lit(0), of(parts) - 1)).alias(name)
        a = packed(routed.withColumn("__n", of(parts_q)), names, F.col("__n"), "a", "p", ["cell"]).select("*", copies(parts_t, "b"))
        met_cells = t.withColumns({"__n": of(parts_t), "__q": of(parts_q)}).filter("`__q` > 0")
        b = packed(met_cells, ["row_id", "y", *extra, "x"], F.col("__n"), "b", "q", ["cell"]).select("*", copies(parts_q, "a"))
        return stored(met(a.join(b, ["cell", "a", "b"]), nearest, schema), "near")

    order = Window.partitionBy("qid").orderBy(F.round("dist", 9), "tid")  # k rows per block met
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = top(meet(_routed(q, cells, k, group, None), ["row_id", *extra, "x"]))
    limits = first.groupBy(F.col("qid").alias("row_id")).agg(F.when(F.count("*") == k, F.max("dist")).otherwise(float("inf")).alias("limit"))
    again = q.join(limits, "row_id")
    rest = meet(_routed(again, cells, k, group, "limit"), ["row_id", *extra, "limit", "x"])
    return top(first.drop("rank").unionByName(rest)), seen
