"""Splits of tree nodes: scores of all cuts, histograms that tell where the best one can lie, subtrees of small nodes.

A large node is never sorted whole. Tasks count its rows by feature, bin and class; a bin's counts bound the score
of every cut inside it, and only bins that can hold the winner are read value by value. Bins lie between
quantiles of all rows: a fixed number a feature, known to the driver and the tasks, not part of any plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import entropy_of, total
from tabmine.operators.batches import matrix
from tabmine.operators.frame import few, ranged, running_sums
from tabmine.sources.files import stored

#: Scores are compared after rounding to 9 digits; what is this much lower can't win.
SLACK = 1e-8


def _log(v: Column) -> Column:
    return F.when(v > 0, v * F.log2(F.greatest(v, F.lit(1e-300)))).otherwise(0.0)


def _score(left: Column, right: Column, criterion: str) -> Column:
    """Gain, or gain ratio (0 if the split has under 1e-10 bits), of two arrays of class counts."""
    every = F.zip_with(left, right, lambda a, b: a + b)
    nl, nr = (total(F.transform(a, lambda v: v.cast("double"))) for a in (left, right))
    pl, pr = nl / (nl + nr), nr / (nl + nr)
    gain = entropy_of(every) - pl * entropy_of(left) - pr * entropy_of(right)
    info = -(pl * F.log2(pl)) - pr * F.log2(pr)
    return gain if criterion == "gain" else F.when(info < 1e-10, 0.0).otherwise(gain / info)


def counted(cells: DataFrame, classes: int) -> DataFrame:
    """(node, fi, b, v, skip, c0, c1, ...) from cells (node, fi, v, y): class counts of each value."""
    counts = [F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(classes)]
    return cells.groupBy("node", "fi", F.lit(0).alias("b"), "v", F.lit(False).alias("skip")).agg(*counts)


def split_scores(counts: DataFrame, classes: int, criterion: str = "ratio", candidates: int | None = None, binned: bool = False) -> DataFrame:
    """(node, fi, threshold, score, n_left, n_right, left, right) of all midpoints of neighbouring distinct values.

    ``counts`` is as ``counted`` gives it; a row with skip stands for values that no winning cut is next to.
    score is the gain ratio or the gain; left and right count the classes. ``candidates`` keeps only so
    many lowest thresholds of each node and feature. With ``binned`` the bins b are the ranges that running sums go over.
    """
    ks, by = range(classes), ["node", "fi"]
    dealt, bucket = (counts, F.col("b")) if binned else ranged(counts, [*by, "b", "v"])
    run = running_sums(dealt, {f"l{c}": F.col(f"c{c}") for c in ks}, bucket, ["b", "v"], by)
    whole = counts.groupBy(*by).agg(*[F.sum(f"c{c}").alias(f"t{c}") for c in ks])
    cell, order = F.struct("b", "v", "skip"), ["b", "v"]
    if bucket is None:
        marked = run.withColumns({"__r": F.lit(0), "next": F.lead(cell).over(Window.partitionBy(*by).orderBy(*order))})
    else:  # the next value of a range's last row is the first of a later range
        marked = run.withColumn("__r", bucket)
        firsts = marked.groupBy(*by, "__r").agg(F.min(cell).alias("__first"))
        firsts = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(*by).orderBy("__r"))).drop("__first")
        inside = Window.partitionBy(*by, "__r").orderBy(*order)
        marked = marked.join(firsts, [*by, "__r"]).withColumn("next", F.coalesce(F.lead(cell).over(inside), F.col("__next")))
    rows = marked.filter("next is not null and not skip and not next.skip")
    if candidates is not None:  # of each range first, so that no window ranks all values
        for key in ([*by, "__r"], by):
            rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__rank") <= candidates)
    rows = rows.join(whole, by).select(
        *by, ((F.col("v") + F.col("next.v")) / 2).alias("threshold"), F.array(*[F.col(f"l{c}") for c in ks]).alias("left"),
        F.array(*[F.col(f"t{c}") - F.col(f"l{c}") for c in ks]).alias("right"),
    )
    sizes = [total(F.transform(a, lambda v: v.cast("double"))).cast("long").alias(n) for a, n in (("left", "n_left"), ("right", "n_right"))]
    return rows.select(*by, "threshold", _score(F.col("left"), F.col("right"), criterion).alias("score"), *sizes, "left", "right")


def best_splits(scores: DataFrame) -> DataFrame:
    """The best row of each node; scores equal to 9 digits go to the lowest feature, then threshold."""
    order = F.struct(F.round("score", 9), -F.col("fi"), -F.col("threshold"))
    best = F.max_by(F.struct("fi", "threshold", "score", "n_left", "n_right", "left", "right"), order)
    return scores.groupBy("node").agg(best.alias("b")).select("node", "b.*")


# Large nodes


def bin_edges(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 quantiles of each feature. Bin b holds the values over edge b - 1 and up to edge b."""
    wide = rows.select(*[F.col("x")[k].alias(f"x{k}") for k in range(features)])
    found = wide.approxQuantile([f"x{k}" for k in range(features)], [p / bins for p in range(1, bins)], 0.25 / bins)
    return [np.unique(np.array(q, dtype=float)) for q in found]


def _summed_cells(rows: DataFrame, codes: Callable, decode: Callable, schema: str, most: int = 1 << 20) -> DataFrame:
    """Counts of the codes that ``codes`` (key, y, x of a batch) gives, added up in each task and then in Spark.

    Codes are a structured array; a task hands on what it holds whenever there are over ``most`` different ones.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = codes(batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2)))
            own = np.ones(len(new), dtype=np.int64)
            if held is not None:
                new, own = np.concatenate([held, new]), np.concatenate([n, own])
            held, at = np.unique(new, return_inverse=True)
            n = np.bincount(at, weights=own, minlength=len(held)).astype(np.int64)
            if len(held) > most:
                yield pa.RecordBatch.from_arrays([*map(pa.array, decode(held)), pa.array(n)], names=[*names, "n"])
                held = None
        if held is not None and len(held):
            yield pa.RecordBatch.from_arrays([*map(pa.array, decode(held)), pa.array(n)], names=[*names, "n"])

    found = rows.select("node", "y", "x").mapInArrow(run, f"{schema}, n long")
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def histograms(rows: DataFrame, edges: list[np.ndarray], classes: int, bins: int) -> DataFrame:
    """(node, fi, b, y, n): rows of each node by feature, bin and class."""
    features = len(edges)

    def codes(node: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        names, place = np.unique(node, return_inverse=True)
        b = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        code = ((np.arange(features) * bins + b) * classes + y[:, None]).astype(np.int64)
        out = np.zeros(code.size, dtype=[("node", "i8"), ("code", "i8")])
        out["node"], out["code"] = np.repeat(names[place], features), code.ravel()
        return out

    def decode(held: np.ndarray) -> list[np.ndarray]:
        cell, y = np.divmod(held["code"], classes)
        fi, b = np.divmod(cell, bins)
        return [held["node"], fi.astype(np.int32), b.astype(np.int32), y.astype(np.int32)]

    return _summed_cells(rows, codes, decode, "node long, fi int, b int, y int")


def _bound(low: list[Column], own: list[Column], every: list[Column], criterion: str) -> Column:
    """What no cut inside a bin can exceed: ``low`` counts lie before it, ``own`` in it, ``every`` in the node.

    The children's n * entropy is x log x of their sizes, which is convex and lies above its tangent, minus x log x of
    their class counts; those terms are concave in a class's count and lie above their chords. So the sum lies
    above a linear function, whose least value takes each class of the bin wholly or not at all.
    """
    add = lambda parts: sum(parts[1:], parts[0])
    n, nl, nb = (add(p) for p in (every, low, own))
    m = nl + nb / 2
    slope = F.log2(m) - F.log2(n - m)
    cost = _log(m) + _log(n - m) + slope * (nl - m)
    for a, b, t in zip(low, own, every, strict=True):
        start, end = -_log(a) - _log(t - a), -_log(a + b) - _log(t - a - b)
        cost = cost + start + F.least(F.lit(0.0), b * slope + end - start)
    gain = (_log(n) - add([_log(t) for t in every]) - cost) / n
    if criterion == "ratio":
        info = lambda k: -(k / n) * F.log2(k / n) - ((n - k) / n) * F.log2((n - k) / n)
        gain = gain / F.least(info(F.greatest(nl, F.lit(1.0))), info(F.least(nl + nb, n - 1)))
    return F.when(nb > 1, gain).otherwise(-1.0)


def open_bins(hist: DataFrame, classes: int, min_score: float, criterion: str) -> DataFrame:
    """(node, fi, b, open, c0, ...): a bin is open if the node's best cut can lie in it or at one of its ends."""
    ks = range(classes)
    wide = hist.groupBy("node", "fi", "b").agg(*[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in ks])
    every = Window.partitionBy("node", "fi")
    order = every.orderBy("b")
    wide = wide.withColumns({f"l{c}": F.sum(f"c{c}").over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ks})
    wide = wide.withColumns({f"t{c}": F.sum(f"c{c}").over(every) for c in ks}).withColumn("__more", F.lead("b").over(order).isNotNull())
    col = lambda p: [F.col(f"{p}{c}").cast("double") for c in ks]
    left, right = F.array(*col("l")), F.array(*[t - a for t, a in zip(col("t"), col("l"), strict=True)])
    low = [a - b for a, b in zip(col("l"), col("c"), strict=True)]
    wide = wide.withColumns({"__at": F.when(F.col("__more"), _score(left, right, criterion)), "__in": _bound(low, col("c"), col("t"), criterion)})
    best = wide.groupBy("node").agg((F.greatest(F.max("__at"), F.lit(min_score)) - SLACK).alias("__least"))
    wide = wide.join(few(best), "node").withColumn("__end", F.coalesce(F.col("__at") >= F.col("__least"), F.lit(False)))
    opened = F.col("__end") | (F.col("__in") >= F.col("__least")) | F.lag("__end", 1, False).over(order)
    return wide.select("node", "fi", "b", opened.alias("open"), *[f"c{c}" for c in ks])


def refined(rows: DataFrame, edges: list[np.ndarray], bins: DataFrame, classes: int, most_bins: int) -> DataFrame:
    """Counts for ``split_scores``: each value of the open bins of a node, and one skipped row for every other bin."""
    ks, features = range(classes), len(edges)
    picked = bins.filter("open").groupBy("node", "fi").agg(F.collect_list("b").alias("b")).collect()  # nodes times features
    nodes = np.array(sorted({r.node for r in picked}), dtype=np.int64)
    table = np.zeros((len(nodes), features, most_bins), dtype=bool)
    for r in picked:
        table[np.searchsorted(nodes, r.node), r.fi, r.b] = True

    kind = [("node", "i8"), ("fi", "i4"), ("b", "i4"), ("v", "f8"), ("y", "i4")]

    def codes(node: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        place = np.searchsorted(nodes, node)
        found = []
        for f, e in enumerate(edges):
            b = np.searchsorted(e, x[:, f])
            at = np.flatnonzero(table[np.minimum(place, len(nodes) - 1), f, b] & (nodes[np.minimum(place, len(nodes) - 1)] == node))
            part = np.zeros(len(at), dtype=kind)
            part["node"], part["fi"], part["b"], part["v"], part["y"] = node[at], f, b[at], x[at, f] + 0.0, y[at]
            found.append(part)
        return np.concatenate(found)

    cells = _summed_cells(rows, codes, lambda held: [np.ascontiguousarray(held[k]) for k, _ in kind], "node long, fi int, b int, v double, y int") if len(nodes) else None
    rest = bins.filter("not open").select("node", "fi", "b", F.lit(0.0).alias("v"), F.lit(True).alias("skip"), *[f"c{c}" for c in ks])
    if cells is None:
        return rest
    counts = [F.coalesce(F.sum(F.when(F.col("y") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in ks]
    return cells.groupBy("node", "fi", "b", "v", F.lit(False).alias("skip")).agg(*counts).unionByName(rest)


def lowest(rows: DataFrame, classes: int, features: int, candidates: int) -> DataFrame:
    """Counts for ``split_scores``: the ``candidates`` + 1 lowest values of each node and feature, and a skipped row for the rest.

    A task keeps the lowest values it has seen with their counts: what is among the lowest of all is so in every task.
    """
    keep, ks = candidates + 1, range(classes)
    names = ["node", "fi", "v", *[f"c{c}" for c in ks]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            node, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for i in np.unique(node).tolist():
                at = np.flatnonzero(node == i)
                one = np.eye(classes, dtype=np.int64)[y[at]]
                for f in range(features):
                    v, c = x[at, f] + 0.0, one
                    if (i, f) in held:
                        v, c = np.concatenate([held[i, f][0], v]), np.concatenate([held[i, f][1], c])
                    v, place = np.unique(v, return_inverse=True)
                    low = np.zeros((min(keep, len(v)), classes), dtype=np.int64)
                    np.add.at(low, place[place < keep], c[place < keep])
                    held[i, f] = v[:keep], low
        for (i, f), (v, c) in held.items():
            columns = [np.full(len(v), i), np.full(len(v), f, dtype=np.int32), v, *c.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in columns], names=names)

    schema = f"node long, fi int, v double, {', '.join(f'c{c} long' for c in ks)}"
    found = rows.select("node", "y", "x").mapInArrow(run, schema).groupBy("node", "fi", "v").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in ks])
    ranked = found.withColumn("__rank", F.row_number().over(Window.partitionBy("node", "fi").orderBy("v"))).filter(F.col("__rank") <= keep)
    low = stored(ranked.select("node", "fi", F.lit(0).alias("b"), "v", F.lit(False).alias("skip"), *[f"c{c}" for c in ks]), "lowest")
    whole = few(rows.groupBy("node").agg(*[F.count_if(F.col("y") == c).alias(f"t{c}") for c in ks]))
    part = low.groupBy("node", "fi").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in ks]).join(whole, "node")
    more = part.select("node", "fi", F.lit(1).alias("b"), F.lit(0.0).alias("v"), F.lit(True).alias("skip"), *[(F.col(f"t{c}") - F.col(f"c{c}")).alias(f"c{c}") for c in ks])
    return low.unionByName(more.filter(" + ".join(f"c{c}" for c in ks) + " > 0"))


# Small nodes


def _entropy(counts: np.ndarray) -> np.ndarray:
    p = counts / counts.sum(axis=1, keepdims=True)
    out = np.zeros(len(counts))
    for c in range(counts.shape[1]):
        out -= np.where(p[:, c] > 0, p[:, c] * np.log2(np.where(p[:, c] > 0, p[:, c], 1.0)), 0.0)
    return out


def best_split(x: np.ndarray, y: np.ndarray, classes: int, criterion: str, candidates: int | None, cells: int = 1 << 22) -> tuple | None:
    """(fi, threshold, score, left, right) of the best cut of these rows, by the order of ``best_splits``."""
    every = np.bincount(y, minlength=classes)
    one, best = np.eye(classes, dtype=np.int32)[y], None
    h, step = _entropy(every[None])[0], max(1, cells // max(1, x.shape[0] * classes))
    for start in range(0, x.shape[1], step):
        part = x[:, start : start + step]
        order = np.argsort(part, axis=0, kind="stable")
        v = np.take_along_axis(part, order, axis=0)
        cut = v[1:] != v[:-1]
        if candidates is not None:
            cut &= np.cumsum(cut, axis=0) <= candidates
        at, fi = np.nonzero(cut)
        if not len(at):
            continue
        left = np.cumsum(one[order], axis=0)[at, fi]
        right = every - left
        pl = left.sum(axis=1) / len(y)
        pr = right.sum(axis=1) / len(y)
        score = h - pl * _entropy(left) - pr * _entropy(right)
        if criterion == "ratio":
            info = -(pl * np.log2(pl)) - pr * np.log2(pr)
            score = np.where(info < 1e-10, 0.0, score / np.maximum(info, 1e-10))
        threshold, key = (v[at, fi] + v[at + 1, fi]) / 2, np.round(score, 9)
        k = np.lexsort((threshold, fi, -key))[0]
        if best is None or key[k] > best[0]:
            best = key[k], start + int(fi[k]), float(threshold[k]), float(score[k]), left[k], right[k]
    return None if best is None else best[1:]


def subtrees(
    rows: DataFrame, room: int, max_depth: int, classes: int, min_rows: int, min_score: float, criterion: str, candidates: int | None
) -> DataFrame:
    """(node, fi, threshold, score, left, right) of all splits below the given nodes, each of which has few rows: a group is a node."""

    def run(table: pa.Table) -> pa.Table:
        root = table.column("node")[0].as_py()
        x, y = matrix(table.column("x").combine_chunks()), table.column("y").to_numpy()
        base, todo, found = root // room * room, [(root % room, np.arange(len(y)))], []
        while todo:
            node, at = todo.pop()
            n = np.bincount(y[at], minlength=classes)
            if node.bit_length() > max_depth or len(at) < min_rows or n.max() == len(at):
                continue
            best = best_split(x[at], y[at], classes, criterion, candidates)
            if best is None or round(best[2], 9) < min_score:
                continue
            found.append((base + node, *best[:3], best[3].tolist(), best[4].tolist()))
            right = x[at, best[0]] > best[1]
            todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]
        names = ["node", "fi", "threshold", "score", "left", "right"]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        return pa.table([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "node long, fi int, threshold double, score double, left array<long>, right array<long>"
    return rows.select("node", "y", "x").groupBy("node").applyInArrow(run, schema)
