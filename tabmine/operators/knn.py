"""k nearest neighbours: blocks of queries against blocks of training rows, k rows back per query and block; pivots where they spare most pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmine.operators import pivots
from tabmine.operators.batches import block_pairs, distances
from tabmine.operators.chartdata import sample
from tabmine.operators.closest import closest
from tabmine.operators.frame import quantiles


def neighbors(
    queries: DataFrame, train: DataFrame, k: int = 5, metric: str = "euclidean", size: int = 2000, group: str | None = None, most: int = 20_000
) -> DataFrame:
    """(qid, rank, tid, y, dist): the k nearest training rows of each query, ties by training id.

    Distances equal to 9 digits are ties. With ``group`` a query meets only training rows whose group
    differs from its own (cross-validation folds). Over ``most`` training rows are cut into cells around pivots,
    of which a query meets only those that its k-th distance reaches; where a sample says that it reaches most, as among
    unlike rows of many dimensions, every pair of blocks meets instead.
    """
    if train.limit(most + 1).count() > most and pivots.reach(queries, train, k, metric) < 0.3:
        return pivots.neighbors(queries, train, k, metric, group, size)[0]
    extra = [group] if group else []
    q = queries.select("row_id", *extra, "x")
    t = train.select("row_id", "y", *extra, "x")
    nearest = lambda a, b: closest(a, b, k, metric, group)
    found = block_pairs(q, t, nearest, "qid long, tid long, y int, dist double", ["row_id", *extra, "x"], ["row_id", "y", *extra, "x"], size, most, whole=True)
    order = Window.partitionBy("qid").orderBy(F.round("dist", 9), "tid")  # k rows per training block
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vote(found: DataFrame, weights: str = "uniform", sigma: float = 1.0) -> DataFrame:
    """(qid, k, p): class shares of a query's neighbours, for the classes among them."""
    if weights == "uniform":
        w = F.lit(1.0)
    elif weights == "distance":
        w = 1.0 / (F.col("dist") + 1e-10)
    else:
        w = F.exp(-F.col("dist") * F.col("dist") / (2.0 * sigma * sigma))
    sums = found.groupBy("qid", F.col("y").alias("k")).agg(F.sum(w).alias("w"))
    whole = F.sum("w").over(Window.partitionBy("qid"))
    return sums.select("qid", "k", (F.col("w") / F.greatest(whole, F.lit(1e-15))).alias("p"))


def predict(shares: DataFrame) -> DataFrame:
    """(qid, pred, p): the class with the largest share, the lowest one of equals."""
    best = F.struct(F.round("p", 9).alias("p"), (-F.col("k")).alias("k"))
    return shares.groupBy("qid").agg(F.max_by("k", best).alias("pred"), F.max("p").alias("p"))


def bandwidth(train: DataFrame, n: int = 500, seed: int = 42, exact: bool = True) -> float:
    """Median positive distance of n sampled training rows to all of them, over the root of 2.

    Only distances near the median are ever shuffled.
    """
    some = sample(train, F.col("row_id"), n, seed)
    every = lambda a, b: {"d": distances(a["x"], b["x"], "euclidean").ravel()}
    d = block_pairs(train, some, every, "d double", ["row_id", "x"], ["row_id", "x"]).filter("d > 0")
    row = quantiles(d, [], "d", [0.5]).first() if exact else d.agg(F.array(F.percentile_approx("d", 0.5)).alias("q")).first()
    found = row.q[0] if row else None
    return found / 2**0.5 if found else 1.0
