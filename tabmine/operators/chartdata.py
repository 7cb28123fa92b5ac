"""Aggregated tables behind distribution charts. Rows come as (keys..., fi, v), keys maybe a class."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import order_key
from tabmine.operators.frame import few, quantiles, running_sum


def histogram(cells: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys..., bin, low, high, n): equal-width bins over each group's own range, the last one closed.

    A constant group gets the range from v - 0.5 to v + 0.5. Empty bins are listed with 0.
    """
    cells = cells.filter(F.col("v").isNotNull())
    span = cells.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = few(span.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = cells.join(span, keys).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))
    return grid.join(counts, [*keys, "bin"], "left").na.fill(0, ["n"])


def boxplot(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., q1, median, q3, whisker_low, whisker_high, n_outliers); whiskers are data within 1.5 IQR."""
    q = quantiles(cells, keys, "v", [0.25, 0.5, 0.75])
    q = few(q.select(*keys, *[F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))]))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return cells.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def ecdf(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., v, n, share): how many values are at most v, per distinct value."""
    cells = cells.filter(F.col("v").isNotNull())
    counts = cells.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    run = running_sum(counts, F.col("c"), "n", ["v"], keys)
    total = few(cells.groupBy(*keys).agg(F.count("*").alias("total")))
    return run.join(total, keys).select(*keys, "v", "n", (F.col("n") / F.col("total")).alias("share"))


def kde(cells: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """(keys..., g, place, density): Gaussian kernel density on a grid over each group's range.

    The bandwidth is 1.06 std n^-0.2, at least 1e-6, and 0.1 for one value. A task adds the kernels of its
    rows up in one array per group; those arrays are all that is shuffled.
    """
    cells = cells.filter(F.col("v").isNotNull())
    s = cells.groupBy(*keys).agg(F.count("v").alias("n"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    h = F.when(F.col("n") == 1, 0.1).otherwise(F.greatest(1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(1e-6)))
    spans = few(s.select(*keys, F.col("n").cast("double").alias("n"), h.alias("h"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")))
    met = cells.join(spans, keys).select(F.to_json(F.struct(*keys)).alias("key"), "n", "h", "lo", "hi", F.col("v").cast("double").alias("v"))

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            v, codes = batch.column(5).to_numpy(), batch.column(0).dictionary_encode()
            at = codes.indices.to_numpy()
            for k, key in enumerate(codes.dictionary.to_pylist()):
                some = v[at == k]
                n, h, lo, hi = (batch.column(c)[int(np.argmax(at == k))].as_py() for c in (1, 2, 3, 4))
                place = lo + np.arange(points) * (hi - lo) / (points - 1)
                parts = [np.exp(-0.5 * ((place[None, :] - some[a : a + 4096, None]) / h) ** 2).sum(axis=0) for a in range(0, len(some), 4096)]
                one = (key, n, h, lo, hi)
                held[one] = held.get(one, 0.0) + sum(parts)
        for (key, n, h, lo, hi), total in held.items():
            names = ["key", "n", "h", "lo", "hi", "g", "s"]
            columns = [pa.array([x] * points) for x in (key, n, h, lo, hi)] + [pa.array(range(points), pa.int32()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    sums = met.mapInArrow(kernels, "key string, n double, h double, lo double, hi double, g int, s double")
    sums = sums.groupBy("key", "n", "h", "lo", "hi", "g").agg(F.sum("s").alias("s"))
    place = F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (points - 1)
    density = F.col("s") / (F.col("n") * F.col("h") * sqrt(2 * pi))
    named = F.from_json("key", cells.select(*keys).schema)
    return sums.select(named.alias("key"), "g", place.alias("place"), density.alias("density")).select("key.*", "g", "place", "density")


def class_profile(cells: DataFrame, label: str, feature: str = "fi") -> DataFrame:
    """(label, fi, mean, scaled): class means, and each scaled to 0..1 across classes (range 0 counts as 1)."""
    means = cells.groupBy(label, feature).agg(F.avg("v").alias("mean"))
    across = Window.partitionBy(feature)  # a row per class
    low, high = F.min("mean").over(across), F.max("mean").over(across)
    return means.withColumn("scaled", (F.col("mean") - low) / F.when(high == low, 1.0).otherwise(high - low))


def extrema(cells: DataFrame, label: str, feature: str = "fi") -> DataFrame:
    return cells.groupBy(label, feature).agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def sample(df: DataFrame, row_id: Column, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the first of the seeded shuffle."""
    return df.withColumn("__key", order_key(seed, row_id)).orderBy("__key", row_id).limit(n).drop("__key")


def parallel_lines(df: DataFrame, row_id: str, label: str, features: list[str], n: int = 500, per_class: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Lines (row_id, label, features in 0..1) and class means of the sample.

    Scaling is over all rows with 1e-10 added to the range; at most ``per_class`` lines of a class.
    """
    row = df.agg(*[f(c).alias(f"{p}__{k}") for k, c in enumerate(features) for p, f in (("lo", F.min), ("hi", F.max))])
    scaled = [((F.col(c) - F.col(f"lo__{k}")) / (F.col(f"hi__{k}") - F.col(f"lo__{k}") + 1e-10)).alias(c) for k, c in enumerate(features)]
    some = sample(df.crossJoin(F.broadcast(row)).select(row_id, label, *scaled), F.col(row_id), n, seed)  # one row
    order = Window.partitionBy(label).orderBy(order_key(seed, F.col(row_id)), row_id)  # over the sample only
    lines = some.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= per_class).drop("__rank")
    return lines, some.groupBy(label).agg(*[F.avg(c).alias(c) for c in features])


def prediction_distribution(predictions: DataFrame, true: str = "y", pred: str = "pred") -> DataFrame:
    """(label, n_true, n_pred)."""
    a = predictions.groupBy(F.col(true).alias("label")).agg(F.count("*").alias("n_true"))
    b = predictions.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("n_pred"))
    return a.join(b, "label", "full").na.fill(0, ["n_true", "n_pred"])
