"""Preparation: missing values, scaling, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmine.operators.frame import melt, quantiles, shuffled_rank

TINY = 1e-10


def drop_missing(df: DataFrame, features: list[str]) -> DataFrame:
    return df.na.drop(subset=features)


def _with_stats(df: DataFrame, features: list[str], stats: dict) -> DataFrame:
    """``df`` beside one row of statistics <name>__<k>; the row is broadcast."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{name}__{k}") for k, c in enumerate(features) for name, f in stats.items()])
    return df.crossJoin(F.broadcast(row))


def _mapped(df: DataFrame, wide: DataFrame, features: list[str], f) -> DataFrame:
    new = {c: f(F.col(c).cast("double"), k) for k, c in enumerate(features)}
    return wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def impute(df: DataFrame, features: list[str], how: str = "mean") -> DataFrame:
    """Nulls of each feature become its mean or its exact median; a feature without values keeps its nulls."""
    if how == "median":
        found = {r.fi: r.q[0] for r in quantiles(melt(df, features, []), ["fi"], "v", [0.5]).collect()}  # a row per feature
        return _mapped(df, df, features, lambda x, k: F.coalesce(x, F.lit(found.get(k)).cast("double")))
    wide = _with_stats(df, features, {"fill": {"mean": F.avg}[how]})
    return _mapped(df, wide, features, lambda x, k: F.coalesce(x, F.col(f"fill__{k}")))


def _spread(x: Column) -> Column:
    return F.when(x == 0, TINY).otherwise(x)


def standard_scale(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; std 0 counts as 1e-10. ``fit_on`` holds the rows to learn from."""
    row = (df if fit_on is None else fit_on).agg(
        *[f(F.col(c).cast("double")).alias(f"{n}__{k}") for k, c in enumerate(features) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    wide = df.crossJoin(F.broadcast(row))  # one row
    return _mapped(df, wide, features, lambda x, k: (x - F.col(f"mean__{k}")) / _spread(F.col(f"std__{k}")))


def standard_unscale(df: DataFrame, features: list[str], fit_on: DataFrame) -> DataFrame:
    """The inverse of ``standard_scale`` fitted on ``fit_on``."""
    row = fit_on.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}__{k}") for k, c in enumerate(features) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    wide = df.crossJoin(F.broadcast(row))  # one row
    return _mapped(df, wide, features, lambda x, k: x * _spread(F.col(f"std__{k}")) + F.col(f"mean__{k}"))


def minmax_scale(df: DataFrame, features: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Into [low, high]; a constant column gives ``low``."""
    wide = _with_stats(df, features, {"min": F.min, "max": F.max})
    scaled = lambda x, k: (x - F.col(f"min__{k}")) / _spread(F.col(f"max__{k}") - F.col(f"min__{k}")) * (high - low) + low
    return _mapped(df, wide, features, scaled)


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test: exactly max(1, int(n * test_size)) rows, the first of the seeded shuffle."""
    ranked = shuffled_rank(df, row_id, seed, name="__rank")
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(test_size)))).alias("__test"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("is_test", F.col("__rank") <= F.col("__test")).drop("__rank", "__test")


def stratified_split(df: DataFrame, row_id: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test: max(1, int(n_c * test_size)) rows of each class. A class of one row is all test."""
    ranked = shuffled_rank(df, row_id, seed, by=[label], name="__rank")
    n = df.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(test_size)))).alias("__test"))
    return ranked.join(n, label).withColumn("is_test", F.col("__rank") <= F.col("__test")).drop("__rank", "__test")


def hashed_split(df: DataFrame, row_id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test by a hash threshold: sizes are only about right, but nothing is shuffled."""
    share = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("is_test", share < test_size)


def preprocess(
    df: DataFrame, row_id: str, features: list[str], missing: str = "none", scale: str = "none", test_size: float | None = None, seed: int = 42
) -> DataFrame:
    """Missing values (none, drop, mean, median), then scaling (none, standard, minmax), then maybe a split."""
    if missing == "drop":
        df = drop_missing(df, features)
    elif missing != "none":
        df = impute(df, features, missing)
    if scale != "none":
        df = {"standard": standard_scale, "minmax": minmax_scale}[scale](df, features)
    return df if test_size is None else train_test_split(df, row_id, test_size, seed)
