"""Profiling aggregates: one pass over the table, then a few rows per feature. Nulls are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import pearson
from tabmine.operators.frame import melt, quantiles


def _per_feature(df: DataFrame, features: list[str], **stats) -> DataFrame:
    """(fi, feature, stats...) from one wide aggregate; a stat is a function of a column."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{name}__{k}") for k, c in enumerate(features) for name, f in stats.items()])
    cells = [
        F.struct(F.lit(k).alias("fi"), F.lit(c).alias("feature"), *[F.col(f"{name}__{k}").alias(name) for name in stats])
        for k, c in enumerate(features)
    ]
    return row.select(F.inline(F.array(*cells)))


def overview(df: DataFrame, features: list[str], label: str) -> DataFrame:
    missing = [F.count_if(F.col(c).isNull()) for c in features]
    whole = missing[0]
    for m in missing[1:]:
        whole = whole + m
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(features)).alias("n_features"),
        F.count_distinct(F.col(label)).alias("n_classes"),
        whole.alias("n_missing"),
    )


def basic_stats(df: DataFrame, features: list[str]) -> DataFrame:
    return _per_feature(df, features, mean=F.avg, std=F.stddev_pop, min=F.min, max=F.max)


def full_stats(df: DataFrame, features: list[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Mean, population std, min, quartiles, max and missing count; quartiles interpolate if exact."""
    three = [0.25, 0.5, 0.75]
    others = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "missing": lambda c: F.count_if(c.isNull())}
    if exact:
        out = _per_feature(df, features, **others).join(quantiles(melt(df, features, []), ["fi"], "v", three), "fi", "left")
    else:
        out = _per_feature(df, features, **others, q=lambda c: F.percentile_approx(c, three, accuracy))
    q = [F.col("q")[k].alias(name) for k, name in enumerate(("q25", "median", "q75"))]
    return out.select("fi", "feature", "mean", "std", "min", *q, "max", "missing")


def skewness(df: DataFrame, features: list[str]) -> DataFrame:
    """n / ((n - 1)(n - 2)) times the sum of cubed z scores; 0 below 3 values or without spread."""
    m = _per_feature(df, features, n=F.count, g=F.skewness, std=F.stddev_pop)
    n = F.col("n").cast("double")
    value = F.when((n < 3) | (F.col("std") < 1e-10), 0.0).otherwise(n * n / ((n - 1) * (n - 2)) * F.col("g"))
    return m.select("fi", "feature", value.alias("skewness"))


def kurtosis(df: DataFrame, features: list[str]) -> DataFrame:
    """The sample-corrected excess kurtosis of population z scores; 0 below 4 values or without spread."""
    m = _per_feature(df, features, n=F.count, g=F.kurtosis, std=F.stddev_pop)
    n = F.col("n").cast("double")
    low = (n - 1) * (n - 2) * (n - 3)
    value = n * n * (n + 1) / low * (F.col("g") + 3) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    return m.select("fi", "feature", F.when((n < 4) | (F.col("std") < 1e-10), 0.0).otherwise(value).alias("kurtosis"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per class


def _pairs(df: DataFrame, features: list[str], name: str, f) -> DataFrame:
    """(i, j, name) of all ordered pairs from one aggregate over the upper triangle."""
    d = range(len(features))
    x = [F.col(c).cast("double") for c in features]
    row = df.agg(*[f(x[i], x[j]).alias(f"p{i}_{j}") for i in d for j in d if i <= j])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{min(i, j)}_{max(i, j)}").alias(name)) for i in d for j in d]
    return row.select(F.inline(F.array(*cells)))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson r of all pairs, each over the rows that have both values; null without spread."""
    return _pairs(df, features, "r", pearson)


def covariances(df: DataFrame, features: list[str]) -> DataFrame:
    return _pairs(df, features, "cov", F.covar_samp)


def top_correlations(df: DataFrame, features: list[str], above: float = 0.3, first: int = 20, k: int = 15) -> DataFrame:
    """The k strongest pairs i < j of the first features with |r| > above, r rounded to 4 digits."""
    r = correlations(df, features[:first]).filter(F.col("i") < F.col("j")).withColumn("r", F.round("r", 4) + F.lit(0.0))
    return r.filter(F.abs("r") > above).orderBy(F.desc(F.abs("r")), "i", "j").limit(k)
