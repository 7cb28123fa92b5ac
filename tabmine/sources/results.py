"""Benchmark results on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a results file, by metric and statistic.
COLUMNS = {
    "Accuracy": ("accuracy", "mean"), "Accuracy_Std": ("accuracy", "std"), "F1_Macro": ("f1_macro", "mean"), "F1_Std": ("f1_macro", "std"),
    "Train_Time": ("train_time", "mean"), "Time_Std": ("train_time", "std"),
}


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_csv(summary: DataFrame, path: str) -> None:
    """(dataset, algorithm, metric, mean, std) as one row per cell with 6 decimals; cells with an error are left out."""
    rows = summary.filter("error is null") if "error" in summary.columns else summary
    value = lambda m, c: F.round(F.first(F.when(F.col("metric") == m, F.col(c)), ignorenulls=True), 6)
    columns = [value(*of).alias(name) for name, of in COLUMNS.items()]
    rows.groupBy(F.col("dataset").alias("Dataset"), F.col("algorithm").alias("Algorithm")).agg(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dataset string, algorithm string, metric string, value double, std double, error string").json(path)
