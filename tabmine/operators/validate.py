"""Folds, cross-validation, benchmark grids and result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import argmax
from tabmine.operators import knn, metrics, naive_bayes, tree
from tabmine.operators.frame import shuffled_rank
from tabmine.operators.select import fold_models

METRICS = ["accuracy", *[f"{m}_{a}" for a in ("macro", "micro", "weighted") for m in ("precision", "recall", "f1")]]
RESULT_SCHEMA = "dataset string, algorithm string, metric string, value double, std double, error string"


def kfold(rows: DataFrame, k: int = 5, seed: int = 42, row_id: str = "row_id", name: str = "fold") -> DataFrame:
    """``rows`` with fold 0..k-1 from the seeded shuffle; the first n mod k folds have one row more."""
    ranked = shuffled_rank(rows, row_id, seed, name="__rank").crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n"))))  # one row
    size, extra, at = F.floor(F.col("__n") / k), F.col("__n") % k, F.col("__rank") - 1
    large = extra * (size + 1)
    fold = F.when(at < large, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - large) / F.greatest(size, F.lit(1))))
    return ranked.withColumn(name, fold.cast("int")).drop("__rank", "__n")


def gaussian_fold_predictions(folded: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(row_id, fold, y, pred): each row by the model of the other folds; one scan fits all of them."""
    models = naive_bayes.packed(fold_models(folded, smoothing), ["fold"])
    scored = folded.join(F.broadcast(models), "fold")  # a row per fold
    scored = scored.withColumn("ll", naive_bayes.gaussian_log_likelihood(F.col("x"), F.col("classes")))
    names = F.transform("classes", lambda c: c["y"])
    return scored.select("row_id", "fold", "y", names[argmax(F.transform("ll", lambda v: F.round(v, 9)))].alias("pred"))


def knn_fold_predictions(folded: DataFrame, k: int = 5, weights: str = "uniform", sigma: float = 1.0) -> DataFrame:
    """(row_id, fold, y, pred): neighbours are looked for in the other folds, in one job."""
    found = knn.neighbors(folded, folded, k, group="fold")
    best = knn.predict(knn.vote(found, weights, sigma))
    return folded.join(best, F.col("row_id") == F.col("qid")).select("row_id", "fold", "y", "pred")


def looped_fold_predictions(folded: DataFrame, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(row_id, fold, y, pred) for any model: fit(rows) gives a function that adds pred to rows."""
    out = None
    for fold in range(k):
        part = fit(folded.filter(F.col("fold") != fold))(folded.filter(F.col("fold") == fold)).select("row_id", F.lit(fold).alias("fold"), "y", "pred")
        out = part if out is None else out.unionByName(part)
    return out


def tree_fold_predictions(folded: DataFrame, k: int, classes: int, features: int, **params) -> DataFrame:
    """(row_id, fold, y, pred) by a tree per fold; all of them grow in the same jobs."""
    training = folded.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("tree <> fold")
    grown = tree.grow_all(training, k, classes, features, **params)
    return tree.predict_all(folded.withColumn("tree", F.col("fold")), grown).select("row_id", "fold", "y", "pred")


def repeated(rows: DataFrame, predict: Callable[[DataFrame, int], DataFrame], k: int = 5, runs: int = 1, seed: int = 42) -> DataFrame:
    """(row_id, fold, y, pred) of ``runs`` cross-validations, run r shuffled by seed + 100 r; folds are numbered on."""
    out = None
    for r in range(runs):
        part = predict(kfold(rows, k, seed + 100 * r), k).withColumn("fold", F.col("fold") + k * r)
        out = part if out is None else out.unionByName(part)
    return out


def cross_validated(predictions: DataFrame) -> DataFrame:
    """(metric, mean, std) over folds; std is the population's."""
    per_fold = metrics.summary(metrics.confusion(predictions, by=["fold"]), ["fold"])
    cells = per_fold.unpivot("fold", METRICS, "metric", "value")
    return cells.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def grid(
    spark: SparkSession, datasets: Mapping[str, DataFrame], algorithms: Mapping[str, Callable[[DataFrame, int], DataFrame]], k: int = 5, runs: int = 1
) -> DataFrame:
    """(dataset, algorithm, metric, value, std, error) of every cell; a failing cell has only its error.

    An algorithm is a function from a folded frame and k to (row_id, fold, y, pred), or with the attribute
    ``clusters`` from the frame and the number of runs to (metric, mean, std). value and std are over all
    folds of all runs.
    """
    rows = []
    for dataset, frame in datasets.items():
        for algorithm, predict in algorithms.items():
            try:
                whole = getattr(predict, "clusters", False)
                found = predict(frame, runs) if whole else cross_validated(repeated(frame, predict, k, runs)).collect()  # a row per metric
                rows += [(dataset, algorithm, metric, mean, std, None) for metric, mean, std in found]
            except Exception as error:  # a broken cell must not lose the others
                rows.append((dataset, algorithm, None, None, None, str(error)[:200]))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def result_matrix(results: DataFrame, metric: str = "accuracy", algorithms: list[str] | None = None) -> DataFrame:
    """A row per dataset and a column per algorithm; missing cells are 0."""
    some = results.filter(F.col("metric") == metric)
    pivot = some.groupBy("dataset").pivot("algorithm", algorithms) if algorithms else some.groupBy("dataset").pivot("algorithm")
    return pivot.agg(F.first("value")).na.fill(0.0)


def best_algorithms(results: DataFrame, metric: str = "accuracy", without: tuple[str, ...] = ("kmeans",)) -> DataFrame:
    """(dataset, algorithm, value): the best one by name on ties; clustering doesn't compete."""
    some = results.filter((F.col("metric") == metric) & ~F.col("algorithm").isin(*without))
    order = Window.partitionBy("dataset").orderBy(F.desc(F.round("value", 9)), "algorithm")  # a row per algorithm
    ranked = some.withColumn("rank", F.row_number().over(order))
    return ranked.filter("rank = 1").select("dataset", "algorithm", "value")
