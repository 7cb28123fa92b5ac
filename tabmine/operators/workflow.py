"""Any model by name: training, evaluation on held-out rows, cross-validation and benchmark grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmine.operators import kmeans, knn, local_steps, metrics, naive_bayes, prep, svm, tree, validate

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
MODELS = ("gaussian_nb", "knn", "c45", "svm", "mlp")


def fitter(name: str, classes: int, features: int, **params) -> Fit:
    """fit(rows) of a model: it learns from (row_id, x, y) and gives a function that returns (row_id, y, pred) of others."""

    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        if name == "gaussian_nb":
            model = naive_bayes.fit_gaussian(rows, **params)
            return lambda part: naive_bayes.predict_gaussian(part, model)
        if name == "knn":
            return lambda part: nearest(part, rows)
        if name == "c45":
            grown = tree.grow(rows, classes, features, **params)
            return lambda part: tree.predict(part, grown)
        if name == "svm":
            own = kernel if kernel.get("kernel", "linear") == "linear" or "gamma" in kernel else kernel | {"gamma": svm.scale_gamma(rows)}
            mapped = lambda part: svm.kernel_features(part, **own)
            return svm.train(mapped(rows), list(range(classes)), **machine).predict_mapped(mapped)
        if name == "mlp":
            return local_steps.train(rows, **({"hidden": [16], "classes": classes, "rate": 0.005} | params)).predict
        raise ValueError(f"no model named {name}")

    def nearest(part: DataFrame, rows: DataFrame) -> DataFrame:
        ballot = {k: v for k, v in params.items() if k in ("weights", "sigma")}
        found = knn.predict(knn.vote(knn.neighbors(part, rows, params.get("k", 5), params.get("metric", "euclidean")), **ballot))
        return part.join(found, F.col("row_id") == F.col("qid")).select("row_id", "y", "pred")

    kernel = {k: v for k, v in params.items() if k in ("kernel", "gamma", "coef0", "degree", "size", "seed")}
    machine = {k: v for k, v in params.items() if k not in kernel}
    return lambda rows: lambda part, model=fit(rows): model(part).select("row_id", "y", "pred")


def fold_predictions(name: str, classes: int, features: int, **params) -> Callable[[DataFrame, int], DataFrame]:
    """A function from a folded frame and its number of folds to (row_id, fold, y, pred).

    Naive Bayes, neighbours and trees serve all folds in the same jobs; the others are fitted fold by fold.
    """
    if name == "gaussian_nb":
        return lambda folded, k: validate.gaussian_fold_predictions(folded, **params)
    if name == "knn":
        return lambda folded, k: validate.knn_fold_predictions(folded, **params)
    if name == "c45":
        return lambda folded, k: validate.tree_fold_predictions(folded, k, classes, features, **params)
    return lambda folded, k: validate.looped_fold_predictions(folded, k, fitter(name, classes, features, **params))


def train_evaluate(
    df: DataFrame, row_id: str, features: list[str], label: str, name: str, missing: str = "none", scale: str = "standard", test_size: float = 0.2,
    seed: int = 42, folds: int = 0, **params,
) -> DataFrame:
    """One row of metrics of one model on held-out rows: fill gaps, scale, split, fit, predict, score.

    ``label`` holds codes 0, 1, ... With ``folds`` the row also has cv_accuracy, cv_accuracy_std and
    cv_f1_macro over all rows. K-Means ("kmeans") clusters all rows: inertia, silhouette.
    """
    ready = prep.preprocess(df, row_id, features, missing, scale)
    rows = ready.select(F.col(row_id).alias("row_id"), F.array(*features).alias("x"), F.col(label).cast("int").alias("y"))
    if name == "kmeans":
        return df.sparkSession.createDataFrame(kmeans.evaluate(rows, runs=1, seed=seed, **params), "run int, inertia double, silhouette double").drop("run")
    classes = (rows.agg(F.max("y")).first()[0] or 0) + 1
    split = prep.train_test_split(rows, "row_id", test_size, seed)
    model = fitter(name, classes, len(features), **params)(split.filter("not is_test").drop("is_test"))
    out = metrics.summary(metrics.confusion(model(split.filter("is_test").drop("is_test")))).select(*validate.METRICS)
    if not folds:
        return out
    cv = validate.cross_validated(validate.repeated(rows, fold_predictions(name, classes, len(features), **params), folds))
    pick = lambda m, c: F.first(F.when(F.col("metric") == m, F.col(c)), ignorenulls=True)
    row = cv.agg(pick("accuracy", "mean").alias("cv_accuracy"), pick("accuracy", "std").alias("cv_accuracy_std"), pick("f1_macro", "mean").alias("cv_f1_macro"))
    return out.crossJoin(F.broadcast(row))  # one row
