"""Feature selection: filters from one pass of aggregates, and wrappers around Gaussian naive Bayes."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import pearson, vector
from tabmine.operators.frame import few, literal_array, long, quantiles, shuffled_rank


def pearson_scores(rows: DataFrame) -> DataFrame:
    """(fi, score): |Pearson r| of each feature with the class code, 0 without spread."""
    cells = long(rows)
    r = F.coalesce(F.abs(pearson(F.col("v"), F.col("y"))), F.lit(0.0))
    return cells.groupBy("fi").agg(r.alias("score"))


def top(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best features; scores equal to 9 digits go by index."""
    return scores.orderBy(F.desc(F.round("score", digits)), "fi").limit(k)


def variance_filter(rows: DataFrame, above: float = 0.01, k: int | None = None) -> DataFrame:
    """(fi, score): features of population variance > above, the first k in index order."""
    kept = long(rows).groupBy("fi").agg(F.var_pop("v").alias("score")).filter(F.col("score") > above)
    return kept if k is None else kept.orderBy("fi").limit(k)


def mutual_information(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(fi, score): normalised mutual information of the binned feature and the class.

    Bin edges are ``bins`` + 1 quantiles, or each distinct value if there are fewer than ``bins``; equal
    edges count once and the last one is left out, so the last two of few values share a bin. A value's
    bin is how many edges are at most it.
    """
    cells = long(rows)
    distinct = cells.select("fi", "v").distinct().groupBy("fi").agg(F.count("*").alias("u")).filter(F.col("u") < bins)
    values = cells.join(few(distinct), "fi").groupBy("fi").agg(F.array_sort(F.collect_set("v")).alias("values"))  # fewer than ``bins``
    edges = quantiles(cells, ["fi"], "v", [k / bins for k in range(bins + 1)]).join(values, "fi", "left")
    edges = edges.select("fi", F.array_distinct(F.coalesce("values", "q")).alias("e"))
    edges = edges.select("fi", F.slice("e", F.lit(1), F.size("e") - 1).alias("e"))
    at = F.size(F.filter("e", lambda x: x <= F.col("v")))
    joint = cells.join(few(edges), "fi").groupBy("fi", at.alias("b"), "y").agg(F.count("*").alias("n"))
    by = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))  # noqa: E731  at most bins * K rows per feature
    joint = joint.select("fi", "y", "n", by("fi", "b").alias("nb"), by("fi", "y").alias("ny"), by("fi").alias("n_all"))
    p, pb, py = (F.col(c) / F.col("n_all") for c in ("n", "nb", "ny"))
    mi = joint.groupBy("fi").agg(F.sum(p * F.log2(p / (pb * py) + 1e-10)).alias("mi"))
    classes = joint.select("fi", "y", "ny", "n_all").distinct()
    h = classes.groupBy("fi").agg(F.sum(-py * F.log2(py)).alias("h"))
    return mi.join(h, "fi").select("fi", (F.col("mi") / (F.col("h") + 1e-10)).alias("score"))


def with_cv_fold(rows: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """``rows`` with fold 0..folds-1 of n // folds rows each; the remainder (fold null) is never validated."""
    ranked = shuffled_rank(rows, "row_id", seed, name="__rank")
    n = rows.agg(F.floor(F.count("*") / folds).alias("__size"))
    fold = F.floor((F.col("__rank") - 1) / F.col("__size")).cast("int")
    return ranked.crossJoin(F.broadcast(n)).withColumn("fold", F.when(fold < folds, fold)).drop("__rank", "__size")  # one row


def fold_models(rows: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(fold, y, fi, log_prior, mean, var): a Gaussian model per fold, fitted on all rows outside it.

    One scan gathers n, sum and sum of squares per (fold, class, feature), taken around the feature's
    mean so that differences of sums keep their digits; a fold's model is the total minus the fold.
    """
    centre = long(rows).groupBy("fi").agg(F.avg("v").alias("c"))
    cells = long_with(rows, "fold").join(few(centre), "fi").withColumn("d", F.col("v") - F.col("c"))
    own = cells.groupBy(F.coalesce("fold", F.lit(-1)).alias("own"), "y", "fi", "c").agg(
        F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")
    )
    folds = rows.select("fold").filter("fold is not null").distinct()
    rest = own.crossJoin(F.broadcast(folds)).filter("own <> fold").groupBy("fold", "y", "fi", "c")  # a row per fold
    rest = rest.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    m = F.col("s") / F.col("n")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("fold", "fi"))
    return rest.select("fold", "y", "fi", F.log(share).alias("log_prior"), (F.col("c") + m).alias("mean"), (F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)) + smoothing).alias("var"))


def long_with(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("row_id", "y", *keep, F.posexplode("x").alias("fi", "v"))


def cell_scores(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(row_id, fold, y, k, prior, terms): per validated row and class k the log density of each feature.

    Naive Bayes adds features up, so any subset's score is a sum over these terms: one scan serves all
    candidates of a wrapper step.
    """
    packed = models.groupBy("fold", F.col("y").alias("k"), "log_prior").agg(
        F.array_sort(F.collect_list(F.struct("fi", "mean", "var"))).alias("p")
    )
    term = lambda v, p: -0.5 * F.log(2 * pi * p["var"]) - (v - p["mean"]) * (v - p["mean"]) / (2 * p["var"])
    joined = rows.filter("fold is not null").join(F.broadcast(packed), "fold")  # folds * K rows
    return joined.select("row_id", "fold", "y", "k", F.col("log_prior").alias("prior"), F.zip_with("x", "p", term).alias("terms"))


def changed_accuracies(scores: DataFrame, have: list[int], changes: list[int], sign: int) -> list[float]:
    """Mean accuracy over folds of ``have`` with each change added (sign 1) or taken away (-1), in one job.

    Ties go to the lowest class.
    """
    base = F.aggregate(literal_array(have, "int"), F.col("prior"), lambda acc, i: acc + F.col("terms")[i])
    rows = scores.withColumn("base", base)
    ranks = F.transform(literal_array(changes, "int"), lambda i: F.struct(i.alias("c"), F.round(F.col("base") + sign * F.col("terms")[i], 9).alias("ll")))
    each = rows.select("row_id", "fold", "y", "k", F.explode(ranks).alias("r")).select("row_id", "fold", "y", "k", "r.*")
    best = each.groupBy("row_id", "fold", "y", "c").agg(F.max_by("k", F.struct("ll", -F.col("k"))).alias("pred"))
    per_fold = best.groupBy("c", "fold").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("a"))
    found = {r.c: r.a for r in per_fold.groupBy("c").agg(F.avg("a").alias("a")).collect()}  # a row per candidate
    return [round(found[c], 9) for c in changes]


def model_accuracies(folded: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> Callable[[list[int], list[int], int], list[float]]:
    """The same for any model: fit(rows) gives a function that adds pred to rows; every candidate is cross-validated."""
    names = [r.fold for r in folded.select("fold").filter("fold is not null").distinct().orderBy("fold").collect()]  # some folds

    def accuracies(have: list[int], changes: list[int], sign: int) -> list[float]:
        out = []
        for c in changes:
            kept = sorted([*have, c]) if sign > 0 else [f for f in have if f != c]
            rows = folded.withColumn("x", F.array(*[F.col("x")[f] for f in kept]))
            hits = []
            for fold in names:
                found = fit(rows.filter(~F.col("fold").eqNullSafe(F.lit(fold))))(rows.filter(F.col("fold") == fold))
                hits.append(found.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0])
            out.append(round(sum(hits) / len(hits), 9))
        return out

    return accuracies


def _evaluator(rows: DataFrame, folds: int, seed: int, fit) -> tuple[DataFrame, Callable[[list[int], list[int], int], list[float]]]:
    """The persisted table that candidates are judged by, and their judge: Gaussian naive Bayes in one scan, or any model."""
    folded = with_cv_fold(rows, folds, seed)
    if fit is not None:
        folded = folded.persist()
        return folded, model_accuracies(folded, fit)
    scores = cell_scores(folded, fold_models(folded)).persist()
    return scores, lambda have, changes, sign: changed_accuracies(scores, have, changes, sign)


def forward_selection(rows: DataFrame, k: int, d: int, folds: int = 3, seed: int = 42, fit=None) -> list[tuple[int, float]]:
    """Features in the order they were added, with the accuracy reached; ties go to the lowest index.

    ``fit`` (rows -> function that adds pred) is the model to select for; None is Gaussian naive Bayes.
    """
    scores, accuracies = _evaluator(rows, folds, seed, fit)
    chosen: list[tuple[int, float]] = []
    while len(chosen) < min(k, d):
        have = [f for f, _ in chosen]
        left = [f for f in range(d) if f not in have]
        a = accuracies(have, left, 1)
        best = max(range(len(left)), key=lambda i: (a[i], -left[i]))
        chosen.append((left[best], a[best]))
    scores.unpersist()
    return chosen


def backward_elimination(rows: DataFrame, k: int, d: int, folds: int = 3, seed: int = 42, fit=None) -> list[tuple[int, float]]:
    """Features in the order they were dropped, with the accuracy kept; ties drop the last. k >= d drops none.

    ``fit`` as in ``forward_selection``.
    """
    scores, accuracies = _evaluator(rows, folds, seed, fit)
    have, dropped = list(range(d)), []
    while len(have) > k:
        a = accuracies(have, have, -1)
        best = max(range(len(have)), key=lambda i: (a[i], have[i]))
        dropped.append((have[best], a[best]))
        have.pop(best)
    scores.unpersist()
    return dropped


def keep_features(df: DataFrame, features: list[str], chosen: list[int]) -> DataFrame:
    """``df`` with a vector of the chosen features only."""
    return df.withColumn("x", vector([features[i] for i in sorted(chosen)]))
