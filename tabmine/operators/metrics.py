"""Metrics from one shuffled confusion table, and ROC curves without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmine.operators.frame import ranged, running_sums
from tabmine.sources.files import stored


def confusion(predictions: DataFrame, true: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """(by..., true_label, pred_label, n) over the full grid 0..max label, zeros included."""
    by = by or []
    seen = predictions.groupBy(*by, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    seen = stored(seen, "seen")  # read twice or more below, and predictions may be costly
    top = seen.agg(F.max(F.greatest("true_label", "pred_label")).alias("top"))
    codes = F.sequence(F.lit(0), F.col("top"))
    grid = top.select(F.explode(codes).alias("true_label"), "top").select("true_label", F.explode(codes).alias("pred_label"))
    if by:
        grid = seen.select(*by).distinct().crossJoin(F.broadcast(grid))  # K * K rows
    return grid.join(seen, [*by, "true_label", "pred_label"], "left").na.fill(0, ["n"])


def per_class(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., label, support, precision, recall, f1); undefined values are 0."""
    by = by or []
    both = matrix.select(*by, F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
    )).alias("c")).select(*by, "c.*")
    sums = both.groupBy(*by, "label").agg(F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("claimed")), ratio(F.col("hit"), F.col("support"))
    out = sums.withColumns({"precision": p, "recall": r})
    p, r = F.col("precision"), F.col("recall")
    return out.select(*by, "label", "support", "hit", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"))


def summary(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (by...): accuracy, and macro, micro and weighted precision, recall and F1.

    Macro averages run over all labels up to the largest one, absent ones count as 0. With one label per
    row, micro precision, recall and F1 are the accuracy.
    """
    by = by or []
    c = per_class(matrix, by)
    n = F.sum("support")
    weighted = lambda x: F.sum(F.col(x) * F.col("support")) / n
    micro = F.sum("hit") / n
    return c.groupBy(*by).agg(
        micro.alias("accuracy"),
        *[F.avg(x).alias(f"{x}_macro") for x in ("precision", "recall", "f1")],
        *[micro.alias(f"{x}_micro") for x in ("precision", "recall", "f1")],
        *[weighted(x).alias(f"{x}_weighted") for x in ("precision", "recall", "f1")],
    )


def roc(scores: DataFrame, score: str = "score", positive: str = "positive", by: list[str] | None = None, size: int = 65_536) -> DataFrame:
    """(by..., threshold, tp, fp, tpr, fpr), one point per distinct score and a first one at (0, 0).

    The first point's threshold is null (it stands for infinity). With one class only the curve is the
    diagonal from (0, 0) to (1, 1).
    """
    by = by or []
    group = scores.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("f")
    )
    down = [F.desc("threshold")]
    dealt, bucket = ranged(group, down, size)
    points = running_sums(dealt, {"tp": F.col("p"), "fp": F.col("f")}, bucket, down, by)
    ends = group.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("f").alias("all_f"))
    points = points.join(ends, by) if by else points.crossJoin(F.broadcast(ends))  # one row
    rate = lambda x, n: F.col(x) / F.col(n)
    both = (F.col("all_p") > 0) & (F.col("all_f") > 0)
    real = points.filter(both).select(*by, "threshold", "tp", "fp", rate("tp", "all_p").alias("tpr"), rate("fp", "all_f").alias("fpr"))
    none = F.lit(None).cast("double")
    start = ends.select(*by, none.alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    diagonal = ends.filter(~both).select(*by, F.lit(0.0).alias("threshold"), F.col("all_p").alias("tp"), F.col("all_f").alias("fp"), F.lit(1.0).alias("tpr"), F.lit(1.0).alias("fpr"))
    return real.unionByName(start).unionByName(diagonal)


def auc(curve: DataFrame, by: list[str] | None = None, size: int = 65_536) -> DataFrame:
    """(by..., auc) by the trapezoid rule; every bucket of the curve also gets the point before it."""
    by = by or []
    rank = F.coalesce(-F.col("threshold"), F.lit(float("-inf")))
    points, bucket = ranged(curve.withColumn("at", rank), ["at"], size)
    points = points.withColumn("bucket", F.lit(0) if bucket is None else bucket)
    inside = Window.partitionBy(*by, "bucket").orderBy("at")
    steps = points.withColumns({"x0": F.lag("fpr").over(inside), "y0": F.lag("tpr").over(inside)})
    area = F.sum((F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2)
    ends = steps.groupBy(*by, "bucket").agg(
        area.alias("area"), F.min_by("fpr", "at").alias("x_in"), F.min_by("tpr", "at").alias("y_in"),
        F.max_by("fpr", "at").alias("x_out"), F.max_by("tpr", "at").alias("y_out"),
    )
    across = Window.partitionBy(*by).orderBy("bucket")  # a row per bucket
    joint = (F.col("x_in") - F.lag("x_out").over(across)) * (F.col("y_in") + F.lag("y_out").over(across)) / 2
    ends = ends.withColumn("joint", joint)
    return ends.groupBy(*by).agg((F.coalesce(F.sum("area"), F.lit(0.0)) + F.coalesce(F.sum("joint"), F.lit(0.0))).alias("auc"))
