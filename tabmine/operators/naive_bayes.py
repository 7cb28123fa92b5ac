"""Naive Bayes from aggregates: Gaussian over feature frames, multinomial over sparse counts."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmine.functions.columns import argmax, total
from tabmine.operators.frame import few, long
from tabmine.sources.files import stored


def fit_gaussian(rows: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(y, fi, log_prior, mean, var); var is the population variance plus ``smoothing``."""
    cells = long(rows).groupBy("y", "fi").agg(F.avg("v").alias("mean"), (F.var_pop("v") + smoothing).alias("var"))
    n = rows.groupBy("y").agg(F.count("*").alias("n"))
    prior = n.select("y", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("log_prior"))  # a row per class
    return cells.join(few(prior), "y")


def packed(model: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (by..., classes): every class with its means and variances in feature order, by class."""
    by = by or []
    params = F.array_sort(F.collect_list(F.struct("fi", "mean", "var")))
    classes = model.groupBy(*by, "y", "log_prior").agg(params.alias("p"))
    return classes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y", "log_prior", "p"))).alias("classes"))


def gaussian_log_likelihood(x: Column, classes: Column) -> Column:
    """log prior plus log density of x, per class in the order of ``classes``."""

    def term(v: Column, p: Column) -> Column:
        return -0.5 * F.log(2 * pi * p["var"]) - (v - p["mean"]) * (v - p["mean"]) / (2 * p["var"])

    return F.transform(classes, lambda c: c["log_prior"] + total(F.zip_with(x, c["p"], term)))


def probabilities(log_likelihood: Column) -> Column:
    e = F.transform(log_likelihood, lambda v: F.exp(v - F.array_max(log_likelihood)))
    return F.transform(e, lambda v: v / total(e))


def predict_gaussian(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(row_id, y, classes, ll, pred, proba). The model is one row of K * d numbers, broadcast."""
    scored = rows.crossJoin(F.broadcast(packed(model)))
    scored = scored.withColumn("ll", gaussian_log_likelihood(F.col("x"), F.col("classes")))
    names = F.transform("classes", lambda c: c["y"])
    near = F.transform("ll", lambda v: F.round(v, 9))  # equal up to the order of additions
    return scored.select("row_id", "y", names.alias("classes"), "ll", names[argmax(near)].alias("pred"), probabilities(F.col("ll")).alias("proba"))


def fit_multinomial(counts: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """From counts (row_id, term, n) and labels (row_id, y): (y, term, log_p) and (y, log_prior, log_unseen).

    Counts may come in parts that add up; counts that bring their y along (null: not labelled) aren't joined.
    Only terms a class has get a row; the others of the vocabulary share the class's log_unseen, so the
    model grows with the pairs seen. A negative count is an error.
    """
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("counts must not be negative"))).otherwise(F.col("n"))
    known = counts if "y" in counts.columns else counts.join(labels, "row_id")
    known = known.filter("y is not null").select("row_id", "y", "term", checked.alias("n"))
    seen = stored(known.groupBy("y", "term").agg(F.sum("n").alias("n")), "term-counts")  # several tables come from it
    size = seen.agg(F.count_distinct("term").alias("v"))
    rows = labels.groupBy("y").agg(F.count("*").alias("docs"))
    prior = rows.select("y", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy())).alias("log_prior"))  # a row per class
    totals = seen.groupBy("y").agg(F.sum("n").alias("all_n"))
    base = prior.join(totals, "y", "left").crossJoin(size)
    below = F.log(F.coalesce("all_n", F.lit(0)) + alpha * F.col("v"))
    classes = base.select("y", "log_prior", (F.log(F.lit(alpha)) - below).alias("log_unseen"), below.alias("log_below"))
    terms = seen.join(F.broadcast(classes), "y").select("y", "term", (F.log(F.col("n") + alpha) - F.col("log_below")).alias("log_p"))  # a row per class
    return terms, classes.drop("log_below")


def multinomial_log_likelihood(counts: DataFrame, ids: DataFrame, terms: DataFrame, classes: DataFrame) -> DataFrame:
    """(row_id, y, ll) for all rows of ``ids`` and all classes. Terms outside the vocabulary count nothing.

    The model is one row per term with the terms' log probabilities of all classes, log_unseen where a class
    lacks it. A vocabulary of bounded size is broadcast, so that counts are added up where they are; a larger
    one is joined after adding up equal terms of a row. One aggregate sums all classes.
    """
    known = classes.orderBy("y").collect()  # a row per class
    of = lambda k: F.max(F.when(F.col("y") == known[k].y, F.col("log_p")))
    model = terms.groupBy("term").agg(*[F.coalesce(of(k), F.lit(known[k].log_unseen)).alias(f"p{k}") for k in range(len(known))])
    small = few(model, 200_000)
    if small is model:
        counts = counts.groupBy("row_id", "term").agg(F.sum("n").alias("n"))
    got = counts.join(small, "term").groupBy("row_id").agg(*[F.sum(F.col("n") * F.col(f"p{k}")).alias(f"s{k}") for k in range(len(known))])
    out = ids.select("row_id").join(got, "row_id", "left")
    ll = F.array(*[F.struct(F.lit(c.y).alias("y"), (c.log_prior + F.coalesce(f"s{k}", F.lit(0.0))).alias("ll")) for k, c in enumerate(known)])
    return out.select("row_id", F.inline(ll))


def predict_from_log_likelihood(ll: DataFrame) -> DataFrame:
    """(row_id, pred, proba) from (row_id, y, ll); ties go to the lowest class."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "ll")))
    rows = ll.groupBy("row_id").agg(ordered.alias("o"))
    score = F.transform("o", lambda s: s["ll"])
    near = F.transform(score, lambda v: F.round(v, 9))
    return rows.select("row_id", F.transform("o", lambda s: s["y"])[argmax(near)].alias("pred"), probabilities(score).alias("proba"))
