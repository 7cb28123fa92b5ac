"""Kernel machines in the dual and perceptrons by local steps: trained on four fifths of the embeddings, applied to the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs.neighbours import split
from tabmine.jobs.registry import query, report
from tabmine.operators import dual_svm, local_steps, svm

#: Kernels and their parameters; no gamma is 1 / (d var) of the training rows.
KERNELS = {"linear": {}, "rbf": {}, "poly": {"degree": 3, "coef0": 1.0}}


def machine(train: DataFrame, kernel: str) -> dual_svm.Machine:
    gamma = {} if kernel == "linear" else {"gamma": svm.scale_gamma(train)}
    return dual_svm.train(train, list(range(10)), kernel, **gamma, **KERNELS[kernel])


def _svm(kernel: str) -> None:
    @query(f"svm_dual_{kernel}")
    def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
        test, train = split(spark, sf_dir)
        return machine(train, kernel).predict(test).select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), "pred")

    @query(f"svm_dual_{kernel}_vectors")
    def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
        """(sv_id, a, b, alpha, signed): every support vector of every pair of classes."""
        found = machine(split(spark, sf_dir)[1], kernel)
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in found.pairs])
        rows = found.vectors.select("sv_id", "y", F.explode(F.arrays_zip(pairs.alias("pair"), "alpha")).alias("p")).filter("p.alpha > 0")
        rows = rows.select("sv_id", "p.pair.a", "p.pair.b", F.col("p.alpha").alias("alpha"), "y")
        return report(rows.select("sv_id", "a", "b", "alpha", F.when(F.col("y") == F.col("a"), F.col("alpha")).otherwise(-F.col("alpha")).alias("signed")))

    @query(f"svm_dual_{kernel}_gap")
    def gap(spark: SparkSession, sf_dir: str) -> DataFrame:
        """(a, b, intercept, gap, rounds) of every pair of classes; gap is that of primal and dual, over the primal."""
        found = machine(split(spark, sf_dir)[1], kernel)
        rows = [(a, b, float(i), float(g), found.rounds) for (a, b), i, g in zip(found.pairs, found.intercept, found.gap, strict=True)]
        return report(spark.createDataFrame(rows, "a int, b int, intercept double, gap double, rounds int"))


for _name in KERNELS:
    _svm(_name)


@query("svm_dual_decision")
def svm_dual_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, a, b, decision): what the learned support vectors of each pair say about the held-out rows."""
    test, train = split(spark, sf_dir)
    found = machine(train, "rbf")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in found.pairs])
    rows = found.decide(test).select("row_id", F.explode(F.arrays_zip(pairs.alias("pair"), "decision")).alias("p"))
    return report(rows.select(F.col("row_id").alias("vec_id"), "p.pair.a", "p.pair.b", F.col("p.decision").alias("decision")))


def _trained(optimiser: str, rate: float) -> None:
    @query(f"mlp_train_{optimiser}")
    def train(spark: SparkSession, sf_dir: str) -> DataFrame:
        test, rows = split(spark, sf_dir)
        model = local_steps.train(rows, [16], 10, optimiser, rate, epochs=200)
        return model.predict(test).select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), "pred")


for _name, _rate in (("sgd", 0.05), ("momentum", 0.01), ("adam", 0.002)):
    _trained(_name, _rate)


@query("mlp_loss_history")
def mlp_loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(epoch, loss): the mean loss of each of 200 epochs of mini-batches of 32."""
    model = local_steps.train(split(spark, sf_dir)[1], [16], 10, "adam", 0.002, epochs=200)
    return report(spark.createDataFrame(list(enumerate(model.history, 1)), "epoch int, loss double"))
