"""Filter interaction audit: what each filter removes at each step of every order of filters.

A document is reduced to a bit mask of the filters it fails, documents to counts per (part, mask, labels), a few
dozen cells a part whatever the number of documents. In long form, every mask stands against every step
of every order, and a running bit-or over the steps before tells which masks were removed earlier. The
metrics are conditional sums of cells over those rows, and sums over the windows of a filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmine.llm.common import stored, text_of

#: White space of a text, as the filters' definition has it.
SPACE = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text: A short, B repetitive, C capitals, D symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return {
        "A": n < 50,
        "B": distinct * 100 < n * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(spark: SparkSession, docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: bit k of ``mask`` is set if the document fails the k-th filter of ABCDE.

    E compares SHA-256 digests: the first id of each text that occurs twice or more joins back to the rows, a
    join of narrow rows that adaptive execution splits where one text is very frequent.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    mask = F.lit(0)
    for k, failed in enumerate(text_failures(text).values()):
        mask = mask.bitwiseOR(F.when(failed, 1 << k).otherwise(0))
    rows = stored(spark, rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = stored(spark, firsts, "firsts")  # both sides of the join are exchanges then, which can be split
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def order_steps(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(mask, filter_order, step, filter, bit, before): every mask against every step of every order.

    ``before`` is the running bit-or of the mask's failures at earlier steps. 2^n * n! * n rows: 19,200 for five filters.
    """
    orders = ["".join(names[k] for k in p) for p in permutations(range(len(names)))]
    masks = spark.range(1 << len(names)).select(F.col("id").cast("int").alias("mask"))
    steps = masks.select("mask", F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order"))
    steps = steps.select("mask", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), 1))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, 1 << k)]), F.col("filter"))
    earlier = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("bit", bit)
    return steps.withColumn("before", F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(earlier), F.lit(0)))


def metrics(spark: SparkSession, cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metrics per part, order and step of ``cells`` (part, mask, n, good, toxic), counts per part and mask."""
    rows = cells.join(F.broadcast(order_steps(spark, names)), "mask")
    failing, passed = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("before") == 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    steps = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(passed & ~failing).alias("kept"),
        total(passed & failing).alias("removed"),
        total(~passed & failing).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(passed & failing, "good").alias("good_lost"),
        total(passed & failing, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")  # n! rows a filter and part
    return steps.withColumn("shapley", shapley)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Counts documents (rows) per part, over the filters A to E in all 120 orders. Null texts are empty, so they
    fail A, and all empty texts are copies of each other; null parts are the part ''. Repeated rows count each
    time; rows that share a text's smallest id all pass E, and rows without an id pass it and have no
    labels. Of several labels of an id the larger counts; null labels count as 0. Very long texts are read
    whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    masks = failures(spark, docs, part)
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
    labels = labels.groupBy("doc_id").agg(one("quality"), one("toxic"))
    cells = masks.join(labels, "doc_id", "left").groupBy("part", "mask")
    cells = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return metrics(spark, stored(spark, cells, "cells"), "ABCDE")
