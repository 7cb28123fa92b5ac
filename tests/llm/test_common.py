"""The shared folder, samples by hashed id, and tables written there."""

import os

from pyspark.sql import functions as F

from tabmine.llm.common import forget, hash_cuts, in_sample, scratch, small, stored


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("c"))
    order = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for n in (1, 20, 900, 6000):
        cuts = hash_cuts(rows.repartition(7), n)
        assert sorted(r.doc_id for r in rows.filter(in_sample(cuts)).collect()) == sorted(order[:n])
    cuts = hash_cuts(rows, 50, by="c")
    got = [r.doc_id for r in rows.filter(in_sample(cuts, by="c")).collect()]
    assert sorted(got) == sorted(x for c in range(3) for x in [k for k in order if k % 3 == c][:50])
    nulls = spark.createDataFrame([(None, "a"), (3, "b")], "doc_id long, text string")
    assert [r.doc_id for r in nulls.filter(in_sample(hash_cuts(nulls, 1))).collect()] == [3]


def test_stored_tables(spark):
    out = stored(spark, spark.range(10).repartition(3), "t")
    assert out.count() == 10 and scratch(spark, "a") != scratch(spark, "a")
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    forget(spark, out)
    assert not os.path.exists(folder)


def test_small_marks_only_small_tables(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(spark.range(5))).lower()
    assert "broadcast" not in plan(small(spark.range(50), 10)).lower()
