"""Shared pieces: the shared scratch folder, tables written there, Arrow batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name prefix of helper columns, so that extra input columns never clash.
OWN = "__tm_"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset a temporary folder is
    made and set as the session's checkpoint folder, on a local master only: executors of a cluster
    would each write to a disk of their own, so there it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    Spark deletes the write's shuffle files as soon as it has ended, since nothing refers to them.
    """
    path, clean = scratch(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before) if before is not None else spark.conf.unset(clean)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read again."""
    if files := df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` (a stored table of short rows) marked for broadcast if it has at most ``most_rows`` rows.

    Larger ones meet the other side in an ordinary join, which adaptive execution may split.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hash_key(id_col: str = "doc_id") -> Column:
    """What samples are drawn by: a hash of the id."""
    return F.xxhash64(F.col(id_col).cast("long"))


def hash_cuts(rows: DataFrame, n: int, id_col: str = "doc_id", by: str | None = None) -> dict:
    """For each value of ``by`` (None: for all rows) the hash key of the ``n``-th smallest distinct id's key.

    Reads ids and ``by`` only. The rows whose key is at most that are the sample: n ids of each class, the
    same for any partitioning. Counts give each class a threshold that four times as many rows should pass,
    so that what is ranked is bounded; it is widened eightfold for classes where, for repeated ids, fewer
    than n pass. Null ids and null classes are never drawn.
    """
    ids = rows.select(hash_key(id_col).alias("key"), (F.lit(0) if by is None else F.col(by)).alias("by"), F.col(id_col).alias("id"))
    ids = ids.filter("id is not null and by is not null").select("key", "by")
    totals = {r.by: r.n for r in ids.groupBy("by").agg(F.count("*").alias("n")).collect()}  # a row per class

    def ranked(limits: dict) -> dict:
        hit = F.lit(False)
        for value, limit in limits.items():
            hit |= (F.col("by") == F.lit(value)) & (F.col("key") <= F.lit(limit))
        rank = F.row_number().over(Window.partitionBy("by").orderBy("key"))
        first = ids.filter(hit).distinct().withColumn("rank", rank).filter(F.col("rank") <= n)
        return {r.by: (r.key, r.n) for r in first.groupBy("by").agg(F.max("key").alias("key"), F.count("*").alias("n")).collect()}

    top = (1 << 63) - 1
    limits = {v: min(top, -(1 << 63) + (4 * n << 64) // total) if total > 8 * n else top for v, total in totals.items()}
    found: dict = {}
    while limits:
        found |= ranked(limits)
        short = {v: limit for v, limit in limits.items() if limit < top and found.get(v, (0, 0))[1] < n}
        limits = {v: min(top, (limit + (1 << 63)) * 8 - (1 << 63)) for v, limit in short.items()}
    return {v: key for v, (key, _) in found.items()}


def in_sample(cuts: dict, id_col: str = "doc_id", by: str | None = None) -> Column:
    """Whether a row belongs to the sample that ``hash_cuts`` bounds."""
    hit = F.lit(False)
    for value, cut in cuts.items():
        one = F.col(id_col).isNotNull() & (hash_key(id_col) <= F.lit(cut))
        hit |= one if by is None else one & (F.col(by) == F.lit(value))
    return F.coalesce(hit, F.lit(False))


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), null texts as empty: what most operators read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def each_batch(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most ``rows`` rows, to bound what Python holds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
