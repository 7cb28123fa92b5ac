"""Ingest queries over tables turned into cells of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.functions.columns import MISSING, NUMBER
from tabmine.jobs.registry import query, report, table
from tabmine.sources import delimited, results
from tabmine.sources.files import scratch

_CELLS = """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN 'NA' WHEN c_custkey % 11 = 0 THEN '3d' WHEN c_custkey % 13 = 0 THEN ' ' ELSE ' ' || CAST(c_nationkey AS VARCHAR) || ' ' END AS nation,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey * 2 AS VARCHAR) || '.5' END AS twice, c_mktsegment || ' ' AS segment FROM customer"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    nation = F.when(k % 7 == 0, "NA").when(k % 11 == 0, "3d").when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), nation.alias("nation"),
        F.when(k % 5 == 0, "").otherwise(F.concat((k * 2).cast("string"), F.lit(".5"))).alias("twice"), F.concat("c_mktsegment", F.lit(" ")).alias("segment"),
    )


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@query("ingest_labelled", f"SELECT id AS row_id, {_number('nation')} AS nation, {_number('twice')} AS twice, trim(segment) AS label FROM ({_CELLS})")
def ingest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(delimited.labelled(cells(spark, sf_dir), row_id="id"))


_FILE = f"""SELECT id AS row_id, {_number('nation')} AS nation, {_number('twice')} AS twice, replace(trim(segment), 'M', 'M, ') AS label FROM ({_CELLS})"""


def _written(spark: SparkSession, rows: DataFrame, delimiter: str = ",") -> str:
    """A folder of delimited files with headers; fields that hold the delimiter are quoted."""
    path = scratch(spark, "cells")
    rows.write.option("header", True).option("emptyValue", "").option("sep", delimiter).csv(path)
    return path


@query("ingest_file", _FILE)
def ingest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as delimited text and read back, quoted labels and missing cells included."""
    path = _written(spark, cells(spark, sf_dir).withColumn("segment", F.regexp_replace(F.trim("segment"), "M", "M, ")))
    return report(delimited.labelled(delimited.read_cells(spark, path, header=True), row_id="id"))


@query("ingest_detected", """SELECT '|' AS delimiter, true AS has_header, o_orderstatus AS label, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total,
    CAST(0 AS BIGINT) AS n_missing FROM orders GROUP BY o_orderstatus""")
def ingest_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a file of which nothing is known: delimiter and header are found out, rows get ids from their content."""
    path = _written(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "|")
    lines = delimited.head(spark, path)
    found = delimited.detect_delimiter(lines)
    rows = delimited.labelled(delimited.read_cells(spark, path))
    stats = rows.groupBy("label").agg(F.count_distinct("row_id").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_custkey").isNull()).alias("n_missing"))
    return stats.select(F.lit(found).alias("delimiter"), F.lit(delimited.detect_header(lines, found)).alias("has_header"), "label", "n_rows", "total", "n_missing")


_PER_STATUS = "SELECT o_orderstatus AS algorithm, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY o_orderstatus"


@query("results_files", f"""SELECT 'orders' AS "Dataset", algorithm AS "Algorithm", mean AS "Accuracy", std AS "Accuracy_Std", mean AS value FROM ({_PER_STATUS})""")
def results_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table written as JSON and as CSV, both read back."""
    stats = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("algorithm")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std")
    )
    rows = stats.select(F.lit("orders").alias("dataset"), "algorithm", F.lit("accuracy").alias("metric"), "mean", "std", F.lit(None).cast("string").alias("error"))
    as_json, as_csv = scratch(spark, "results"), scratch(spark, "results")
    results.write_json(rows.withColumnRenamed("mean", "value"), as_json)
    results.write_csv(rows, as_csv)
    schema = "Dataset string, Algorithm string, " + ", ".join(f"{c} double" for c in results.COLUMNS)
    back = spark.read.schema(schema).option("header", True).csv(as_csv).select("Dataset", "Algorithm", "Accuracy", "Accuracy_Std")
    return back.join(results.read_json(spark, as_json).select(F.col("algorithm").alias("Algorithm"), "value"), "Algorithm")


_MISSING = ", ".join(f"'{m}'" for m in MISSING)
_TEXT = ", ".join(f"count_if(NOT ({c} IS NULL OR trim({c}) IN ({_MISSING})) AND NOT regexp_matches(trim({c}), '{NUMBER}')) AS t{k}" for k, c in enumerate(("id", "nation", "twice", "segment")))


@query("infer_column_roles", f"""WITH t AS (SELECT {_TEXT} FROM ({_CELLS})), f AS (SELECT unnest([0, 1, 2, 3]) AS position, unnest(['id', 'nation', 'twice', 'segment']) AS name, unnest([t0, t1, t2, t3]) > 0 AS t FROM t),
    l AS (SELECT coalesce(max(position) FILTER (t), 3) AS p FROM f) SELECT position, name, CASE WHEN position = p THEN 'label' WHEN t THEN 'ignored' ELSE 'feature' END AS role FROM f, l""")
def infer_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.column_roles(cells(spark, sf_dir))


def catalog(sf_dir: str) -> dict[str, delimited.Dataset]:
    at = lambda name: f"{sf_dir}/{name}.parquet"
    return {
        "customer": delimited.Dataset(at("customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment"),
        "orders": delimited.Dataset(at("orders"), ["o_totalprice", "o_custkey"], "o_orderstatus"),
        "part": delimited.Dataset(at("part"), ["p_size", "p_retailprice"], "p_type"),
    }


@query("catalog_summary", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS n_rows, 2 AS n_features, count(DISTINCT {y}) AS n_classes, CAST(count_if({a} IS NULL) + count_if({b} IS NULL) AS BIGINT) AS n_missing FROM {t}"
    for t, a, b, y in (("customer", "c_acctbal", "c_nationkey", "c_mktsegment"), ("orders", "o_totalprice", "o_custkey", "o_orderstatus"), ("part", "p_size", "p_retailprice", "p_type"))))
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalog(sf_dir)
    return delimited.summary(delimited.load_all(spark, entries)[0], entries)
