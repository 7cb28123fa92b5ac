"""Queries for the tables behind distribution charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs import views as V
from tabmine.jobs.registry import query, report, table
from tabmine.operators import chartdata, frame

_LI = f"({V.LI_LONG_SQL})"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.melt(V.li(spark, sf_dir), V.LI, ["l_returnflag"]).withColumnRenamed("l_returnflag", "label")


def _histogram_sql(keys: str) -> str:
    return f"""WITH c AS (SELECT * FROM {_LI}), s AS (SELECT {keys}, min(v) AS lo0, max(v) AS hi0 FROM c GROUP BY ALL),
    r AS (SELECT {keys}, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
    n AS (SELECT {keys}, least(floor((v - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n FROM c JOIN r USING ({keys}) GROUP BY ALL),
    g AS (SELECT r.*, CAST(b AS INT) AS bin FROM r, range(0, 20) t(b))
    SELECT {keys}, g.bin, round(lo + g.bin * ((hi - lo) / 20), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) AS high,
    coalesce(n, 0) AS n FROM g LEFT JOIN n USING ({keys}, bin)"""


@query("histogram_bins", _histogram_sql("fi"))
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.histogram(_cells(spark, sf_dir), ["fi"]))


@query("histogram_bins_by_class", _histogram_sql("fi, label"))
def histogram_bins_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.histogram(_cells(spark, sf_dir), ["fi", "label"]))


@query("boxplot_stats", f"""WITH c AS (SELECT fi, v FROM {_LI}), q AS (SELECT fi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
    quantile_cont(v, 0.75) AS q3 FROM c GROUP BY fi), k AS (SELECT *, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS inside FROM c JOIN q USING (fi))
    SELECT fi, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v) FILTER (inside), 6) AS whisker_low,
    round(max(v) FILTER (inside), 6) AS whisker_high, CAST(count_if(NOT inside) AS BIGINT) AS n_outliers FROM k GROUP BY ALL""".replace(
    "GROUP BY ALL", "GROUP BY fi, q1, median, q3"))
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.boxplot(_cells(spark, sf_dir), ["fi"]))


@query("ecdf", f"""SELECT fi, v, CAST(sum(c) OVER (PARTITION BY fi ORDER BY v) AS BIGINT) AS n,
    round(sum(c) OVER (PARTITION BY fi ORDER BY v) / sum(c) OVER (PARTITION BY fi), 6) AS share
    FROM (SELECT fi, v, count(*) AS c FROM {_LI} GROUP BY fi, v)""")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.ecdf(_cells(spark, sf_dir), ["fi"]))


_ORD = "SELECT o_orderstatus AS label, o_totalprice AS v FROM orders"


@query("kde_grid", f"""WITH c AS ({_ORD}), s AS (SELECT label, CAST(count(*) AS DOUBLE) AS n, greatest(1.06 * stddev_pop(v) * pow(count(*), -0.2), 1e-6) AS h,
    min(v) AS lo, max(v) AS hi FROM c GROUP BY label), g AS (SELECT label, n, h, CAST(g AS INT) AS g, lo + g * (hi - lo) / 99 AS place FROM s, range(0, 100) t(g))
    SELECT label, g, round(place, 4) AS place, round(sum(exp(-0.5 * pow((place - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density
    FROM g JOIN c USING (label) GROUP BY label, g, place""")
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("v"))
    return report(chartdata.kde(rows, ["label"]), 4, density=12)


def _vec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.long(V.vec_frame(spark, sf_dir)).withColumnRenamed("y", "label")


@query("class_mean_profile", f"""WITH m AS (SELECT label, fi, avg(v) AS mean FROM ({V.VEC_LONG_SQL}) GROUP BY label, fi), r AS (SELECT *,
    min(mean) OVER (PARTITION BY fi) AS lo, max(mean) OVER (PARTITION BY fi) AS hi FROM m)
    SELECT label, fi, round(mean, 6) + 0.0 AS mean, round((mean - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled FROM r""")
def class_mean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.class_profile(_vec_cells(spark, sf_dir), "label"))


@query("class_feature_extrema", f"""SELECT label, fi, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max
    FROM ({V.VEC_LONG_SQL}) GROUP BY label, fi""")
def class_feature_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.extrema(_vec_cells(spark, sf_dir), "label"))


_SCALED = ", ".join(f"(f{k} - min(f{k}) OVER ()) / (max(f{k}) OVER () - min(f{k}) OVER () + 1e-10) AS f{k}" for k in range(V.DIMS))
_SAMPLE = f"""s AS (SELECT * FROM (SELECT vec_id, label, {_SCALED} FROM ({V.VEC_WIDE_SQL})) ORDER BY md5('42-' || vec_id), vec_id LIMIT 500)"""
_ROUNDED = ", ".join(f"round(f{k}, 6) AS f{k}" for k in range(V.DIMS))


@query("parallel_lines", f"""WITH {_SAMPLE} SELECT vec_id, label, {_ROUNDED} FROM (SELECT *,
    row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) AS rk FROM s) WHERE rk <= 100""")
def parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.parallel_lines(V.vec(spark, sf_dir), "vec_id", "label", V.VEC)[0])


@query("parallel_class_means", f"WITH {_SAMPLE} SELECT label, " + ", ".join(f"round(avg(f{k}), 6) AS f{k}" for k in range(V.DIMS)) + " FROM s GROUP BY label")
def parallel_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(chartdata.parallel_lines(V.vec(spark, sf_dir), "vec_id", "label", V.VEC)[1])


@query("bounded_sample", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 1000")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return chartdata.sample(rows, F.col("o_orderkey"), 1000)
