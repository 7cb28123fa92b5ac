"""Feature views of the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs.registry import table

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: The width of the embeddings.
DIMS = 64
VEC = [f"f{k}" for k in range(DIMS)]
CUST = ["c_acctbal", "n_orders", "sum_price", "avg_price"]
MISSING = ["o_totalprice", "o_custkey"]
USR = ["n_events", "sum_value", "avg_value", "max_value"]

#: (vec_id, label, x) and (vec_id, label, fi, v) of the embeddings.
VEC_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
VEC_LONG_SQL = f"SELECT vec_id, label, CAST(i - 1 AS INT) AS fi, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {DIMS + 1}) t(i)"
VEC_WIDE_SQL = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(DIMS)) + " FROM embeddings"
LI_LONG_SQL = " UNION ALL ".join(
    f"SELECT {k} AS fi, '{c}' AS feature, l_returnflag AS label, CAST({c} AS DOUBLE) AS v FROM lineitem" for k, c in enumerate(LI)
)
CUST_SQL = """SELECT c_custkey, c_mktsegment, c_acctbal, coalesce(n_orders, 0) AS n_orders, coalesce(sum_price, 0) AS sum_price,
    coalesce(avg_price, 0) AS avg_price FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders,
    sum(o_totalprice) AS sum_price, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
MISSING_SQL = """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS o_custkey FROM orders"""
USR_SQL = """SELECT user_id, CAST(count(*) AS DOUBLE) AS n_events, sum(value) AS sum_value, avg(value) AS avg_value, max(value) AS max_value
    FROM events GROUP BY user_id"""


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LI, "l_returnflag")


def vec(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    """(vec_id, label, f0 ...)."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[e[k].cast("double").alias(f"f{k}") for k in range(dims)])


def vec_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x, y)."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), x.alias("x"), F.col("label").alias("y"))


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with totals of their orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n_orders"), F.sum("o_totalprice").alias("sum_price"), F.avg("o_totalprice").alias("avg_price")
    )
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_mktsegment", "c_acctbal", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in CUST[1:]])


def with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with some cells turned into nulls."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(key % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 11 == 0, None).otherwise(F.col("o_custkey").cast("double")).alias("o_custkey"),
    )


def usr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with totals of their events."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").cast("double").alias("n_events"), F.sum("value").alias("sum_value"),
        F.avg("value").alias("avg_value"), F.max("value").alias("max_value"),
    )
