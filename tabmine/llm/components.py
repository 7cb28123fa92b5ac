"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm.common import forget, stored


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    Each half step hangs nodes under the smallest neighbour: minima are partial aggregates, written
    before the join back to the edges so that the adaptive skew join can split a node with very many
    neighbours, and nothing is collected. Rounds grow with the logarithm of a component. Null ends are ignored, loops give no node.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        for half in (_large_star, _small_star):
            least, new = half(spark, edges)
            new = stored(spark, new, "edges")
            forget(spark, least)
            forget(spark, edges)
            edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of smallest neighbours (or the nodes themselves), and the larger neighbours hung under them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return least, both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of smallest neighbours, and each node with its smaller neighbours hung under them."""
    least = stored(spark, edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    rest = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least, rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
