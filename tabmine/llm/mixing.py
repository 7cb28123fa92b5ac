"""Mixing sources to target weights: budgets flow down a domain-language-source tree.

A node's budget is split among its children by weight. A child whose subtree can't use its share (its
tokens times ``epochs``) keeps what it can use and the rest goes to its siblings; only what the whole
subtree can't use reaches the siblings of its ancestors. That is water-filling with the capacity of each
subtree, done by windows over the small table of nodes, one level at a time.

A leaf's budget is so many whole epochs and the beginning of one more, in an order seeded by leaf epoch.
The cut is found with a histogram of the order keys, so that only the one bucket it falls into (about
``bucket_rows`` rows) is ever sorted, however large the leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmine.llm.common import OWN, small, stored, text_of

LEVELS = ("domain", "lang", "source")
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text_col: str = "text") -> Column:
    """The default token measure: words between white space."""
    return F.size(F.array_remove(F.split(text_of(text_col), SPACE), "")).cast("long")


def domain_of(source_col: str = "source", domains: int = 4) -> Column:
    """The default domain: sources are dealt to ``domains`` domains by the number in their name."""
    number = F.regexp_extract(F.coalesce(F.col(source_col).cast("string"), F.lit("")), "([0-9]{1,9})$", 1).try_cast("long")
    return F.concat(F.lit("domain"), (F.coalesce(number, F.lit(0)) % domains).cast("string"))


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("double")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``grant`` to rows (parent..., name, cap, w, budget): water-filling of budget among siblings."""
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("cap") / F.col("w"), name)
    out = children.filter("w > 0 and cap > 0")
    out = out.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    full = F.col("cap").cast("double") * F.col("w_left") <= F.col("w") * (F.col("budget") - F.col("cap_before")).cast("double")
    out = out.withColumn("full", full)
    out = out.withColumns({
        "cap_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)),
        "w_rest": F.sum(F.when(~F.col("full"), F.col("w"))).over(family),
    })
    share = F.floor(F.col("w") * (F.col("budget") - F.col("cap_full")).cast("double") / F.col("w_rest")).cast("long")
    grant = F.when(F.col("full"), F.col("cap")).otherwise(F.least(share, F.col("cap")))
    return out.withColumn("grant", grant).drop("cap_before", "w_left", "full", "cap_full", "w_rest", "budget")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], epochs: int) -> DataFrame:
    """(domain, lang, source, have, grant) of the leaves that get anything to draw from."""
    caps = leaves.withColumn("cap", F.col("have") * epochs)
    budget = caps.agg(total.cast("long").alias("budget"))
    level = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", weights.get("domain", {})))
    level = fill(level.crossJoin(F.broadcast(budget)).withColumn("root", F.lit(0)), ["root"], "domain")  # one row
    for depth in (2, 3):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        name = keys[-1]
        child = caps.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("have").alias("have"))
        child = child.withColumn("w", _weight(name, weights.get(name, {})))
        above = level.select(*parent, F.col("grant").alias("budget"))
        level = fill(child.join(above, parent), parent, name)
    return level.select(*LEVELS, "have", "grant")


def order_key(seed: int, epoch: Column, id_col: str) -> Column:
    """60 bits of md5 over seed, epoch and id (null as empty), as hexadecimal digits."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.substring(F.md5(text), 1, 15)


def _edges(spark: SparkSession, keyed: DataFrame, digits: int, step: int = 3) -> DataFrame:
    """(LEVELS, edge, before): the bucket, a key prefix of ``digits``, that a leaf's cut falls into, and the tokens before it.

    The prefix grows ``step`` digits at a time within the bucket found so far, so no leaf ever has more than
    16 ** step buckets in a window, and each round only adds up what fell into the last round's buckets.
    Leaves whose rest covers all of them have no edge.
    """
    edge = None
    for done in range(0, max(1, digits), step):
        upto = min(digits, done + step)
        rows = keyed.select(*LEVELS, "rest", "n_tokens", F.substring("key", 1, upto).alias("bucket"))
        if edge is None:
            rows = rows.withColumn("before", F.lit(0).cast("long"))
        else:
            rows = rows.join(small(edge), list(LEVELS)).filter(F.substring("bucket", 1, done) == F.col("edge")).drop("edge")
        sums = rows.groupBy(*LEVELS, "bucket", "rest", "before").agg(F.sum("n_tokens").alias("t"))
        run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("upto", F.col("before") + F.sum("t").over(run)).filter("upto > rest")
        found = over.groupBy(*LEVELS).agg(F.min("bucket").alias("edge"), F.min(F.col("upto") - F.col("t")).alias("before"))
        edge = stored(spark, found, "mix-edges")
    return edge


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 17,
    tokens: Column | None = None,
    domain: Column | None = None,
    bucket_rows: int = 4096,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs): how often each selected document is taken.

    Texts of any length are counted whole; other columns are ignored, whatever their names; an empty table
    gives no rows; of equal order keys the smaller doc_id, then the shorter text comes first. The target is ``share`` of all tokens; ``weights`` has whole numbers per level and name, 1 where none
    is given, 0 for nothing. A leaf's documents are taken in order while their running sum of tokens
    stays within the rest of its budget. Documents without tokens are never taken. Null languages and
    sources are the name '', documents without an id are ordered by their text; repeated rows are separate documents.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (domain_of() if domain is None else domain).alias("domain"),
        name("lang").alias("lang"),
        name("source").alias("source"),
        (words_of() if tokens is None else tokens).cast("long").alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string")) if "text" in docs.columns else F.lit("")).alias("name"),
    ).filter("n_tokens > 0")
    rows = stored(spark, rows, "mix-rows")
    leaves = stored(spark, rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n")), "mix-leaves")
    total = F.floor(F.sum("have").cast("double") * share)
    drawn = budgets(leaves, total, weights, epochs).withColumns({
        "whole": F.floor(F.col("grant") / F.col("have")).cast("int"), "rest": F.col("grant") % F.col("have"),
    })
    drawn = stored(spark, drawn.select(*LEVELS, "whole", "rest"), "mix-budgets")
    most = leaves.agg(F.max("n")).first()[0] or 1
    digits = next(d for d in range(16) if d == 15 or most <= bucket_rows * 16**d)
    keyed = rows.join(small(drawn), list(LEVELS)).withColumn("key", order_key(seed, F.col("whole"), "name"))
    keyed = keyed.join(small(_edges(spark, keyed, digits)), list(LEVELS), "left").withColumn("bucket", F.substring("key", 1, digits))
    inside = keyed.filter("edge is null or bucket <> edge").withColumn("more", (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))) & (F.col("rest") > 0))
    running = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = keyed.filter("bucket = edge").withColumn("run", F.sum("n_tokens").over(running))
    cut = cut.withColumn("more", F.col("before") + F.col("run") <= F.col("rest")).drop("run")
    out = inside.unionByName(cut).withColumn("epochs", F.col("whole") + F.col("more").cast("int")).filter("epochs > 0")
    return out.select("doc_id", *LEVELS, "n_tokens", "epochs")


def apply_mix(spark: SparkSession, docs: DataFrame, weights: Mapping[str, Mapping[str, int]], **params) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, each as many times as it has epochs.

    Rows that share a doc_id are taken together, as often as the luckiest of them, rows without one too;
    null and empty texts have no tokens and are never taken; extra columns stay, but for names that begin
    with the helper prefix, which are an error; an empty table stays empty.
    """
    if clash := [c for c in docs.columns if c in (f"{OWN}id", f"{OWN}epochs", f"{OWN}copy")]:
        raise ValueError(f"columns named like helper columns: {clash}")
    taken = mix(spark, docs, weights, **params)
    taken = taken.groupBy(F.col("doc_id").alias(f"{OWN}id")).agg(F.max("epochs").alias(f"{OWN}epochs"))
    joined = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{OWN}id")))
    again = joined.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}epochs"))))
    return again.select(*docs.columns)
