"""Naive Bayes queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs import views as V
from tabmine.jobs.registry import query, report, table
from tabmine.operators import naive_bayes as nb

_LONG = f"({V.VEC_LONG_SQL})"
#: CTEs: g (label, fi, mean, var, log_prior) fitted on all rows and s (vec_id, label, k, ll).
GNB_SQL = f"""c AS (SELECT * FROM {_LONG}), pr AS (SELECT label, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM embeddings)) AS log_prior FROM embeddings GROUP BY label),
    g AS (SELECT c.label, fi, avg(v) AS mean, var_pop(v) + 1e-9 AS var, any_value(log_prior) AS log_prior FROM c JOIN pr ON pr.label = c.label GROUP BY c.label, fi),
    s AS (SELECT c.vec_id, c.label, g.label AS k, any_value(log_prior) + sum(-0.5 * ln(2 * pi() * var) - pow(v - mean, 2) / (2 * var)) AS ll
        FROM c JOIN g ON g.fi = c.fi GROUP BY c.vec_id, c.label, g.label)"""
#: A CTE: the best class of each row of s.
GNB_PRED = "p AS (SELECT vec_id, label, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ll, 9) DESC, k) AS rk FROM s) WHERE rk = 1)"


@query("gnb_fit", f"WITH {GNB_SQL} SELECT label, fi, round(log_prior, 6) AS log_prior, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var FROM g")
def gnb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(nb.fit_gaussian(V.vec_frame(spark, sf_dir)).withColumnRenamed("y", "label"))


def gnb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    return nb.predict_gaussian(rows, nb.fit_gaussian(rows))


@query("gnb_log_likelihood", f"WITH {GNB_SQL} SELECT vec_id, k, round(ll, 5) AS ll FROM s")
def gnb_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = gnb_predictions(spark, sf_dir).select(F.col("row_id").alias("vec_id"), F.inline(F.arrays_zip(F.col("classes").alias("k"), F.col("ll").alias("ll"))))
    return report(pairs, 5)


@query("gnb_predict", f"WITH {GNB_SQL}, {GNB_PRED} SELECT vec_id, label, pred FROM p")
def gnb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnb_predictions(spark, sf_dir).select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), "pred")


@query("gnb_predict_proba", f"""WITH {GNB_SQL}, e AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY vec_id)) AS e FROM s)
    SELECT vec_id, k, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e""")
def gnb_predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = gnb_predictions(spark, sf_dir).select(F.col("row_id").alias("vec_id"), F.inline(F.arrays_zip(F.col("classes").alias("k"), F.col("proba").alias("p"))))
    return report(pairs)


#: CTEs: n (doc_id, term, n) of all documents, l (doc_id, y), model (y, term, log_p), cl (y, log_prior, log_unseen).
MNB_SQL = """n AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents) GROUP BY ALL),
    l AS (SELECT doc_id, quality AS y FROM labels), sn AS (SELECT y, term, sum(n) AS n FROM n JOIN l USING (doc_id) GROUP BY ALL),
    tot AS (SELECT y, sum(n) AS al FROM sn GROUP BY y), v AS (SELECT count(DISTINCT term) AS v FROM sn),
    cl AS (SELECT l.y, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM l)) AS log_prior, ln(any_value(al) + CAST(1 AS DOUBLE) * any_value(v)) AS below,
        -ln(any_value(al) + CAST(1 AS DOUBLE) * any_value(v)) AS log_unseen FROM l JOIN tot USING (y), v GROUP BY l.y),
    model AS (SELECT sn.y, term, ln(n + 1) - below AS log_p FROM sn JOIN cl USING (y))"""
_MNB_LL = """voc AS (SELECT DISTINCT term FROM model), kn AS (SELECT n.* FROM n JOIN voc USING (term)),
    ll AS (SELECT d.doc_id, cl.y, log_prior + coalesce(s, 0) AS ll FROM (SELECT doc_id FROM documents) d CROSS JOIN cl LEFT JOIN
        (SELECT doc_id, cl.y, sum(n * coalesce(log_p, log_unseen)) AS s FROM kn CROSS JOIN cl LEFT JOIN model ON model.term = kn.term AND model.y = cl.y GROUP BY doc_id, cl.y) x
        ON x.doc_id = d.doc_id AND x.y = cl.y)"""


def word_counts(docs: DataFrame) -> DataFrame:
    """(row_id, term, n) and y if there is one: lower-case words of each text, a row for each place."""
    text = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    y = [c for c in docs.columns if c == "y"]
    return docs.select(F.col("doc_id").alias("row_id"), *y, F.explode(words).alias("term"), F.lit(1).cast("long").alias("n"))


def _mnb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"))
    seen = word_counts(docs.join(labels.withColumnRenamed("row_id", "doc_id"), "doc_id"))  # texts meet labels before they are words
    return docs.select(F.col("doc_id").alias("row_id")), word_counts(docs), *nb.fit_multinomial(seen, labels)


@query("mnb_fit", f"WITH {MNB_SQL} SELECT y, term, round(log_p, 6) AS log_p FROM model")
def mnb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_mnb(spark, sf_dir)[2])


def mnb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, counts, terms, classes = _mnb(spark, sf_dir)
    return nb.predict_from_log_likelihood(nb.multinomial_log_likelihood(counts, ids, terms, classes))


@query("mnb_predict", f"""WITH {MNB_SQL}, {_MNB_LL} SELECT doc_id, y AS pred FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(ll, 9) DESC, y) AS rk FROM ll) WHERE rk = 1""")
def mnb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mnb_predictions(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "pred")


@query("mnb_predict_proba", f"""WITH {MNB_SQL}, {_MNB_LL}, e AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY doc_id)) AS e FROM ll)
    SELECT doc_id, CAST(y AS INT) AS k, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS p FROM e""")
def mnb_predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(mnb_predictions(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.posexplode("proba").alias("k", "p")))
