"""Feature selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs import views as V
from tabmine.jobs.registry import query, report, table
from tabmine.operators import frame, select

_LONG = f"({V.VEC_LONG_SQL})"


@query("filter_pearson", f"""SELECT fi, round(CASE WHEN stddev_pop(v) = 0 OR stddev_pop(label) = 0 THEN 0 ELSE abs(corr(v, label)) END, 6) AS score
    FROM {_LONG} GROUP BY fi ORDER BY round(CASE WHEN stddev_pop(v) = 0 OR stddev_pop(label) = 0 THEN 0 ELSE abs(corr(v, label)) END, 9) DESC, fi LIMIT 4""")
def filter_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(select.top(select.pearson_scores(V.vec_frame(spark, sf_dir)), 4))


@query("filter_variance", f"SELECT fi, round(var_pop(v), 6) AS score FROM {_LONG} GROUP BY fi HAVING var_pop(v) > 0.01 ORDER BY fi LIMIT 5")
def filter_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(select.variance_filter(V.vec_frame(spark, sf_dir), k=5))


@query("project_features", f"SELECT vec_id, round(f1, 6) AS a, round(f5, 6) AS b, round(f40, 6) AS c FROM ({V.VEC_WIDE_SQL})")
def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors cut down to three chosen features, in index order."""
    rows = select.keep_features(V.vec(spark, sf_dir), V.VEC, [40, 1, 5])
    return report(rows.select("vec_id", *[F.col("x")[k].alias(n) for k, n in enumerate("abc")]))


_MI_SQL = """WITH c AS (SELECT fi, v, y FROM ({source})), d AS (SELECT fi, count(DISTINCT v) AS u FROM c GROUP BY fi),
    q AS (SELECT fi, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q, list_sort(list_distinct(list(v))) AS vals FROM c GROUP BY fi),
    e AS (SELECT fi, unnest(list_sort(list_distinct(CASE WHEN u < 10 THEN vals ELSE q END))) AS e FROM q JOIN d USING (fi)),
    f AS (SELECT fi, list(e ORDER BY e) AS es FROM (SELECT *, max(e) OVER (PARTITION BY fi) AS top FROM e) WHERE e < top GROUP BY fi),
    b AS (SELECT c.fi, y, len(list_filter(coalesce(es, []), lambda x: x <= v)) AS b FROM c LEFT JOIN f USING (fi)),
    j AS (SELECT fi, b, y, count(*) AS n FROM b GROUP BY ALL),
    w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY fi, b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY fi, y) AS DOUBLE) AS ny, CAST(sum(n) OVER (PARTITION BY fi) AS DOUBLE) AS al FROM j),
    mi AS (SELECT fi, sum(n / al * log2((n / al) / (nb / al * (ny / al)) + 1e-10)) AS mi FROM w GROUP BY fi),
    h AS (SELECT fi, sum(-(ny / al) * log2(ny / al)) AS h FROM (SELECT DISTINCT fi, y, ny, al FROM w) GROUP BY fi)
    SELECT fi, round(mi / (h + 1e-10), 6) AS score FROM mi JOIN h USING (fi)"""
_PART = """SELECT fi, v, dense_rank() OVER (ORDER BY p_type) - 1 AS y FROM (SELECT 0 AS fi, CAST(p_size AS DOUBLE) AS v, p_type FROM part
    UNION ALL SELECT 1, p_retailprice, p_type FROM part UNION ALL SELECT 2, CAST(p_size % 5 AS DOUBLE), p_type FROM part)"""


def part_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with size, price and size modulo 5 (a feature of few values) against their type."""
    rows = table(spark, sf_dir, "part")
    rows = frame.encode(rows, "p_type", frame.label_dictionary(rows, "p_type")).withColumn("size5", F.col("p_size") % 5)
    return frame.frame(rows, "p_partkey", ["p_size", "p_retailprice", "size5"], "y")


@query("filter_mutual_info", _MI_SQL.format(source=_PART))
def filter_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(select.mutual_information(part_frame(spark, sf_dir)))


def _fold_sql(d: int, folds: int = 3) -> str:
    """CTEs: c (vec_id, label, fi, v, fold), t (vec_id, fold, label, k, fi, term, prior)."""
    return f"""r AS (SELECT vec_id, floor((row_number() OVER (ORDER BY md5('42-' || vec_id), vec_id) - 1) / floor(count(*) OVER () / {folds})) AS f0 FROM embeddings),
    c AS (SELECT l.*, CASE WHEN f0 < {folds} THEN CAST(f0 AS INT) END AS fold FROM {_LONG} l JOIN r USING (vec_id) WHERE fi < {d}),
    m AS (SELECT f.fold, label AS k, fi, avg(v) AS mu, var_pop(v) + 1e-9 AS va, CAST(count(*) AS DOUBLE) AS n FROM c, (SELECT unnest(range(0, {folds})) AS fold) f
        WHERE c.fold IS NULL OR c.fold <> f.fold GROUP BY ALL),
    p AS (SELECT *, ln(n / sum(n) OVER (PARTITION BY fold, fi)) AS prior FROM m),
    t AS MATERIALIZED (SELECT c.vec_id, c.fold, c.label, p.k, c.fi, -0.5 * ln(2 * pi() * va) - pow(v - mu, 2) / (2 * va) AS term, prior FROM c JOIN p ON p.fold = c.fold AND p.fi = c.fi)"""


def _accuracy_sql(name: str, inside: str, candidates: str) -> str:
    """CTE ``name`` (cand, a): mean fold accuracy with the features of ``inside`` for each candidate."""
    return f"""{name} AS (SELECT cand, round(avg(a), 9) AS a FROM (SELECT cand, fold, avg(CAST(k = label AS DOUBLE)) AS a FROM
        (SELECT *, row_number() OVER (PARTITION BY cand, vec_id ORDER BY ll DESC, k) AS rk FROM
            (SELECT cand, vec_id, fold, label, k, round(any_value(prior) + sum(term), 9) AS ll FROM t, {candidates}
             WHERE {inside} GROUP BY cand, vec_id, fold, label, k)) WHERE rk = 1 GROUP BY cand, fold) GROUP BY cand)"""


_ALL = f"(SELECT unnest(range(0, {V.DIMS})) AS cand)"


@query("forward_selection", f"""WITH {_fold_sql(V.DIMS)},
    {_accuracy_sql("s1", "fi = cand", _ALL)}, b1 AS (SELECT * FROM s1 ORDER BY a DESC, cand LIMIT 1),
    {_accuracy_sql("s2", "fi = cand OR fi = one", f"(SELECT o.cand, b1.cand AS one FROM {_ALL} o, b1 WHERE o.cand <> b1.cand)")},
    b2 AS (SELECT * FROM s2 ORDER BY a DESC, cand LIMIT 1)
    SELECT 1 AS step, CAST(cand AS INT) AS fi, round(a, 6) AS accuracy FROM b1 UNION ALL SELECT 2, CAST(cand AS INT), round(a, 6) FROM b2""")
def forward_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select.forward_selection(V.vec_frame(spark, sf_dir), 2, V.DIMS)
    return spark.createDataFrame([(k + 1, f, round(a, 6)) for k, (f, a) in enumerate(chosen)], "step int, fi int, accuracy double")


@query("backward_elimination", f"""WITH {_fold_sql(V.DIMS)}, {_accuracy_sql("s1", "fi <> cand", _ALL)}
    SELECT 1 AS step, CAST(cand AS INT) AS fi, round(a, 6) AS accuracy FROM s1 ORDER BY a DESC, cand DESC LIMIT 1""")
def backward_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = select.backward_elimination(V.vec_frame(spark, sf_dir), V.DIMS - 1, V.DIMS)
    return spark.createDataFrame([(k + 1, f, round(a, 6)) for k, (f, a) in enumerate(dropped)], "step int, fi int, accuracy double")
