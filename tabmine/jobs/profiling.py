"""Profiling and preparation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.functions import columns as C
from tabmine.jobs import views as V
from tabmine.jobs.registry import query, report, table
from tabmine.operators import frame, prep, profile

_LI = f"({V.LI_LONG_SQL})"
_N = "CAST(count(v) AS DOUBLE)"


@query("dataset_overview", f"""SELECT count(*) AS n_rows, 2 AS n_features, count(DISTINCT o_orderstatus) AS n_classes,
    CAST(count_if(o_totalprice IS NULL) + count_if(o_custkey IS NULL) AS BIGINT) AS n_missing FROM ({V.MISSING_SQL})""")
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overview(V.with_missing(spark, sf_dir), V.MISSING, "o_orderstatus")


@query("feature_stats_basic", f"""SELECT fi, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max
    FROM {_LI} GROUP BY fi, feature""")
def feature_stats_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.basic_stats(V.li(spark, sf_dir), V.LI))


@query("feature_stats_full", f"""SELECT fi, feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min,
    round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75,
    round(max(v), 4) AS max, CAST(count_if(v IS NULL) AS BIGINT) AS missing FROM (SELECT 0 AS fi, 'o_totalprice' AS feature, o_totalprice AS v
    FROM ({V.MISSING_SQL}) UNION ALL SELECT 1, 'o_custkey', o_custkey FROM ({V.MISSING_SQL})) GROUP BY fi, feature""")
def feature_stats_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.full_stats(V.with_missing(spark, sf_dir), V.MISSING), 4)


_MOMENTS = f"""(SELECT fi, feature, {_N} AS n, stddev_pop(v) AS sd, sum(pow(z, 3)) AS s3, sum(pow(z, 4)) AS s4 FROM
    (SELECT *, (v - avg(v) OVER (PARTITION BY fi)) / stddev_pop(v) OVER (PARTITION BY fi) AS z FROM {_LI}) GROUP BY fi, feature)"""


@query("feature_skewness", f"""SELECT fi, feature, round(CASE WHEN n < 3 OR sd < 1e-10 THEN 0 ELSE n / ((n - 1) * (n - 2)) * s3 END, 6) + 0.0
    AS skewness FROM {_MOMENTS}""")
def feature_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.skewness(V.li(spark, sf_dir), V.LI))


@query("feature_kurtosis", f"""SELECT fi, feature, round(CASE WHEN n < 4 OR sd < 1e-10 THEN 0 ELSE n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * s4
    - 3 * pow(n - 1, 2) / ((n - 2) * (n - 3)) END, 6) + 0.0 AS kurtosis FROM {_MOMENTS}""")
def feature_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.kurtosis(V.li(spark, sf_dir), V.LI))


@query("class_distribution", """SELECT l_returnflag AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM lineitem GROUP BY l_returnflag""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.class_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag"))


_LI_WIDE = "(SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS x{k}" for k, c in enumerate(V.LI)) + " FROM lineitem)"


def _pair_sql(f: str, name: str, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, round({f}(x{min(i, j)}, x{max(i, j)}), {digits}) + 0.0 AS {name} FROM {_LI_WIDE}"
        for i in range(len(V.LI)) for j in range(len(V.LI))
    )


@query("correlation_matrix", _pair_sql("corr", "r", 6))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.correlations(V.li(spark, sf_dir), V.LI))


@query("covariance_matrix", _pair_sql("covar_samp", "cov", 3))
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(profile.covariances(V.li(spark, sf_dir), V.LI), 3)


_USR_PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, round(corr({V.USR[i]}, {V.USR[j]}), 4) + 0.0 AS r FROM u" for i in range(4) for j in range(i + 1, 4)
)


@query("top_correlations", f"""WITH u AS ({V.USR_SQL}) SELECT * FROM ({_USR_PAIRS}) WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, i, j LIMIT 15""")
def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_correlations(V.usr(spark, sf_dir), V.USR)


@query("missing_drop", f"SELECT * FROM ({V.MISSING_SQL}) WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
def missing_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.drop_missing(V.with_missing(spark, sf_dir), V.MISSING)


def _impute_sql(f: str) -> str:
    new = ", ".join(f"round(coalesce({c}, (SELECT {f}({c}) FROM m)), 4) AS {c}" for c in V.MISSING)
    return f"WITH m AS ({V.MISSING_SQL}) SELECT o_orderkey, o_orderstatus, {new} FROM m"


@query("impute_mean", _impute_sql("avg"))
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(prep.impute(V.with_missing(spark, sf_dir), V.MISSING, "mean"), 4)


@query("impute_median", _impute_sql("median"))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(prep.impute(V.with_missing(spark, sf_dir), V.MISSING, "median"), 4)


def _scale_sql(expr: str, source: str, features: list[str], keep: str) -> str:
    tiny = lambda e: f"(CASE WHEN {e} = 0 THEN 1e-10 ELSE {e} END)"
    stats = ", ".join(f"avg({c}) AS m{k}, {tiny(f'stddev_pop({c})')} AS s{k}, min({c}) AS a{k}, {tiny(f'(max({c}) - min({c}))')} AS w{k}" for k, c in enumerate(features))
    new = ", ".join(f"round({expr.format(c=c, k=k)}, 6) + 0.0 AS {c}" for k, c in enumerate(features))
    return f"WITH t AS ({source}), s AS (SELECT {stats} FROM t) SELECT {keep}, {new} FROM t, s"


_STD = "(CAST({c} AS DOUBLE) - m{k}) / s{k}"


@query("standard_scale", _scale_sql(_STD, "SELECT * FROM lineitem", V.LI, "l_returnflag"))
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(prep.standard_scale(V.li(spark, sf_dir), V.LI))


@query("standard_scale_inverse", _scale_sql(f"{_STD} * s{{k}} + m{{k}}", "SELECT * FROM lineitem", V.LI, "l_returnflag"))
def standard_scale_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.li(spark, sf_dir)
    return report(prep.standard_unscale(prep.standard_scale(rows, V.LI), V.LI, rows))


@query("minmax_scale", _scale_sql("(CAST({c} AS DOUBLE) - a{k}) / w{k}", "SELECT * FROM lineitem", V.LI, "l_returnflag"))
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(prep.minmax_scale(V.li(spark, sf_dir), V.LI))


def split_sql(source: str, key: str, seed: int = 42, by: str = "", test_size: float = 0.2, name: str = "is_test") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT * EXCLUDE (rk, n_all), rk <= greatest(1, floor(n_all * CAST({test_size} AS DOUBLE))) AS {name} FROM (SELECT *,
        row_number() OVER ({part} ORDER BY md5('{seed}-' || {key}), {key}) AS rk, count(*) OVER ({part}) AS n_all FROM ({source}))"""


@query("train_test_split", split_sql("SELECT o_orderkey, o_orderstatus FROM orders", "o_orderkey"))
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("stratified_split", split_sql("SELECT o_orderkey, o_orderstatus FROM orders", "o_orderkey", by="o_orderstatus"))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


def _minmax_sql(c: str) -> str:
    return f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}"


@query("preprocess_rows", f"""WITH m AS ({V.MISSING_SQL}), q AS (SELECT quantile_cont(o_totalprice, 0.5) AS a, quantile_cont(o_custkey, 0.5) AS b FROM m),
    i AS (SELECT o_orderkey, coalesce(o_totalprice, a) AS o_totalprice, coalesce(o_custkey, b) AS o_custkey FROM m, q)
    SELECT o_orderkey, {_minmax_sql("o_totalprice")}, {_minmax_sql("o_custkey")}, is_test FROM ({split_sql("SELECT * FROM i", "o_orderkey")})""")
def preprocess_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians for gaps, features into 0..1, a fifth of the rows for testing."""
    ready = prep.preprocess(V.with_missing(spark, sf_dir), "o_orderkey", V.MISSING, "median", "minmax", 0.2)
    return report(ready.select("o_orderkey", *V.MISSING, "is_test"))


@query("preprocess_report", f"""WITH m AS ({V.MISSING_SQL}), d AS (SELECT * FROM m WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
    s AS ({split_sql("SELECT * FROM d", "o_orderkey")})
    SELECT (SELECT count(*) FROM m) AS n_before, count(*) AS n_after, CAST(0 AS BIGINT) AS missing_after, CAST(count_if(NOT is_test) AS BIGINT) AS n_train,
    CAST(count_if(is_test) AS BIGINT) AS n_test FROM s""")
def preprocess_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = V.with_missing(spark, sf_dir)
    after = prep.preprocess(before, "o_orderkey", V.MISSING, "drop", "standard", 0.2)
    counts = after.agg(
        F.count("*").alias("n_after"), F.count_if(F.col("o_totalprice").isNull() | F.col("o_custkey").isNull()).alias("missing_after"),
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
    )
    return before.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(counts))  # one row each


@query("label_encode", """SELECT c_custkey, c_mktsegment, CAST(d.y AS INT) AS y FROM customer JOIN (SELECT c_mktsegment AS s,
    row_number() OVER (ORDER BY c_mktsegment) - 1 AS y FROM (SELECT DISTINCT c_mktsegment FROM customer)) d ON s = c_mktsegment""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return frame.encode(rows, "c_mktsegment", frame.label_dictionary(rows, "c_mktsegment"))


@query("label_encode_first_seen", """SELECT c_custkey, c_mktsegment, CAST(d.y AS INT) AS y FROM customer JOIN (SELECT s,
    row_number() OVER (ORDER BY a) - 1 AS y FROM (SELECT c_mktsegment AS s, min(c_custkey) AS a FROM customer GROUP BY 1)) d ON s = c_mktsegment""")
def label_encode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return frame.encode(rows, "c_mktsegment", frame.label_dictionary_first_seen(rows, "c_mktsegment", "c_custkey"))


@query("one_hot", "SELECT vec_id, CAST(k AS INT) AS k, CAST(k = label AS DOUBLE) AS hot FROM embeddings, range(0, (SELECT max(label) + 1 FROM embeddings)) t(k)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = rows.agg(F.max("label").alias("top"))
    hot = F.transform(F.sequence(F.lit(0), F.col("top")), lambda k: (k == F.col("label")).cast("double"))
    return rows.crossJoin(F.broadcast(top)).select("vec_id", F.posexplode(hot).alias("k", "hot"))  # one row


_CENTRES = f"(SELECT label AS k, list(m ORDER BY fi) AS c FROM (SELECT label, fi, avg(v) AS m FROM ({V.VEC_LONG_SQL}) GROUP BY label, fi) GROUP BY label)"


def centroids(rows: DataFrame) -> DataFrame:
    """(k, c): the mean vector of each class of a feature frame."""
    means = frame.long(rows).groupBy("y", "fi").agg(F.avg("v").alias("m"))
    c = F.transform(F.array_sort(F.collect_list(F.struct("fi", "m"))), lambda s: s["m"])
    return means.groupBy(F.col("y").alias("k")).agg(c.alias("c"))


@query("vector_distance", f"""SELECT vec_id, k, round(list_distance(x, c), 6) AS euclidean,
    round(list_sum(list_transform(range(1, {V.DIMS + 1}), lambda i: abs(x[i] - c[i]))), 6) AS manhattan FROM ({V.VEC_SQL}), {_CENTRES}""")
def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    x, c = F.col("x"), F.col("c")
    pairs = rows.crossJoin(F.broadcast(centroids(rows)))  # a row per class
    return report(pairs.select(F.col("row_id").alias("vec_id"), "k", C.euclidean(x, c).alias("euclidean"), C.manhattan(x, c).alias("manhattan")))


@query("kernel_values", f"""SELECT vec_id, k, round(list_dot_product(x, c), 6) + 0.0 AS linear, round(pow(0.5 * list_dot_product(x, c) + 1, 3), 6) + 0.0 AS poly,
    round(exp(-0.5 * pow(list_distance(x, c), 2)), 6) AS rbf FROM ({V.VEC_SQL}), {_CENTRES}""")
def kernel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    x, c, g = F.col("x"), F.col("c"), F.lit(0.5)
    pairs = rows.crossJoin(F.broadcast(centroids(rows)))  # a row per class
    return report(pairs.select(F.col("row_id").alias("vec_id"), "k", C.linear_kernel(x, c).alias("linear"), C.poly_kernel(x, c, g, 1.0, 3).alias("poly"), C.rbf_kernel(x, c, g).alias("rbf")))


@query("activations", f"""SELECT vec_id, fi, round(greatest(v, 0), 6) AS relu, round(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END, 6) AS relu_slope,
    round(1 / (1 + exp(-v)), 6) AS sigmoid, round(1 / (1 + exp(-v)) * (1 - 1 / (1 + exp(-v))), 6) AS sigmoid_slope,
    round(tanh(v), 6) + 0.0 AS tanh, round(1 - tanh(v) * tanh(v), 6) AS tanh_slope FROM ({V.VEC_LONG_SQL})""".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"))
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    out = frame.long(V.vec_frame(spark, sf_dir)).select(
        F.col("row_id").alias("vec_id"), "fi", C.relu(v).alias("relu"), C.activation_slope("relu", v).alias("relu_slope"),
        C.sigmoid(v).alias("sigmoid"), C.activation_slope("sigmoid", v).alias("sigmoid_slope"),
        F.tanh(v).alias("tanh"), C.activation_slope("tanh", v).alias("tanh_slope"),
    )
    return report(out)


@query("softmax_scores", f"""SELECT vec_id, fi, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id), 6) AS p
    FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM ({V.VEC_LONG_SQL}))""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    return report(rows.select(F.col("row_id").alias("vec_id"), F.posexplode(C.softmax(F.col("x"))).alias("fi", "p")))
