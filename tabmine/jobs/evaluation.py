"""Metric, fold and comparison queries. Predictions are those of Gaussian naive Bayes on all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs import training_sql as T
from tabmine.jobs import views as V
from tabmine.jobs.bayes import GNB_PRED, GNB_SQL, gnb_predictions
from tabmine.jobs.models import test_paths, tree_ctes
from tabmine.jobs.neighbours import DIST, split, vote_sql
from tabmine.jobs.profiling import split_sql
from tabmine.jobs.registry import query, report, table
from tabmine.operators import chartdata, kmeans, knn, metrics, naive_bayes, tree, validate, workflow

_P = f"{GNB_SQL}, {GNB_PRED}"


def confusion_sql(source: str, by: str = "") -> str:
    """CTEs m (by, true_label, pred_label, n), pc (by, label, support, hit, precision, recall, f1) and su of a table (by, label, pred)."""
    part, lead = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    groups = f", (SELECT DISTINCT {by} FROM {source}) bb" if by else ""
    on = f" AND s.{by} = bb.{by}" if by else ""
    return f"""m AS (SELECT {f"bb.{by}, " if by else ""}CAST(a AS INT) AS true_label, CAST(b AS INT) AS pred_label, count(s.label) AS n FROM
        range(0, (SELECT max(greatest(label, pred)) + 1 FROM {source})) ra(a), range(0, (SELECT max(greatest(label, pred)) + 1 FROM {source})) rb(b){groups}
        LEFT JOIN {source} s ON s.label = a AND s.pred = b{on} GROUP BY ALL),
    pc0 AS (SELECT DISTINCT {lead}true_label AS label, CAST(sum(n) OVER (PARTITION BY {lead}true_label) AS BIGINT) AS support FROM m),
    pc1 AS (SELECT {lead}pred_label AS label, sum(n) AS claimed, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS hit FROM m GROUP BY {lead}pred_label),
    pc2 AS (SELECT pc0.*, hit, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM pc0 JOIN pc1 USING ({lead}label)),
    pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc2),
    su AS (SELECT {lead}sum(hit) / sum(support) AS accuracy, {", ".join(f"avg({x}) AS {x}_macro" for x in ("precision", "recall", "f1"))},
        {", ".join(f"sum(hit) / sum(support) AS {x}_micro" for x in ("precision", "recall", "f1"))},
        {", ".join(f"sum({x} * support) / sum(support) AS {x}_weighted" for x in ("precision", "recall", "f1"))} FROM pc {f"GROUP BY {by}" if by else ""})"""


_M = f"WITH {_P}, {confusion_sql('p')}"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(gnb_predictions(spark, sf_dir))


@query("confusion_matrix", f"{_M} SELECT * FROM m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query("accuracy", f"{_M} SELECT round(accuracy, 6) AS accuracy FROM su")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(metrics.summary(_matrix(spark, sf_dir)).select("accuracy"))


@query("per_class_metrics", f"{_M} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(metrics.per_class(_matrix(spark, sf_dir)).drop("hit"))


def _average(kind: str) -> None:
    names = [f"{x}_{kind}" for x in ("precision", "recall", "f1")]

    @query(f"prf_{kind}", f"{_M} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM su")
    def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(metrics.summary(_matrix(spark, sf_dir)).select(*names))


for _kind in ("macro", "micro", "weighted"):
    _average(_kind)

_ALL = ", ".join(f"round({n}, 6) AS {n}" for n in validate.METRICS)


@query("all_metrics", f"{_M} SELECT {_ALL} FROM su")
def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(metrics.summary(_matrix(spark, sf_dir)).select(*validate.METRICS))


_ROC_POINTS = """pts AS (SELECT {k}score, sum(CAST(positive AS INT)) AS p, sum(1 - CAST(positive AS INT)) AS f FROM sc GROUP BY {k}score),
    cum AS (SELECT {k}score AS threshold, CAST(sum(p) OVER ({w} ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(f) OVER ({w} ORDER BY score DESC) AS BIGINT) AS fp, sum(p) OVER ({w}) AS np, sum(f) OVER ({w}) AS nf FROM pts),
    roc AS (SELECT {k}threshold, tp, fp, tp / np AS tpr, fp / nf AS fpr FROM cum UNION ALL SELECT DISTINCT {k}CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cum),
    ar AS (SELECT {k}sum((fpr - x0) * (tpr + y0) / 2) AS auc FROM (SELECT *, lag(fpr) OVER ({w} ORDER BY fpr, tpr) AS x0, lag(tpr) OVER ({w} ORDER BY fpr, tpr) AS y0 FROM roc) {g})"""
_DOCS = "sc AS (SELECT CAST(length(text) AS DOUBLE) AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id))"
_ROC = f"WITH {_DOCS}, {_ROC_POINTS.format(k='', w='', g='')}"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text length as a score of quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("score"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    return docs.join(labels, "doc_id")


@query("roc_curve", f"{_ROC} SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(metrics.roc(_scores(spark, sf_dir)))


@query("roc_auc", f"{_ROC} SELECT round(auc, 6) AS auc FROM ar")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(metrics.auc(metrics.roc(_scores(spark, sf_dir))))


_OVR = f"""WITH {GNB_SQL}, e AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY vec_id)) AS e FROM s),
    sc AS (SELECT k, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS score, label = k AS positive FROM e), {_ROC_POINTS.format(k='k, ', w='PARTITION BY k', g='GROUP BY k')}"""


@query("roc_auc_ovr", f"{_OVR} SELECT k, round(auc, 6) AS auc, round(avg(auc) OVER (), 6) AS macro FROM ar")
def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gnb_predictions(spark, sf_dir)
    pairs = p.select("y", F.inline(F.arrays_zip(F.col("classes").alias("k"), F.col("proba").alias("p"))))
    each = metrics.auc(metrics.roc(pairs.select("k", F.round("p", 9).alias("score"), (F.col("y") == F.col("k")).alias("positive")), by=["k"]), ["k"])
    return report(each.crossJoin(F.broadcast(each.agg(F.avg("auc").alias("macro")))))  # one row


def kfold_sql(source: str, key: str, k: int = 5, seed: int = 42) -> str:
    return f"""SELECT * EXCLUDE (rk, n_all), CAST(CASE WHEN rk < (n_all % {k}) * (n_all // {k} + 1) THEN rk // (n_all // {k} + 1)
        ELSE n_all % {k} + (rk - (n_all % {k}) * (n_all // {k} + 1)) // greatest(n_all // {k}, 1) END AS INT) AS fold
        FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}-' || {key}), {key}) - 1 AS rk, count(*) OVER () AS n_all FROM ({source}))"""


@query("kfold_assign", kfold_sql("SELECT o_orderkey FROM orders", "o_orderkey", 7))
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), 7, row_id="o_orderkey")


_CV_OUT = "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (UNPIVOT su ON COLUMNS(* EXCLUDE fold) INTO NAME metric VALUE v) GROUP BY metric"


def _cv_gnb(k: int = 5, seed: int = 42) -> str:
    """CTEs that end in p (vec_id, fold, label, pred): naive Bayes predictions of one cross-validation."""
    return f"""c AS (SELECT l.*, fold FROM ({V.VEC_LONG_SQL}) l JOIN (SELECT vec_id, fold FROM ({kfold_sql("SELECT vec_id FROM embeddings", "vec_id", k, seed)})) USING (vec_id)),
    g AS (SELECT f.fold, label AS k, fi, avg(v) AS mean, var_pop(v) + 1e-9 AS var, CAST(count(*) AS DOUBLE) AS n FROM c, (SELECT unnest(range(0, {k})) AS fold) f WHERE c.fold <> f.fold GROUP BY ALL),
    gp AS (SELECT *, ln(n / sum(n) OVER (PARTITION BY fold, fi)) AS log_prior FROM g),
    s AS (SELECT c.vec_id, c.fold, c.label, gp.k, any_value(log_prior) + sum(-0.5 * ln(2 * pi() * var) - pow(v - mean, 2) / (2 * var)) AS ll FROM c JOIN gp ON gp.fold = c.fold AND gp.fi = c.fi GROUP BY ALL),
    p AS (SELECT vec_id, fold, label, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ll, 9) DESC, k) AS rk FROM s) WHERE rk = 1)"""


_CV_GNB = _cv_gnb()


@query("cv_gnb", f"WITH {_CV_GNB}, {confusion_sql('p', 'fold')} {_CV_OUT}")
def cv_gnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = validate.kfold(V.vec_frame(spark, sf_dir), 5)
    return report(validate.cross_validated(validate.gaussian_fold_predictions(folded)))


def _cv_knn(k: int = 5, seed: int = 42) -> str:
    """The same by five nearest neighbours."""
    return f"""x AS (SELECT v.*, fold FROM ({V.VEC_SQL}) v JOIN (SELECT vec_id, fold FROM ({kfold_sql("SELECT vec_id FROM embeddings", "vec_id", k, seed)})) USING (vec_id)),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), tid) AS rank FROM (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label AS y,
        {DIST} AS dist FROM x q JOIN x t ON q.fold <> t.fold)) WHERE rank <= 5),
    {vote_sql('CAST(1 AS DOUBLE)')}, p AS (SELECT vec_id, fold, label, pred FROM x JOIN pr ON qid = vec_id)"""


_CV_KNN = _cv_knn()


def _runs(one, k: int, runs: int) -> str:
    """A table (fold, label, pred) of repeated cross-validations, their folds numbered on."""
    return " UNION ALL ".join(f"SELECT fold + {k * r} AS fold, label, pred FROM (WITH {one(k, 42 + 100 * r)} SELECT * FROM p)" for r in range(runs))


@query("cv_knn", f"WITH {_CV_KNN}, {confusion_sql('p', 'fold')} {_CV_OUT}")
def cv_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = validate.kfold(V.vec_frame(spark, sf_dir), 5)
    return report(validate.cross_validated(validate.knn_fold_predictions(folded)))


@query("cv_repeated", f"WITH p AS ({_runs(_cv_gnb, 5, 3)}), {confusion_sql('p', 'fold')} {_CV_OUT}")
def cv_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cross-validations of five folds, each shuffled anew."""
    found = validate.repeated(V.vec_frame(spark, sf_dir), workflow.fold_predictions("gaussian_nb", 10, V.DIMS), 5, 3)
    return report(validate.cross_validated(found))


def _cell(algorithm: str, one) -> str:
    return f"""SELECT 'embeddings' AS dataset, '{algorithm}' AS algorithm, metric, mean AS value, std, CAST(NULL AS VARCHAR) AS error
        FROM (WITH p AS ({_runs(one, 3, 2)}), {confusion_sql('p', 'fold')} {_CV_OUT})"""


@query("benchmark_grid", f"{_cell('gaussian_nb', _cv_gnb)} UNION ALL {_cell('knn', _cv_knn)}")
def benchmark_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two algorithms, three folds, two runs: mean and spread of every metric."""
    algorithms = {name: workflow.fold_predictions(name, 10, V.DIMS) for name in ("gaussian_nb", "knn")}
    return report(validate.grid(spark, {"embeddings": V.vec_frame(spark, sf_dir)}, algorithms, 3, 2))


@query("benchmark_grid_all")
def benchmark_grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six algorithms, three folds; clusters are judged by inertia and silhouette."""
    rows = V.vec_frame(spark, sf_dir).persist()
    algorithms = {name: workflow.fold_predictions(name, 10, V.DIMS) for name in workflow.MODELS}

    def clusters(frame: DataFrame, runs: int) -> list[tuple[str, float, float]]:
        return kmeans.evaluation(kmeans.evaluate(frame, 10, runs, 5))

    clusters.clusters = True
    out = report(validate.grid(spark, {"embeddings": rows}, algorithms | {"kmeans": clusters}, 3, 1))
    rows.unpersist()
    return out


_RESULTS = f"""g AS (SELECT fold, avg(CAST(label = pred AS DOUBLE)) AS a FROM (WITH {_CV_GNB} SELECT * FROM p) GROUP BY fold),
    n AS (SELECT fold, avg(CAST(label = pred AS DOUBLE)) AS a FROM (WITH {_CV_KNN} SELECT * FROM p) GROUP BY fold),
    r AS (SELECT 'embeddings' AS dataset, 'gaussian_nb' AS algorithm, avg(a) AS value FROM g UNION ALL SELECT 'embeddings', 'knn', avg(a) FROM n)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    algorithms = {name: workflow.fold_predictions(name, 10, V.DIMS) for name in ("gaussian_nb", "knn")}
    return validate.grid(spark, {"embeddings": V.vec_frame(spark, sf_dir)}, algorithms)


@query("results_matrix", f"WITH {_RESULTS} SELECT dataset, round(sum(CASE WHEN algorithm = 'gaussian_nb' THEN value END), 6) AS gaussian_nb, round(sum(CASE WHEN algorithm = 'knn' THEN value END), 6) AS knn, CAST(0 AS DOUBLE) AS mlp FROM r GROUP BY dataset")
def results_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(validate.result_matrix(_results(spark, sf_dir), "accuracy", ["gaussian_nb", "knn", "mlp"]))


@query("best_algorithm", f"WITH {_RESULTS} SELECT dataset, algorithm, round(value, 6) AS value FROM r ORDER BY round(value, 9) DESC, algorithm LIMIT 1")
def best_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(validate.best_algorithms(_results(spark, sf_dir)))


def _scaled_split_sql(scale: bool) -> str:
    x = "x" if not scale else "(v - avg(v) OVER (PARTITION BY fi)) / stddev_pop(v) OVER (PARTITION BY fi)"
    x = "v" if not scale else x
    return f"""l AS (SELECT vec_id, label, fi, {x} AS v FROM ({V.VEC_LONG_SQL})), sp AS ({split_sql("SELECT vec_id FROM embeddings", "vec_id")}),
    c AS (SELECT l.*, is_test FROM l JOIN sp USING (vec_id)), pr AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS log_prior FROM c WHERE NOT is_test AND fi = 0 GROUP BY label),
    g AS (SELECT label, fi, avg(v) AS mean, var_pop(v) + 1e-9 AS var, any_value(log_prior) AS log_prior FROM c JOIN pr USING (label) WHERE NOT is_test GROUP BY label, fi),
    s AS (SELECT c.vec_id, c.label, g.label AS k, any_value(log_prior) + sum(-0.5 * ln(2 * pi() * var) - pow(v - mean, 2) / (2 * var)) AS ll FROM c JOIN g USING (fi) WHERE is_test GROUP BY ALL),
    {GNB_PRED}"""


def _train_evaluate(spark: SparkSession, sf_dir: str, name: str, **params) -> DataFrame:
    """Scale, split, fit, predict and score one model."""
    return report(workflow.train_evaluate(V.vec(spark, sf_dir), "vec_id", V.VEC, "label", name, **params))


_SCALED = f"""SELECT vec_id, label, list(v ORDER BY fi) AS x FROM (SELECT vec_id, label, fi, (v - avg(v) OVER (PARTITION BY fi)) / stddev_pop(v) OVER (PARTITION BY fi) AS v
    FROM ({V.VEC_LONG_SQL})) GROUP BY vec_id, label"""


def _knn_metrics(x: str) -> str:
    return f"""WITH s AS MATERIALIZED ({split_sql(x, "vec_id")}), nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), tid) AS rank FROM
        (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label AS y, {DIST} AS dist FROM s q JOIN s t ON q.is_test AND NOT t.is_test)) WHERE rank <= 5),
        {vote_sql('CAST(1 AS DOUBLE)')}, p AS (SELECT vec_id, label, pred FROM s JOIN pr ON qid = vec_id), {confusion_sql('p')} SELECT {_ALL} FROM su"""


def _c45_metrics(x: str) -> str:
    return f"""WITH sp0 AS MATERIALIZED ({split_sql(f"SELECT vec_id AS row_id, x, label AS y FROM ({x})", "row_id")}),
        {tree_ctes("SELECT row_id, x, y FROM sp0 WHERE NOT is_test", features=V.DIMS, classes=10)}, {test_paths()},
        p AS (SELECT row_id AS vec_id, y AS label, lab.label AS pred FROM vz JOIN lab USING (node)), {confusion_sql('p')} SELECT {_ALL} FROM su"""


_GNB_METRICS = f"WITH {_scaled_split_sql(True)}, {confusion_sql('p')} SELECT {_ALL} FROM su"
_SCALED_CV = f"""c AS (SELECT l.*, fold FROM (SELECT vec_id, label, fi, (v - avg(v) OVER (PARTITION BY fi)) / stddev_pop(v) OVER (PARTITION BY fi) AS v FROM ({V.VEC_LONG_SQL})) l JOIN"""


@query("train_evaluate_gnb", _GNB_METRICS)
def train_evaluate_gnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_evaluate(spark, sf_dir, "gaussian_nb")


@query("train_evaluate_gnb_cv", f"""SELECT * FROM ({_GNB_METRICS}), (WITH {_CV_GNB.replace("c AS (SELECT l.*, fold FROM (" + V.VEC_LONG_SQL + ") l JOIN", _SCALED_CV)}, {confusion_sql('p', 'fold')}
    SELECT round(avg(accuracy), 6) AS cv_accuracy, round(stddev_pop(accuracy), 6) AS cv_accuracy_std, round(avg(f1_macro), 6) AS cv_f1_macro FROM su)""")
def train_evaluate_gnb_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with five folds of cross-validation beside it."""
    return _train_evaluate(spark, sf_dir, "gaussian_nb", folds=5)


@query("train_evaluate_knn", _knn_metrics(_SCALED))
def train_evaluate_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_evaluate(spark, sf_dir, "knn")


@query("train_evaluate_c45", _c45_metrics(_SCALED))
def train_evaluate_c45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_evaluate(spark, sf_dir, "c45")


def _svm_metrics(x: str) -> str:
    rows = lambda test: f"SELECT vec_id, label, x FROM sv WHERE {test}"
    return f"""WITH RECURSIVE sv AS MATERIALIZED ({split_sql(x, "vec_id")}), {T.svm_ctes(rows("NOT is_test"), rows("is_test"))}, {confusion_sql('p')} SELECT {_ALL} FROM su"""


@query("train_evaluate_svm", _svm_metrics(_SCALED))
def train_evaluate_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_evaluate(spark, sf_dir, "svm")


@query("train_evaluate_mlp")
def train_evaluate_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_evaluate(spark, sf_dir, "mlp")


@query("train_evaluate_kmeans")
def train_evaluate_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_evaluate(spark, sf_dir, "kmeans", k=10)


_CMP = f"""SELECT 'gaussian_nb' AS algorithm, {_ALL} FROM (WITH {_scaled_split_sql(False)}, {confusion_sql('p')} SELECT * FROM su) UNION ALL
    SELECT 'knn' AS algorithm, * FROM ({_knn_metrics(V.VEC_SQL)}) UNION ALL SELECT 'c45' AS algorithm, * FROM ({_c45_metrics(V.VEC_SQL)})"""


@query("compare_algorithms", _CMP)
def compare_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models on one split."""
    test, train = split(spark, sf_dir)
    gnb = naive_bayes.predict_gaussian(test, naive_bayes.fit_gaussian(train)).select("y", "pred")
    near = knn.predict(knn.vote(knn.neighbors(test, train)))
    near = test.join(near, F.col("row_id") == F.col("qid")).select("y", "pred")
    c45 = tree.predict(test, tree.grow(train, 10, V.DIMS)).select("y", "pred")
    models = (("gaussian_nb", gnb), ("knn", near), ("c45", c45))
    parts = [metrics.summary(metrics.confusion(p)).select(F.lit(n).alias("algorithm"), *validate.METRICS) for n, p in models]
    return report(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("prediction_distribution", f"WITH {_P} SELECT coalesce(a.label, b.label) AS label, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred FROM (SELECT label, count(*) AS n_true FROM p GROUP BY 1) a FULL JOIN (SELECT pred AS label, count(*) AS n_pred FROM p GROUP BY 1) b USING (label)".replace("coalesce(a.label, b.label) AS label", "label"))
def prediction_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chartdata.prediction_distribution(gnb_predictions(spark, sf_dir))
