"""Tree, SVM, MLP, PCA and embedded selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.jobs import training_sql as T
from tabmine.jobs import views as V
from tabmine.jobs.bayes import GNB_PRED, GNB_SQL, gnb_predictions
from tabmine.jobs.profiling import centroids, split_sql
from tabmine.jobs.registry import query, report
from tabmine.jobs.selection import part_frame
from tabmine.operators import linalg, mlp, prep, select, splits, svm, tree

TYPES = 6  # classes of part_frame
_PART = """SELECT p_partkey AS row_id, [CAST(p_size AS DOUBLE), p_retailprice, CAST(p_size % 5 AS DOUBLE)] AS x, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS y FROM part"""


def split_ctes(tag: str, rows: str, criterion: str = "ratio", candidates: int | None = None, features: int = 3, classes: int = TYPES) -> str:
    """CTEs sc{tag} (node, fi, threshold, score, n_left, n_right) and best{tag} for a table (row_id, x, y, node)."""
    cap = f"WHERE rk <= {candidates}" if candidates else ""
    score = "gain" if criterion == "gain" else "CASE WHEN info < 1e-10 THEN 0 ELSE gain / info END"
    return f"""l{tag} AS MATERIALIZED (SELECT node, y, CAST(i - 1 AS INT) AS fi, x[i] AS v FROM {rows}, range(1, {features + 1}) t(i)),
    u{tag} AS MATERIALIZED (SELECT node, fi, v, lead(v) OVER (PARTITION BY node, fi ORDER BY v) AS nx, row_number() OVER (PARTITION BY node, fi ORDER BY v) AS rk FROM (SELECT DISTINCT node, fi, v FROM l{tag})),
    n{tag} AS MATERIALIZED (SELECT node, fi, v, y, count(*) AS n FROM l{tag} GROUP BY ALL),
    w{tag} AS (SELECT u.node, u.fi, u.v, k.y, sum(coalesce(n, 0)) OVER (PARTITION BY u.node, u.fi, k.y ORDER BY u.v) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY u.node, u.fi, k.y) AS t
        FROM u{tag} u CROSS JOIN (SELECT unnest(range(0, {classes})) AS y) k LEFT JOIN n{tag} n ON n.node = u.node AND n.fi = u.fi AND n.v = u.v AND n.y = k.y),
    z{tag} AS (SELECT *, sum(l) OVER (PARTITION BY node, fi, v) AS nl, sum(t) OVER (PARTITION BY node, fi, v) AS nt FROM w{tag}),
    h{tag} AS MATERIALIZED (SELECT node, fi, v, CAST(any_value(nl) AS BIGINT) AS nl, CAST(any_value(nt - nl) AS BIGINT) AS nr, sum(CASE WHEN l > 0 THEN -(l / nl) * log2(l / nl) ELSE 0 END) AS hl,
        sum(CASE WHEN t > l THEN -((t - l) / (nt - nl)) * log2((t - l) / (nt - nl)) ELSE 0 END) AS hr, sum(CASE WHEN t > 0 THEN -(t / nt) * log2(t / nt) ELSE 0 END) AS h FROM z{tag} GROUP BY ALL),
    g{tag} AS (SELECT h.*, nx, rk, h - nl / (nl + nr) * hl - nr / (nl + nr) * hr AS gain, -(nl / (nl + nr)) * log2(nl / (nl + nr)) - nr / (nl + nr) * log2(nr / (nl + nr)) AS info
        FROM h{tag} h JOIN u{tag} USING (node, fi, v) WHERE nx IS NOT NULL),
    sc{tag} AS (SELECT node, fi, (v + nx) / 2 AS threshold, {score} AS score, nl AS n_left, nr AS n_right FROM g{tag} {cap}),
    best{tag} AS (SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, fi, threshold) AS rk FROM sc{tag}) WHERE rk = 1)"""


_DOWN = "CASE WHEN fi IS NULL THEN node ELSE 2 * node + CAST(x[fi + 1] > threshold AS INT) END"


def tree_ctes(
    rows: str, criterion: str = "ratio", candidates: int | None = None, least: float = 1e-5, features: int = 3, classes: int = TYPES, depth: int = 10
) -> str:
    """CTEs of a tree on ``rows``: rz (row_id, x, y, node) with leaves, sp (node, fi, threshold, score) and lab (node, label, n_rows)."""
    out = f"r0 AS MATERIALIZED (SELECT *, 1 AS node FROM ({rows}))"
    for k in range(depth):
        out += f""", op{k} AS (SELECT node FROM r{k} WHERE node >= {2**k} GROUP BY node HAVING count(*) >= 2 AND count(DISTINCT y) > 1),
    o{k} AS MATERIALIZED (SELECT r{k}.* FROM r{k} JOIN op{k} USING (node)), {split_ctes(f"_{k}", f"o{k}", criterion, candidates, features, classes)},
    s{k} AS MATERIALIZED (SELECT * FROM best_{k} WHERE round(score, 9) >= {least}),
    r{k + 1} AS MATERIALIZED (SELECT row_id, x, y, {_DOWN} AS node FROM r{k} LEFT JOIN s{k} USING (node))"""
    every = lambda what: " UNION ALL ".join(what(k) for k in range(depth + 1))
    return f"""{out}, rz AS (SELECT * FROM r{depth}), sp AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(depth))}),
    nodes AS ({every(lambda k: f"SELECT node, y FROM r{k} WHERE node >= {2**k}")}),
    lab AS MATERIALIZED (SELECT node, y AS label, n_rows FROM (SELECT node, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY node) AS n_rows,
        row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, y) AS rk FROM nodes GROUP BY node, y) WHERE rk = 1)"""


@query("c45_best_split", f"WITH r AS (SELECT *, 1 AS node FROM ({_PART})), {split_ctes('', 'r')} SELECT node, fi, round(threshold, 6) AS threshold, round(score, 6) AS score, n_left, n_right FROM best")
def c45_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_frame(spark, sf_dir)
    cells = rows.select(F.lit(1).alias("node"), "y", F.posexplode("x").alias("fi", "v"))
    found = splits.best_splits(splits.split_scores(splits.counted(cells, TYPES), TYPES))
    return report(found.drop("left", "right"))


_TREE = f"WITH {tree_ctes(_PART)}"


def _table(spark: SparkSession, grown: tree.Tree) -> DataFrame:
    split = lambda n, v: round(v, 6) if n.feature is not None else None
    rows = [(i, n.feature, split(n, n.threshold), split(n, n.ratio), int(sum(n.counts)), n.label) for i, n in grown.nodes.items()]
    return spark.createDataFrame(rows, "node int, fi int, threshold double, score double, n_rows long, label int")


@query("c45_tree", f"{_TREE} SELECT node, fi, round(threshold, 6) AS threshold, round(score, 6) AS score, CAST(n_rows AS BIGINT) AS n_rows, label FROM lab LEFT JOIN sp USING (node)")
def c45_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, tree.grow(part_frame(spark, sf_dir), TYPES, 3))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_frame(spark, sf_dir)
    return tree.predict(rows, tree.grow(rows, TYPES, 3))


@query("c45_predict", f"{_TREE} SELECT row_id, y, node AS leaf, label AS pred FROM rz JOIN lab USING (node)")
def c45_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("row_id", "y", "leaf", "pred")


@query("c45_predict_proba", f"""{_TREE}, q AS (SELECT node, CAST(k AS INT) AS k, count_if(y = k) / count(*) AS p FROM rz, range(0, {TYPES}) t(k) GROUP BY node, k)
    SELECT row_id, k, round(p, 6) AS p FROM rz JOIN q USING (node)""")
def c45_predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_predicted(spark, sf_dir).select("row_id", F.posexplode("proba").alias("k", "p")))


_SPLIT = split_sql(_PART, "row_id")


def test_paths(depth: int = 10) -> str:
    """CTEs v0 ... : rows of sp0 held out for testing, and the nodes they are in at each level; vz is the last, pa all of them."""
    out = "v0 AS MATERIALIZED (SELECT row_id, x, y, 1 AS node FROM sp0 WHERE is_test)"
    for k in range(depth):
        out += f", v{k + 1} AS MATERIALIZED (SELECT row_id, x, y, {_DOWN} AS node FROM v{k} LEFT JOIN s{k} USING (node))"
    passed = " UNION ALL ".join(f"SELECT row_id, node FROM v{k} WHERE node >= {2**k}" for k in range(depth + 1))
    return f"{out}, vz AS (SELECT * FROM v{depth}), pa AS MATERIALIZED ({passed})"


_PRUNED = f"""WITH sp0 AS MATERIALIZED ({_SPLIT}), {tree_ctes("SELECT row_id, x, y FROM sp0 WHERE NOT is_test")}, {test_paths()},
    ps AS MATERIALIZED (SELECT pa.node, count(*) AS n, CAST(count_if(ll.label = vz.y) AS BIGINT) AS as_subtree, CAST(count_if(nl.label = vz.y) AS BIGINT) AS as_leaf
        FROM pa JOIN vz USING (row_id) JOIN lab ll ON ll.node = vz.node JOIN lab nl ON nl.node = pa.node GROUP BY pa.node)"""


@query("c45_prune_stats", f"{_PRUNED} SELECT * FROM ps")
def c45_prune_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.train_test_split(part_frame(spark, sf_dir), "row_id")
    grown = tree.grow(rows.filter("not is_test"), TYPES, 3)
    return tree.prune_stats(grown, rows.filter("is_test"))


@query("c45_pruned_predict", f"""{_PRUNED}, cut AS (SELECT node FROM ps JOIN sp USING (node) WHERE as_leaf >= as_subtree),
    fin AS (SELECT vz.row_id, vz.y, coalesce(c.node, vz.node) AS leaf, c.node AS pruned FROM vz LEFT JOIN (SELECT row_id, min(node) AS node FROM pa JOIN cut USING (node) GROUP BY row_id) c USING (row_id)),
    vl AS (SELECT node, y AS label FROM (SELECT pa.node, y, row_number() OVER (PARTITION BY pa.node ORDER BY count(*) DESC, y) AS rk FROM pa JOIN vz USING (row_id) GROUP BY pa.node, y) WHERE rk = 1)
    SELECT row_id, fin.y, CAST(leaf AS INT) AS leaf, CASE WHEN pruned IS NULL THEN lab.label ELSE vl.label END AS pred FROM fin LEFT JOIN lab ON lab.node = leaf LEFT JOIN vl ON vl.node = leaf""")
def c45_pruned_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the held-out rows of the tree that they have pruned."""
    rows = prep.train_test_split(part_frame(spark, sf_dir), "row_id")
    held = rows.filter("is_test")
    pruned = tree.prune(tree.grow(rows.filter("not is_test"), TYPES, 3), held)
    return tree.predict(held, pruned).select("row_id", "y", "leaf", "pred")


_GAIN = tree_ctes(_PART, "gain", 20, 0.001, depth=6)
_IMPORTANCE = "im AS (SELECT f.fi, coalesce(sum(n_rows), 0) / (SELECT greatest(sum(n_rows), 1) FROM sp JOIN lab USING (node)) AS importance FROM (SELECT unnest([0, 1, 2]) AS fi) f LEFT JOIN (sp JOIN lab USING (node)) s ON s.fi = f.fi GROUP BY f.fi)"


@query("embedded_importance", f"WITH {_GAIN}, {_IMPORTANCE} SELECT fi, round(importance, 6) AS importance FROM im ORDER BY round(importance, 9) DESC, fi LIMIT 15")
def embedded_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.importance(part_frame(spark, sf_dir), TYPES, 3)
    ranked = sorted(enumerate(found), key=lambda p: (-round(p[1], 9), p[0]))[:15]
    return spark.createDataFrame([(i, round(v, 6)) for i, v in ranked], "fi int, importance double")


@query("select_pipeline", f"""WITH {_GAIN}, {_IMPORTANCE}, pc AS (SELECT i - 1 AS fi, abs(corr(x[i], y)) AS s FROM ({_PART}), range(1, 4) t(i) GROUP BY i),
    ch AS (SELECT fi FROM (SELECT fi FROM pc ORDER BY round(s, 9) DESC, fi LIMIT 1) UNION SELECT fi FROM (SELECT fi FROM im ORDER BY round(importance, 9) DESC, fi LIMIT 1))
    SELECT CAST(fi AS INT) AS fi FROM ch ORDER BY fi LIMIT 2""")
def select_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impute, scale, the best feature by filter and by embedded method, their union in index order, the first two."""
    names = ["a", "b", "c"]
    wide = part_frame(spark, sf_dir).select("row_id", "y", *[F.col("x")[k].alias(n) for k, n in enumerate(names)])
    ready = prep.preprocess(wide, "row_id", names, "mean", "standard")
    rows = ready.select("row_id", "y", F.array(*names).alias("x"))
    filtered = {r.fi for r in select.top(select.pearson_scores(rows), 1).collect()}  # one feature
    weights = tree.importance(rows, TYPES, 3)
    embedded = {max(range(3), key=lambda k: (round(weights[k], 9), -k))}
    return spark.createDataFrame([(f,) for f in sorted(filtered | embedded)[:2]], "fi int")


# SVM


@query("svm_gamma", f"SELECT {V.DIMS} AS d, round(var_pop(v), 9) AS var, round(1 / ({V.DIMS} * var_pop(v) + 1e-10), 6) AS gamma FROM ({V.VEC_LONG_SQL})")
def svm_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(svm.gamma(V.vec_frame(spark, sf_dir)), 6, var=9)


@query("svm_decision", f"""WITH x AS ({V.VEC_SQL}), sv AS (SELECT x AS v, CASE WHEN label % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END AS coef FROM x ORDER BY vec_id LIMIT 20)
    SELECT vec_id, round(sum(coef * exp(-0.5 * pow(list_distance(x, v), 2))) + 0.1, 6) AS decision FROM x, sv GROUP BY vec_id""")
def svm_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    coef = F.when(F.col("y") % 2 == 0, 0.5).otherwise(-0.5)
    vectors = rows.orderBy("row_id").limit(20).select(F.col("row_id").alias("sv_id"), coef.alias("coef"), F.col("x").alias("v"))
    return report(svm.decision(rows, vectors, 0.5, 0.1).select(F.col("row_id").alias("vec_id"), "decision"))


@query("svm_ovo_vote", f"""WITH x AS ({V.VEC_SQL}), m AS (SELECT label AS k, list(m ORDER BY fi) AS c FROM (SELECT label, fi, avg(v) AS m FROM ({V.VEC_LONG_SQL}) GROUP BY label, fi) GROUP BY label),
    z AS (SELECT vec_id, a.k AS a, b.k AS b, list_dot_product(x, a.c) - list_dot_product(x, b.c) - (list_dot_product(a.c, a.c) - list_dot_product(b.c, b.c)) / 2 AS z FROM x, m a, m b WHERE a.k < b.k),
    v AS (SELECT vec_id, CASE WHEN z >= 0 THEN a ELSE b END AS k, count(*) AS n FROM z GROUP BY ALL)
    SELECT vec_id, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, k) AS rk FROM v) WHERE rk = 1""")
def svm_ovo_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote over pairwise planes halfway between class means."""
    import numpy as np

    rows = V.vec_frame(spark, sf_dir)
    means = {r.k: np.array(r.c) for r in centroids(rows).collect()}  # a row per class
    pairs = [(a, b) for a in sorted(means) for b in sorted(means) if a < b]
    planes = np.array([np.append(means[a] - means[b], -(means[a] @ means[a] - means[b] @ means[b]) / 2) for a, b in pairs])
    return svm.OneVsOne(pairs, planes).predict(rows).select(F.col("row_id").alias("vec_id"), "pred")


@query("svm_hinge_gradient_step", f"""SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, fi, round(-sum(CASE WHEN label = a THEN v ELSE -v END), 6) + 0.0 AS gradient
    FROM ({V.VEC_LONG_SQL}), range(0, 10) ta(a), range(0, 10) tb(b) WHERE a < b AND label IN (a, b) GROUP BY a, b, fi""")
def svm_hinge_gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    from tabmine.operators.batches import summed

    pairs = [(a, b) for a in range(10) for b in range(a + 1, 10)]
    zero = np.zeros((len(pairs), V.DIMS + 1))
    g = summed(V.vec_frame(spark, sf_dir), lambda x, y: svm.hinge_gradient(x, y, pairs, zero, 1.0)).reshape(len(pairs), -1)
    rows = [(a, b, j, float(g[k, 1 + j])) for k, (a, b) in enumerate(pairs) for j in range(V.DIMS)]
    return report(spark.createDataFrame(rows, "a int, b int, fi int, gradient double"))


@query("svm_ovo_linear", f"WITH RECURSIVE {T.svm_ctes(V.VEC_SQL, V.VEC_SQL)} SELECT * FROM p")
def svm_ovo_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    return svm.train(rows, list(range(10))).predict(rows).select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), "pred")


@query("svm_ovo_rbf_rff")
def svm_ovo_rbf_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = svm.fourier_features(V.vec_frame(spark, sf_dir), 0.5, 64)
    return svm.train(rows, list(range(10))).predict(rows).select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), "pred")


# PCA


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linalg.pca(V.vec_frame(spark, sf_dir)).explained()
    return report(spark.createDataFrame(found, "component int, variance double, ratio double, cumulative double"), 6, variance=9)


@query("pca_explained_variance")
def pca_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir)


_LEADING = f"WITH {T.pca_ctes(3)}, e AS (" + " UNION ALL ".join(f"SELECT {n} AS component, variance FROM e{n}" for n in (1, 2, 3)) + """)
    SELECT component, round(variance, 9) AS variance, round(variance / total, 6) AS ratio, round(sum(variance) OVER (ORDER BY component) / total, 6) AS cumulative FROM e, tr"""


@query("pca_leading_variance", _LEADING)
def pca_leading_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading components, their shares being of the variance of all."""
    return _explained(spark, sf_dir).filter("component <= 3")


@query("pca_leading_krylov", _LEADING)
def pca_leading_krylov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three without a covariance matrix."""
    found = linalg.leading(V.vec_frame(spark, sf_dir), 3).explained()
    return report(spark.createDataFrame(found, "component int, variance double, ratio double, cumulative double"), 6, variance=9)


def _projected(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = V.vec_frame(spark, sf_dir)
    out = linalg.pca(rows).transform(rows, k)
    return report(out.select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), *[f"pc{j + 1}" for j in range(k)]))


@query("pca_project_2d", f"WITH {T.pca_ctes(2)} {T.projected_sql(2)}")
def pca_project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, 2)


@query("pca_project_3d", f"WITH {T.pca_ctes(3)} {T.projected_sql(3)}")
def pca_project_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, 3)


@query("pca_prediction_map", f"SELECT a.*, pred, pred = a.label AS correct FROM (WITH {T.pca_ctes(2)} {T.projected_sql(2)}) a JOIN (WITH {GNB_SQL}, {GNB_PRED} SELECT vec_id, pred FROM p) b USING (vec_id)")
def pca_prediction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gnb_predictions(spark, sf_dir).select(F.col("row_id").alias("vec_id"), "pred")
    return _projected(spark, sf_dir, 2).join(found, "vec_id").withColumn("correct", F.col("pred") == F.col("label"))


# MLP

_WAVES = [V.DIMS, 4, 10]
_FORWARD = f"""x AS ({V.VEC_SQL}), h AS (SELECT vec_id, label, j, tanh(sum(x[i + 1] * sin(i * 4 + j + 1)) + cos(j)) AS h FROM x, range(0, {V.DIMS}) ti(i), range(0, 4) tj(j) GROUP BY vec_id, label, j),
    o AS (SELECT vec_id, label, k, sum(h * sin(j * 10 + k + 2)) + cos(k + 1) AS z FROM h, range(0, 10) tk(k) GROUP BY vec_id, label, k),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM o), p AS (SELECT vec_id, label, CAST(k AS INT) AS k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"""


@query("mlp_forward", f"WITH {_FORWARD} SELECT vec_id, k, round(p, 6) AS p FROM p")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mlp.Model(mlp.waves(_WAVES), "tanh", []).predict(V.vec_frame(spark, sf_dir))
    return report(out.select(F.col("row_id").alias("vec_id"), F.posexplode("proba").alias("k", "p")))


@query("mlp_loss", f"WITH {_FORWARD} SELECT round(avg(-ln(p + 1e-15)), 6) AS loss FROM p WHERE k = label")
def mlp_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mlp.Model(mlp.waves(_WAVES), "tanh", []).predict(V.vec_frame(spark, sf_dir))
    return report(out.agg(F.avg(-F.log(F.get("proba", F.col("y")) + 1e-15)).alias("loss")))


@query("mlp_gradient_step", f"""WITH {_FORWARD} SELECT k, round(cos(k + 1) - CAST(0.1 AS DOUBLE) * avg(p - CAST(k = label AS DOUBLE)), 6) AS output_bias FROM p GROUP BY k""")
def mlp_gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full-batch SGD step from fixed weights: the output biases after it."""
    weights = mlp.waves(_WAVES)
    _, _, g = mlp.gradient(V.vec_frame(spark, sf_dir), weights, "tanh")
    new = mlp.unpack(mlp.Optimiser("sgd", 0.1).step(mlp.flat(weights), g), weights)
    return report(spark.createDataFrame([(k, float(b)) for k, b in enumerate(new[-1][1])], "k int, output_bias double"))


# The first steps from the same starting weights, one batch an epoch

_START = mlp.initial([V.DIMS, 16, 10])
_LISTED = [float(v) for w, b in _START for v in (*w.T.ravel(), *b)]
_STEPS = 8


def _stepped(optimiser: str, rate: float) -> None:
    ctes = T.mlp_ctes(_LISTED, 16, 10, optimiser, rate, _STEPS)
    weights = f"(SELECT w FROM st WHERE t = {_STEPS}), xs"

    @query(f"mlp_steps_{optimiser}", f"WITH RECURSIVE {ctes} SELECT vec_id, label, round(list_max(p), 5) AS p, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pred FROM ({T.mlp_forward_sql(weights, 16, 10)})")
    def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = V.vec_frame(spark, sf_dir)
        found = mlp.train(rows, [16], 10, optimiser, rate, epochs=_STEPS, batches=1).predict(rows)
        return report(found.select(F.col("row_id").alias("vec_id"), F.col("y").alias("label"), F.array_max("proba").alias("p"), "pred"), 5)

    @query(f"mlp_steps_{optimiser}_loss", f"WITH RECURSIVE {ctes} SELECT t AS epoch, round(loss, 6) AS loss FROM st WHERE t > 0")
    def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = mlp.train(V.vec_frame(spark, sf_dir), [16], 10, optimiser, rate, epochs=_STEPS, batches=1)
        return report(spark.createDataFrame(list(enumerate(model.history, 1)), "epoch int, loss double"))


for _name, _rate in (("sgd", 0.5), ("momentum", 0.1), ("adam", 0.02)):
    _stepped(_name, _rate)
