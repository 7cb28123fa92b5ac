"""Operators on small literal frames with answers worked out by hand or by NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmine.functions import columns as C
from tabmine.operators import batches, chartdata, frame, kmeans, knn, linalg, metrics, mlp, naive_bayes, prep, profile, select, svm, tree, validate
from tabmine.sources import delimited, results


def points(spark, x, y=None):
    y = [0] * len(x) if y is None else y
    rows = [(k, [float(v) for v in p], int(c)) for k, (p, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y int")


@pytest.fixture(scope="module")
def blobs():
    draw = np.random.default_rng(1)
    y = np.arange(120) % 3
    return draw.normal(0, 0.5, (120, 4)) + np.array([[0, 0, 1, 0], [2, 0, 0, 1], [0, 2, 0, 0]])[y], y


# ingest


def test_number_cells(spark):
    cells = ["1", " 2.5 ", ".28", "3d", "1_000", "NaN", "NA", "", None, "-1e3", "."]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(C.number(F.col("c")).alias("n")).collect()
    assert [r.n for r in rows] == [1.0, 2.5, 0.28, None, None, None, None, None, None, -1000.0, None]


def test_detection():
    assert delimited.detect_delimiter(["a;b;c", "1;2,5;3"]) == ";"
    assert delimited.detect_delimiter(["a\tb", "c\td"]) == "\t"
    assert delimited.detect_delimiter(["one", "two"]) == ","
    assert delimited.detect_header(["a,b,label", "1,2,x"], ",")
    assert not delimited.detect_header(["1,2,x", "3,4,y"], ",")
    assert delimited.detect_header(["a", "1,2"], ",")


def test_reading_files(spark, tmp_path):
    toy = tmp_path / "toy.csv"
    toy.write_bytes("\ufeffa,b,c,label\r\n1,2,3,A\r\n\r\n5,.5,NA,B\r\n9,10\r\n".encode())
    out = delimited.labelled(delimited.read_cells(spark, str(toy))).drop("row_id").collect()
    assert {tuple(r) for r in out} == {(1.0, 2.0, 3.0, "A"), (5.0, 0.5, None, "B")}
    first = tmp_path / "first.csv"
    first.write_text("id1,M,1.5,2\nid2,B,2.5,3\n")
    out = delimited.labelled(delimited.read_cells(spark, str(first)), target=0, skip=[0]).drop("row_id").collect()
    assert sorted((r.label, r.c2, r.c3) for r in out) == [("B", 2.5, 3.0), ("M", 1.5, 2.0)]
    odd = tmp_path / "odd.csv"
    odd.write_bytes('made by hand\n\n"a,x";b;label\n1;;é\n2;4\n"3";5;"y;z";9\n'.encode("latin-1"))
    out = delimited.read_cells(spark, str(odd), ";", True, "ISO-8859-1", 1)
    assert out.columns == ["a,x", "b", "label"] and sorted(map(tuple, out.collect())) == [("1", None, "é"), ("3", "5", "y;z")]
    start = tmp_path / "start.csv"
    start.write_text("0,2,4.0\n1,3,5.0\n1,3,5.0\n0,2\n")  # the label first, a short row last
    out = [delimited.labelled(delimited.read_cells(spark, str(start)).repartition(n), target=0).collect() for n in (1, 3)]
    assert sorted(out[0]) == sorted(out[1]) and len({r.row_id for r in out[0]}) == 3
    assert sorted((r.label, r.c1, r.c2) for r in out[0]) == [("0", 2.0, 4.0), ("1", 3.0, 5.0), ("1", 3.0, 5.0)]
    (tmp_path / "none.csv").write_text("")
    assert delimited.read_cells(spark, str(tmp_path / "none.csv")).columns == []


def test_roles(spark):
    cells = spark.createDataFrame([("x", "1", "NA", "u"), ("y", "2", "4", "v")], "kind string, a string, b string, c string")
    assert [r.role for r in delimited.column_roles(cells).orderBy("position").collect()] == ["ignored", "feature", "feature", "label"]
    numbers = spark.createDataFrame([("1", "2"), ("3", "4")], "a string, b string")
    assert [r.role for r in delimited.column_roles(numbers).orderBy("position").collect()] == ["feature", "label"]
    one = spark.createDataFrame([("1",)], "a string")
    assert [r.role for r in delimited.column_roles(one).collect()] == ["feature"]


def test_catalog_reports_failures(spark):
    entries = {"good": delimited.Dataset("/root/testdata/sf0.001/part.parquet", ["p_size"], "p_type"), "bad": delimited.Dataset("/nowhere", ["a"], "b")}
    frames, errors = delimited.load_all(spark, entries)
    assert list(frames) == ["good"] and list(errors) == ["bad"]
    assert delimited.summary(frames, entries).collect()[0].n_features == 1


# profiling


def test_moments_guard_small_and_constant(spark):
    rows = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (10.0, 5.0, None)], "a double, b double, c double")
    skew = {r.feature: r.skewness for r in profile.skewness(rows, ["a", "b", "c"]).collect()}
    assert skew["b"] == skew["c"] == 0 and skew["a"] == pytest.approx(3.04, abs=0.01)
    assert {r.kurtosis for r in profile.kurtosis(rows, ["a", "b", "c"]).collect()} == {0.0}
    full = {r.feature: r for r in profile.full_stats(rows, ["a", "c"]).collect()}
    assert (full["a"].median, full["a"].q25, full["c"].missing) == (2.0, 1.5, 2)


def test_histogram_of_a_constant(spark):
    rows = spark.createDataFrame([(0, 3.0)] * 4, "fi int, v double")
    n = {r.bin: r.n for r in chartdata.histogram(rows, ["fi"]).collect()}
    assert n[10] == 4 and sum(n.values()) == 4 and len(n) == 20


def test_correlation_with_a_constant(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (4.0, 5.0, 8.0)], "a double, b double, c double")
    r = {(x.i, x.j): x.r for x in profile.correlations(rows, ["a", "b", "c"]).collect()}
    assert r[0, 1] is None and r[0, 2] == pytest.approx(1.0) and r[0, 0] == pytest.approx(1.0)


# preparation


def test_scaling(spark):
    rows = spark.createDataFrame([(k, float(k), 7.0) for k in range(5)], "id long, a double, b double")
    out = np.array([[r.a, r.b] for r in prep.standard_scale(rows, ["a", "b"]).collect()])
    assert out[:, 0].mean() == pytest.approx(0) and out[:, 0].std() == pytest.approx(1) and (out[:, 1] == 0).all()
    assert {r.b for r in prep.minmax_scale(rows, ["b"], -1, 1).collect()} == {-1.0}
    back = prep.standard_unscale(prep.standard_scale(rows, ["a", "b"]), ["a", "b"], rows)
    assert sorted(r.a for r in back.collect()) == pytest.approx([0, 1, 2, 3, 4])


@pytest.mark.parametrize("parts", [1, 7])
def test_splits(spark, parts):
    rows = spark.range(103).withColumn("c", F.when(F.col("id") < 1, "one").otherwise("many")).repartition(parts)
    test = {r.id for r in prep.train_test_split(rows, "id").collect() if r.is_test}
    assert len(test) == 20
    assert test == {r.id for r in prep.train_test_split(rows.coalesce(1), "id").collect() if r.is_test}
    per = prep.stratified_split(rows, "id", "c").filter("is_test").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in per} == {"one": 1, "many": 20}
    folds = validate.kfold(rows, 10, row_id="id").groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {k: 11 if k < 3 else 10 for k in range(10)}


def test_unknown_label_is_an_error(spark):
    codes = frame.label_dictionary(spark.createDataFrame([("b",), ("a",)], "l string"), "l")
    assert {r.label: r.y for r in codes.collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="unknown label c"):
        frame.encode(spark.createDataFrame([("c",)], "l string"), "l", codes).collect()


# models


def brute_neighbors(x, q, k):
    d = np.round(np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1)), 9)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_neighbors_over_blocks(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    for size in (17, 2000):
        found = knn.neighbors(rows, rows, 4, size=size).orderBy("qid", "rank").collect()
        assert [[r.tid for r in found[4 * i : 4 * i + 4]] for i in range(len(x))] == brute_neighbors(x, x, 4).tolist()
    ties = points(spark, [[0.0], [1.0], [-1.0], [1.0]])
    assert [r.tid for r in knn.neighbors(ties.filter("row_id = 0"), ties, 3).orderBy("rank").collect()] == [0, 1, 2]
    shares = knn.vote(knn.neighbors(rows, rows, 5), "distance")
    assert all(r.s == pytest.approx(1) for r in shares.groupBy("qid").agg(F.sum("p").alias("s")).collect())


def test_gaussian_nb(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    found = naive_bayes.predict_gaussian(rows, naive_bayes.fit_gaussian(rows)).orderBy("row_id").collect()
    ll = np.stack([np.log((y == c).mean()) + (-0.5 * np.log(2 * np.pi * (x[y == c].var(0) + 1e-9)) - (x - x[y == c].mean(0)) ** 2 / (2 * (x[y == c].var(0) + 1e-9))).sum(1) for c in range(3)], 1)
    assert np.allclose([r.ll for r in found], ll) and [r.pred for r in found] == ll.argmax(1).tolist()
    assert np.allclose([sum(r.proba) for r in found], 1)


def test_multinomial_nb_rejects_negative_counts(spark):
    counts = spark.createDataFrame([(1, "a", 2), (2, "b", -1)], "row_id long, term string, n long")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, y int")
    with pytest.raises(Exception, match="negative"):
        naive_bayes.fit_multinomial(counts, labels)[0].collect()


def test_fold_models_equal_direct_fits(spark, blobs):
    x, y = blobs
    folded = validate.kfold(points(spark, x, y), 4)
    fold = {r.row_id: r.fold for r in folded.collect()}
    f = np.array([fold[i] for i in range(len(x))])
    for r in select.fold_models(folded).collect():
        part = x[(f != r.fold) & (y == r.y), r.fi]
        assert r["mean"] == pytest.approx(part.mean()) and r["var"] == pytest.approx(part.var() + 1e-9)


def test_tree(spark):
    x = [[v, 1.0] for v in (1, 2, 3, 4, 5, 6, 7, 8)]
    y = [0, 0, 0, 1, 1, 1, 0, 0]
    grown = tree.grow(points(spark, x, y), 2, 2)
    out = tree.predict(points(spark, x, y), grown).orderBy("row_id").collect()
    assert [r.pred for r in out] == y and all(sum(r.proba) == pytest.approx(1) for r in out)
    assert tree.grow(points(spark, x, y), 2, 2, max_depth=0).nodes.keys() == {1}
    assert tree.grow(points(spark, x, [1] * 8), 2, 2).nodes[1].label == 1
    assert tree.grow(points(spark, [[1.0, 1.0]] * 4, [0, 0, 1, 1]), 2, 2).nodes[1].label == 0  # no split; the tie goes low
    pruned = tree.prune(grown, points(spark, x, [0, 0, 0, 0, 0, 1, 0, 0]))
    assert len(pruned.nodes) < len(grown.nodes)
    assert sum(tree.importance(points(spark, x, y), 2, 2)) == pytest.approx(1)


def test_kmeans(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    centres = [list(x[k]) for k in range(3)]
    last = math.inf
    for _ in range(4):
        d = ((x[:, None] - np.array(centres)[None]) ** 2).sum(-1)
        new, (inertia,) = kmeans.step(rows, [centres])
        assert inertia == pytest.approx(d.min(1).sum()) and inertia <= last
        assert np.allclose(new[0], [x[d.argmin(1) == c].mean(0) for c in range(3)])
        centres, last = new[0], inertia
    twin = points(spark, [[0.0], [0.0], [10.0], [11.0]])
    moved, _ = kmeans.step(twin, [[[0.0], [0.0], [10.5]]])
    assert sorted(c[0] for c in moved[0]) in ([0.0, 10.0, 10.5], [0.0, 10.5, 11.0])
    seeds = kmeans.plus_plus(rows, 3)
    assert len({tuple(c) for c in seeds}) == 3


def test_silhouette(spark, blobs):
    x, y = blobs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        want.append((b - a) / max(a, b))
    for size in (13, 2000):
        got = kmeans.silhouette_rows(points(spark, x, y), "y", size).orderBy("row_id").collect()
        assert np.allclose([r.s for r in got], want)
    assert kmeans.silhouette(points(spark, x), "y").first().silhouette == 0
    one = kmeans.silhouette_rows(points(spark, [[0.0], [5.0], [5.5]], [0, 1, 1]), "y").filter("row_id = 0").first()
    assert one.s == 1


def test_pca(spark, blobs):
    x, _ = blobs
    found = linalg.pca(points(spark, x))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(found.variances, values) and found.ratios.sum() == pytest.approx(1)
    out = np.array([[r.pc1, r.pc2] for r in found.transform(points(spark, x), 2).collect()])
    assert np.allclose(out.mean(0), 0) and np.allclose(out.var(0, ddof=1), values[:2])
    assert np.allclose(linalg.correlation(points(spark, x)), np.corrcoef(x.T))


def test_svm(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    out = svm.train(rows, [0, 1, 2], steps=30).predict(rows).collect()
    assert np.mean([r.pred == r.y for r in out]) > 0.9
    z = svm.fourier_features(rows, 0.3, 2000).orderBy("row_id").collect()
    z = np.array([r.x for r in z])
    assert np.abs(z @ z.T - np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))).max() < 0.15


def test_mlp_gradient_by_finite_differences(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    for act in ("relu", "tanh", "sigmoid"):
        w = mlp.initial([4, 5, 3], act, 3)
        n, loss, g = mlp.gradient(rows, w, act)
        flat, eps = mlp.flat(w), 1e-6
        at = lambda v: mlp.loss_and_gradient(mlp.unpack(v, w), x, y, act)[1] / len(x)  # noqa: B023, E731
        assert n == len(x) and loss == pytest.approx(at(flat))
        for k in range(0, len(flat), 7):
            step = np.eye(1, len(flat), k)[0] * eps
            assert g[k] == pytest.approx((at(flat + step) - at(flat - step)) / (2 * eps), abs=1e-5)


@pytest.mark.parametrize("name,rate", [("sgd", 0.5), ("momentum", 0.1), ("adam", 0.05)])
def test_mlp_learns(spark, blobs, name, rate):
    x, y = blobs
    model = mlp.train(points(spark, x, y), [8], 3, name, rate, epochs=15, batches=1, decay=1e-4)
    assert model.history[-1] < 0.6 * model.history[0]
    out = model.predict(points(spark, x, y)).collect()
    assert all(sum(r.proba) == pytest.approx(1) for r in out)


# evaluation


def test_metrics_of_a_known_matrix(spark):
    m = [[48, 2, 0], [1, 47, 2], [0, 3, 47]]
    rows = [(t, p) for t in range(3) for p in range(3) for _ in range(m[t][p])]
    matrix = metrics.confusion(spark.createDataFrame(rows, "y int, pred int"))
    assert {(r.true_label, r.pred_label): r.n for r in matrix.collect()} == {(t, p): m[t][p] for t in range(3) for p in range(3)}
    s = metrics.summary(matrix).first()
    assert s.accuracy == s.f1_micro == pytest.approx(142 / 150)
    assert s.precision_macro == pytest.approx(np.mean([48 / 49, 47 / 52, 47 / 49]))


def test_absent_labels_count_in_macro(spark):
    s = metrics.summary(metrics.confusion(spark.createDataFrame([(0, 0), (2, 2)], "y int, pred int"))).first()
    assert s.recall_macro == pytest.approx(2 / 3) and s.accuracy == 1


def test_roc(spark):
    draw = np.random.default_rng(4)
    score, positive = np.round(draw.random(400), 2), draw.random(400) < 0.4
    rows = spark.createDataFrame([(float(s), bool(p)) for s, p in zip(score, positive, strict=True)], "score double, positive boolean")
    a, b = score[positive], score[~positive]
    want = np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b))
    for size in (9, 65_536):
        assert metrics.auc(metrics.roc(rows, size=size), size=size).first().auc == pytest.approx(want)
    single = metrics.roc(spark.createDataFrame([(0.3, True), (0.6, True)], "score double, positive boolean"))
    assert sorted((r.fpr, r.tpr) for r in single.collect()) == [(0.0, 0.0), (1.0, 1.0)]


def test_grid_keeps_errors(spark, blobs, tmp_path):
    x, y = blobs
    def broken(rows, k):
        raise ValueError("no such model")

    grid = validate.grid(spark, {"blobs": points(spark, x, y)}, {"nb": lambda rows, k: validate.gaussian_fold_predictions(rows), "broken": broken}, 3, 2)
    cells = grid.collect()
    assert [r.error for r in cells if r.algorithm == "broken"] == ["no such model"]
    assert validate.result_matrix(grid.filter("error is null"), algorithms=["nb", "svm"]).first().svm == 0
    assert validate.best_algorithms(grid.filter("error is null")).first().algorithm == "nb"
    results.write_json(grid, str(tmp_path / "r"))
    assert results.read_json(spark, str(tmp_path / "r")).count() == len(cells)
    summary = grid.withColumn("mean", F.col("value"))
    results.write_csv(summary, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == [
        "Dataset", "Algorithm", "Accuracy", "Accuracy_Std", "F1_Macro", "F1_Std", "Train_Time", "Time_Std"
    ]


def test_selection(spark, blobs):
    x, y = blobs
    rows = points(spark, np.hstack([x, np.zeros((len(x), 1))]), y)
    r = {s.fi: s.score for s in select.pearson_scores(rows).collect()}
    assert r[4] == 0 and r[0] == pytest.approx(abs(np.corrcoef(x[:, 0], y)[0, 1]))
    assert 4 not in {s.fi for s in select.variance_filter(rows).collect()}
    assert [f for f, _ in select.backward_elimination(rows, 9, 5)] == []
    assert len(select.forward_selection(rows, 2, 5)) == 2


def test_running_sums_over_buckets(spark):
    rows = spark.createDataFrame([(k % 3, float((k * 37) % 101), k) for k in range(300)], "g int, v double, k int")
    for size in (9, 65_536):
        for order, key in ((["v", "k"], lambda r: (r.v, r.k)), ([F.desc("v"), "k"], lambda r: (-r.v, r.k))):
            out = frame.running_sum(rows, F.col("k"), "run", order, ["g"], size)
            assert out.columns == ["g", "v", "k", "run"]
            for g in range(3):
                part = sorted((r for r in out.collect() if r.g == g), key=key)
                assert [r.run for r in part] == np.cumsum([r.k for r in part]).tolist()


def test_ranks_and_curves_do_not_depend_on_ranges(spark):
    rows = spark.createDataFrame([(f"r{k}", k % 4, float(k * 37 % 23), int(k * 29 % 7 < 3)) for k in range(250)], "id string, g int, score double, positive int")
    for by in (None, ["g"]):
        ranks = [sorted((r.id, r.rank) for r in frame.shuffled_rank(rows, "id", 7, by, size=n).collect()) for n in (10, 65_536)]
        assert ranks[0] == ranks[1] and (by or sorted(r for _, r in ranks[0]) == list(range(1, 251)))
        curves = [metrics.roc(rows, by=by, size=n) for n in (3, 65_536)]
        assert sorted(map(str, curves[0].collect())) == sorted(map(str, curves[1].collect()))
        areas = [sorted(r.auc for r in metrics.auc(curves[1], by, size=n).collect()) for n in (3, 65_536)]
        assert areas[0] == pytest.approx(areas[1])
    plan = frame.ranged(rows, ["score"], 10)[0]._jdf.queryExecution().toString()
    assert "37.0" not in plan and "Split" not in plan  # no borders in the plan


def test_quantiles_by_brackets(spark):
    draw = np.random.default_rng(8)
    v = np.round(draw.normal(0, 1, 4000) ** 3, 3)
    rows = spark.createDataFrame([(k % 2, float(x) if k % 50 else None) for k, x in enumerate(v)], "g int, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for size, accuracy in ((65_536, 10_000), (40, 100)):
        for r in frame.quantiles(rows, ["g"], "v", probs, accuracy, size).collect():
            some = [x for k, x in enumerate(v) if k % 2 == r.g and k % 50]
            assert r.n == len(some) and np.allclose(r.q, np.quantile(some, probs))
    assert np.allclose(frame.quantiles(rows.filter("g = 1"), [], "v", [0.5]).first().q, np.median([x for k, x in enumerate(v) if k % 2]))
    assert frame.quantiles(rows.filter("g = 7"), ["g"], "v", [0.5]).count() == 0


def test_block_pairs_of_large_sides(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    f = lambda a, b: {"s": np.array([batches.distances(a["x"], b["x"], "manhattan").sum()])}
    sums = [batches.block_pairs(rows, rows, f, "s double", ["row_id", "x"], ["row_id", "x"], 17, most).agg(F.sum("s")).first()[0] for most in (0, 20_000)]
    assert np.allclose(sums, np.abs(x[:, None] - x[None]).sum())


def test_splits_in_buckets_are_the_same(spark, blobs):
    x, y = blobs
    rows = points(spark, x, y)
    cells = rows.select(F.lit(1).alias("node"), "y", F.posexplode("x").alias("fi", "v"))
    for candidates in (None, 3):
        scores = [tree.split_scores(cells, 3, tree.edges(rows, 4, n), candidates=candidates).select("fi", "threshold", "score", "n_left") for n in (10, 400_000)]
        assert sorted(scores[0].collect()) == sorted(scores[1].collect())


def test_wrapper_around_any_model(spark, blobs):
    x, y = blobs
    rows = points(spark, np.hstack([x, np.zeros((len(x), 1))]), y)

    def fit(train):
        model = naive_bayes.fit_gaussian(train)
        return lambda part: naive_bayes.predict_gaussian(part, model)

    assert select.forward_selection(rows, 1, 5, 2, fit=fit) == select.forward_selection(rows, 1, 5, 2)
    assert select.backward_elimination(rows, 4, 5, 2, fit=fit) == select.backward_elimination(rows, 4, 5, 2)


def test_summed_is_the_same_for_any_partitioning(spark, blobs):
    x, y = blobs
    f = lambda a, b: np.append(a.sum(0), b.sum())
    for parts in (1, 7):
        assert np.allclose(batches.summed(points(spark, x, y).repartition(parts), f), f(x, y))


def test_trained_models_take_whole_vectors(spark, monkeypatch):
    from tabmine.jobs.catalog import QUERIES
    from tabmine.operators import local_steps, svm

    seen = []

    def spy(module, steps):
        real = module.train

        def train(rows, *args, **params):
            seen.append((len(rows.first().x), params.get(steps)))
            return real(rows, *args, **(params | {steps: 1}))

        monkeypatch.setattr(module, "train", train)

    spy(svm, "steps")
    spy(local_steps, "epochs")
    for name in ("svm_ovo_linear", "mlp_train_sgd", "mlp_train_momentum", "mlp_train_adam", "mlp_loss_history"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert seen == [(64, None)] + [(64, 200)] * 4
