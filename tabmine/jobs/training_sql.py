"""SQL of iterative training, as recursive queries: SVM steps, K-Means, principal components, MLP steps."""

from __future__ import annotations

from tabmine.jobs import views as V


def svm_ctes(train: str, test: str, steps: int = 60, rate: float = 1.0, c: float = 1.0) -> str:
    """CTEs that end in p (vec_id, label, pred) for tables (vec_id, label, x) to learn from and to predict; needs WITH RECURSIVE."""
    d = V.DIMS
    zeros = "[" + ", ".join(["0.0"] * (d + 1)) + "]::DOUBLE[]"
    sign = "CASE WHEN label = s0.a THEN 1 ELSE -1 END"
    wide = "list_append(x, CAST(1 AS DOUBLE)) AS x"
    return f"""xt AS MATERIALIZED (SELECT vec_id, label, {wide} FROM ({train})),
    pr AS MATERIALIZED (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(count(*) AS DOUBLE) AS n FROM range(0, 10) ra(a), range(0, 10) rb(b), xt WHERE a < b AND label IN (a, b) GROUP BY a, b),
    st(t, a, b, w, m) AS (SELECT 0, a, b, {zeros}, {zeros} FROM pr UNION ALL
        SELECT t + 1, a, b, nw, CASE WHEN t + 1 > {steps // 2} THEN list_transform(list_zip(m, nw), lambda q: q[1] + q[2]) ELSE m END FROM (
            SELECT st.t, st.a, st.b, st.m, list(st.w[i] - CAST({rate} AS DOUBLE) / sqrt(st.t + 1) * (coalesce(g, 0) / n + CASE WHEN i <= {d} THEN st.w[i] ELSE 0 END / n) ORDER BY i) AS nw
            FROM st JOIN pr USING (a, b) CROSS JOIN range(1, {d + 2}) r(i) LEFT JOIN (
                SELECT a, b, i, -CAST({c} AS DOUBLE) * sum(s * x[i]) AS g FROM (SELECT s0.a, s0.b, {sign} AS s, x FROM st s0 JOIN xt ON label = s0.a OR label = s0.b
                    WHERE {sign} * list_dot_product(w, x) < 1) h, range(1, {d + 2}) r2(i) GROUP BY a, b, i) gr USING (a, b, i)
            WHERE st.t < {steps} GROUP BY st.t, st.a, st.b, st.m)),
    fin AS (SELECT a, b, list_transform(m, lambda q: q / {steps - steps // 2}) AS w FROM st WHERE t = {steps}),
    vt AS (SELECT vec_id, label, CASE WHEN list_dot_product(w, x) >= 0 THEN a ELSE b END AS k, count(*) AS n FROM (SELECT vec_id, label, {wide} FROM ({test})), fin GROUP BY ALL),
    p AS (SELECT vec_id, label, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, k) AS rk FROM vt) WHERE rk = 1)"""


def plus_plus_ctes(tag: str, k: int, seed: int) -> str:
    """CTEs that end in i{tag} (k, x): k-means++ centres of xs (vec_id, x) by an exponential race."""
    key = lambda s: f"md5('{s}-' || vec_id)"
    out = f"i{tag}_1 AS MATERIALIZED (SELECT CAST(0 AS INT) AS k, x FROM xs ORDER BY {key(seed)}, vec_id LIMIT 1)"
    for j in range(1, k):
        u = f"(CAST('0x' || substr({key(seed + j)}, 1, 12) AS BIGINT) + 1.0::DOUBLE) / CAST({16**12 + 1} AS DOUBLE)"
        out += f""", i{tag}_{j + 1} AS MATERIALIZED (SELECT * FROM i{tag}_{j} UNION ALL SELECT CAST({j} AS INT), x FROM (SELECT x FROM (
            SELECT xs.vec_id, any_value(xs.x) AS x, min(pow(list_distance(xs.x, c.x), 2)) AS d2 FROM xs, i{tag}_{j} c GROUP BY xs.vec_id) WHERE d2 > 0 ORDER BY -ln({u}) / d2, vec_id LIMIT 1))"""
    return f"{out}, i{tag} AS (SELECT * FROM i{tag}_{k})"


def kmeans_ctes(k: int, seeds: dict[int, int], steps: int = 60) -> str:
    """CTEs xs, fa (r, vec_id, k, d2) and st (t, r, k, c): K-Means of run r from its seed until nothing moves (``steps`` suffice)."""
    inits = ", ".join(plus_plus_ctes(str(r), k, seed) for r, seed in seeds.items())
    begin = " UNION ALL ".join(f"SELECT 0 AS t, {r} AS r, k, x AS c FROM i{r}" for r in seeds)
    near = lambda source: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, vec_id ORDER BY round(d2, 9), k) AS rk FROM
        (SELECT t, r, k, vec_id, x, pow(list_distance(x, c), 2) AS d2 FROM xs, {source})) WHERE rk = 1"""  # noqa: E731
    return f"""xs AS MATERIALIZED (SELECT vec_id, label, x FROM ({V.VEC_SQL})), {inits},
    st(t, r, k, c) AS (({begin}) UNION ALL SELECT t + 1, r, k, list(m ORDER BY i) FROM (SELECT t, r, k, i, avg(x[i]) AS m FROM ({near("st")}) na, range(1, {V.DIMS + 1}) ri(i)
        WHERE t < {steps} GROUP BY t, r, k, i) GROUP BY t, r, k),
    fa AS MATERIALIZED ({near(f"(SELECT * FROM st WHERE t = {steps})")})"""


def pca_ctes(k: int, squarings: int = 14) -> str:
    """CTEs mu (i, m), tr (total variance) and e1 ... ek (variance, v): leading eigenvectors of the covariance by repeated squaring."""
    out = f"""xs AS MATERIALIZED ({V.VEC_SQL}), xl AS MATERIALIZED (SELECT vec_id, i, x[i] AS v FROM xs, range(1, {V.DIMS + 1}) t(i)),
    mu AS MATERIALIZED (SELECT i, avg(v) AS m FROM xl GROUP BY i), xc AS MATERIALIZED (SELECT vec_id, i, v - m AS v FROM xl JOIN mu USING (i)),
    c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM xs) - 1) AS v FROM xc a JOIN xc b USING (vec_id) GROUP BY a.i, b.i),
    tr AS MATERIALIZED (SELECT sum(v) AS total FROM c1 WHERE i = j)"""
    for n in range(1, k + 1):
        out += f", m{n}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c{n} WHERE i = j) AS v FROM c{n})"
        for s in range(squarings):
            out += f""", q{n}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m{n}_{s} a JOIN m{n}_{s} b ON a.j = b.i GROUP BY a.i, b.j),
    m{n}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{n}_{s} WHERE i = j) AS v FROM q{n}_{s})"""
        last = f"m{n}_{squarings}"
        out += f""", k{n} AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1)),
    s{n} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM k{n})) * (SELECT sign(v) FROM k{n} ORDER BY round(abs(v), 12) DESC, i LIMIT 1) AS v FROM k{n}),
    e{n} AS MATERIALIZED (SELECT sum(c.v * a.v * b.v) AS variance, (SELECT list(v ORDER BY i) FROM s{n}) AS v FROM c{n} c JOIN s{n} a ON a.i = c.i JOIN s{n} b ON b.i = c.j),
    c{n + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT variance FROM e{n}) * a.v * b.v AS v FROM c{n} c JOIN s{n} a ON a.i = c.i JOIN s{n} b ON b.i = c.j)"""
    return out


def projected_sql(k: int) -> str:
    """(vec_id, label, pc1 ... pck), to follow pca_ctes(k)."""
    centred = "(SELECT vec_id, label, list(xc.v ORDER BY i) AS x FROM xs JOIN xc USING (vec_id) GROUP BY vec_id, label)"
    pc = ", ".join(f"round(list_dot_product(x, (SELECT v FROM e{n})), 6) + 0.0 AS pc{n}" for n in range(1, k + 1))
    return f"SELECT vec_id, label, {pc} FROM {centred}"


def mlp_ctes(weights: list[float], hidden: int, classes: int, optimiser: str, rate: float, steps: int) -> str:
    """CTE st (t, w, m, v, loss): full-batch steps of a ReLU network from given weights; loss is that before step t.

    Weights are listed unit by unit: those of each hidden unit, its biases, those of each class, its biases.
    """
    d = V.DIMS
    b1, w2 = d * hidden, d * hidden + hidden
    b2 = w2 + hidden * classes
    start = "[" + ", ".join(map(repr, weights)) + "]::DOUBLE[]"
    zeros = f"list_transform(range(0, {b2 + classes}), lambda q: CAST(0 AS DOUBLE))"
    forward = mlp_forward_sql("st, xs", hidden, classes, "w, ")
    r = f"CAST({rate} AS DOUBLE)"
    one = "CAST({} AS DOUBLE)".format
    new = {
        "sgd": (f"w[i] - {r} * g", "m[i]", "v[i]"),
        "momentum": (f"w[i] + ({one(0.9)} * m[i] - {r} * g)", f"{one(0.9)} * m[i] - {r} * g", "v[i]"),
        "adam": (
            f"w[i] - {r} * (({one(0.9)} * m[i] + {one(0.1)} * g) / (1 - pow({one(0.9)}, t + 1))) / (sqrt(({one(0.999)} * v[i] + {one(0.001)} * g * g) / (1 - pow({one(0.999)}, t + 1))) + {one(1e-8)})",
            f"{one(0.9)} * m[i] + {one(0.1)} * g", f"{one(0.999)} * v[i] + {one(0.001)} * g * g",
        ),
    }[optimiser]
    return f"""xs AS MATERIALIZED ({V.VEC_SQL}),
    st(t, w, m, v, loss) AS (SELECT 0, {start}, {zeros}, {zeros}, CAST(NULL AS DOUBLE) UNION ALL
        SELECT t + 1, list({new[0]} ORDER BY i), list({new[1]} ORDER BY i), list({new[2]} ORDER BY i), any_value(l) FROM st CROSS JOIN (
            SELECT i, avg(q) AS g, avg(l) AS l FROM (SELECT unnest(gr) AS q, generate_subscripts(gr, 1) AS i, -ln(p[label + 1] + 1e-15) AS l FROM (
                SELECT label, p, list_concat(flatten(list_transform(dh, lambda q: list_transform(x, lambda z: z * q))), dh, flatten(list_transform(back, lambda q: list_transform(h, lambda z: z * q))), back) AS gr FROM (
                    SELECT label, p, x, h, back, list_transform(range(0, {hidden}), lambda j: CASE WHEN h[j + 1] > 0 THEN list_dot_product(back, list_transform(range(0, {classes}), lambda k: w[{w2} + k * {hidden} + j + 1])) ELSE 0 END) AS dh FROM (
                        SELECT *, list_transform(range(0, {classes}), lambda k: p[k + 1] - CAST(k = label AS INT)) AS back FROM ({forward}) f0) f1) f2) f3) f4 GROUP BY i) gi
            WHERE t < {steps} GROUP BY t)"""


def mlp_forward_sql(source: str, hidden: int, classes: int, keep: str = "") -> str:
    """(keep, vec_id, label, x, h, p) of rows of xs beside one row with the weights w."""
    d = V.DIMS
    b1, w2 = d * hidden, d * hidden + hidden
    b2 = w2 + hidden * classes
    return f"""SELECT {keep}vec_id, label, x, h, list_transform(e, lambda q: q / list_sum(e)) AS p FROM (SELECT *, list_transform(z, lambda q: exp(q - list_max(z))) AS e FROM (
        SELECT *, list_transform(range(0, {classes}), lambda k: list_dot_product(h, w[{w2} + k * {hidden} + 1 : {w2} + (k + 1) * {hidden}]) + w[{b2} + k + 1]) AS z FROM (
            SELECT *, list_transform(range(0, {hidden}), lambda j: greatest(0, list_dot_product(x, w[j * {d} + 1 : (j + 1) * {d}]) + w[{b1} + j + 1])) AS h FROM {source})))"""
