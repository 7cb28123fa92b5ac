"""DuckDB SQL for the operators that SQL can express."""

from tabmine.llm.quality_rules import LENGTHS, PRIOR, RATES, TIMES

_BUCKET = """CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 7) * 64 + v // CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) END"""
_TOP = """CASE WHEN bucket < 64 THEN bucket ELSE (bucket % 64 + 65) * CAST(pow(2, bucket // 64 - 1) AS BIGINT) - 1 END"""


def _quality(prior: int = PRIOR, times: int = TIMES) -> str:
    rates = ", ".join(
        f"CASE WHEN {b} > 0 THEN CAST(floor(greatest({a} - 1, 0) * 1000000 / {b}) AS BIGINT) ELSE 0 END AS {name}" for name, a, b, _ in RATES
    )
    rows = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS name, {name} AS v FROM r WHERE NOT base_failed" for name in (*[r[0] for r in RATES], *LENGTHS))
    least = "CASE name " + " ".join(f"WHEN '{name}' THEN {n * 1_000_000}" for name, _, _, n in RATES) + " END"
    per = "CASE name " + " ".join(f"WHEN '{name}' THEN '{of}'" for name, _, of, _ in RATES) + " END"

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f""", {name}_m AS (SELECT {by}name, bucket, sum(n) AS n FROM sk GROUP BY ALL),
        {name}_r AS (SELECT *, {_TOP} AS v, sum(n) OVER (PARTITION BY {by}name) AS total,
            sum(n) OVER (PARTITION BY {by}name ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_m),
        {name}_q AS (SELECT {by}name, CAST(max(total) AS BIGINT) AS n, min(CASE WHEN upto * 100 >= total * 10 THEN v END) AS q10,
            min(CASE WHEN upto * 100 >= total * 50 THEN v END) AS q50 FROM {name}_r GROUP BY {by}name),
        {name} AS (SELECT q.*, q50 AS mid, q50 - q10 AS low, (SELECT greatest(max(s.q50), 1) FROM {name}_q s
            WHERE s.name = {per.replace("CASE name", "CASE q.name")} {"".join(f" AND s.{k} = q.{k}" for k in keys.replace(" ", "").split(",") if k)}) AS size
            FROM {name}_q q WHERE q.name LIKE '%_rate')"""

    def drawn(own: str, to: str, on: str) -> str:
        pull = lambda c: f"CAST(floor((o.n * o.{c} + {prior} * p.{c}) / (o.n + {prior})) AS BIGINT)"
        junk = f"o.mid > p.mid + {times} * greatest(p.low, CAST(floor({least.replace('CASE name', 'CASE o.name')} / p.size) AS BIGINT))"
        kept = ", ".join(f"CASE WHEN {junk} THEN p.{c} ELSE {pull(c)} END AS {c}" for c in ("mid", "low"))
        return f"SELECT o.* EXCLUDE (mid, low, size), {kept}, {pull('size')} AS size FROM {own} o JOIN {to} p ON {on}"

    wide = ", ".join(f"max(CASE WHEN name = '{x}' THEN {c} END) AS {c}_{x}" for x, *_ in RATES for c in ("mid", "low", "size"))
    ok = " AND ".join(
        f"coalesce(r.{x} <= t.mid_{x} + {times} * greatest(t.low_{x}, CAST(floor({n * 1_000_000} / least(t.size_{x}, greatest(r.{of}, 1))) AS BIGINT)), true)" for x, _, of, n in RATES
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source FROM documents),
    w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
        FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
    tri AS (SELECT rid, i, word AS a, lead(word) OVER (PARTITION BY rid ORDER BY i) AS b,
        lead(word, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM w),
    again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
    rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    m AS (SELECT d.*, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    b AS (SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (rid)),
    r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM b),
    sk AS (SELECT lang, source, name, {_BUCKET} AS bucket, count(*) AS n FROM ({rows}) GROUP BY ALL)
    {level("fine", "lang, source")}{level("byl", "lang")}{level("al", "")},
    pulled AS ({drawn("byl", "al", "o.name = p.name")}),
    t AS (SELECT lang, source, {wide} FROM ({drawn("fine", "pulled", "o.lang = p.lang AND o.name = p.name")}) GROUP BY lang, source)
    SELECT r.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper,
        base_failed, NOT base_failed AND {ok} AS kept
    FROM r LEFT JOIN t USING (lang, source)"""


def _lm(order: int) -> str:
    """Stupid backoff over words, pairs and, for order 3, triples."""
    back = "ln(CAST(0.4 AS DOUBLE))"
    one = "ln(b.n / total)"
    two = f"CASE WHEN t.w1 IS NULL THEN {one} WHEN two.n IS NOT NULL THEN ln(two.n / a.n) ELSE {back} + {one} END"
    three = f"CASE WHEN t.w0 IS NOT NULL AND three.n IS NOT NULL THEN ln(three.n / before.n) WHEN t.w0 IS NOT NULL THEN {back} + {two} ELSE {two} END"
    tables = ", three AS (SELECT w0, w1, w2, count(*) AS n FROM t WHERE w0 IS NOT NULL GROUP BY ALL)" if order == 3 else ""
    joins = "LEFT JOIN three ON three.w0 = t.w0 AND three.w1 = t.w1 AND three.w2 = t.w2 LEFT JOIN two before ON before.w1 = t.w0 AND before.w2 = t.w1" if order == 3 else ""
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, row_number() OVER () AS rid FROM documents),
    w AS (SELECT doc_id, rid, unnest(ws) AS w2, generate_subscripts(ws, 1) AS i FROM d),
    t AS (SELECT *, lag(w2) OVER (PARTITION BY rid ORDER BY i) AS w1, lag(w2, 2) OVER (PARTITION BY rid ORDER BY i) AS w0 FROM w),
    one AS (SELECT w2 AS w, count(*) AS n FROM t GROUP BY w2),
    two AS (SELECT w1, w2, count(*) AS n FROM t WHERE w1 IS NOT NULL GROUP BY ALL){tables},
    s AS (SELECT t.doc_id, {three if order == 3 else two} AS ls
        FROM t JOIN one b ON b.w = t.w2 LEFT JOIN one a ON a.w = t.w1 LEFT JOIN two ON two.w1 = t.w1 AND two.w2 = t.w2 {joins}
        CROSS JOIN (SELECT CAST(sum(n) AS DOUBLE) AS total FROM one)),
    g AS (SELECT doc_id, count(*) AS n_words, sum(ls) AS ls FROM s GROUP BY doc_id)
    SELECT ids.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(ls, 0), 4) AS log_score, round(ls / n_words, 6) AS mean_log_score
    FROM (SELECT DISTINCT doc_id FROM documents) ids LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM ids.doc_id"""


def _weight(name: str, weights: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.get(name, {}).items())
    return f"CAST(CASE {name} {cases} ELSE 1 END AS DOUBLE)" if cases else "CAST(1 AS DOUBLE)"


def _mix(weights: dict, share: float = 0.5, epochs: int = 2, seed: int = 17) -> str:
    def fill(out: str, rows: str, parent: str, name: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        keys = f"{parent}, {name}" if parent else name
        return f""", {out}_o AS (SELECT *,
            coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            sum(w) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
            FROM ({rows}) WHERE w > 0 AND cap > 0),
        {out}_f AS (SELECT *, CAST(cap AS DOUBLE) * w_left <= w * CAST(budget - before AS DOUBLE) AS is_full FROM {out}_o),
        {out}_s AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0) AS cap_full,
            sum(CASE WHEN NOT is_full THEN w END) OVER ({by}) AS w_rest FROM {out}_f),
        {out} AS (SELECT {keys}, have, CASE WHEN is_full THEN cap
            ELSE least(CAST(floor(w * CAST(budget - cap_full AS DOUBLE) / w_rest) AS BIGINT), cap) END AS budget FROM {out}_s)"""

    node = "CAST(sum(cap) AS BIGINT) AS cap, CAST(sum(have) AS BIGINT) AS have"
    return f"""
    WITH r AS (SELECT * FROM (SELECT doc_id,
        'domain' || coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4 AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
        coalesce(CAST(doc_id AS VARCHAR), md5(text)) AS name FROM documents) WHERE n_tokens > 0),
    leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS have, CAST(sum(n_tokens) AS BIGINT) * {epochs} AS cap FROM r GROUP BY ALL),
    top AS (SELECT CAST(floor(CAST(sum(have) AS DOUBLE) * CAST({share} AS DOUBLE)) AS BIGINT) AS budget FROM leaf)
    {fill("l1", f"SELECT domain, {node}, {_weight('domain', weights)} AS w, any_value(budget) AS budget FROM leaf, top GROUP BY domain", "", "domain")}
    {fill("l2", f"SELECT domain, lang, {node}, {_weight('lang', weights)} AS w, any_value(l1.budget) AS budget FROM (SELECT domain, lang, have, cap FROM leaf) JOIN (SELECT domain, budget FROM l1) l1 USING (domain) GROUP BY domain, lang", "domain", "lang")}
    {fill("l3", f"SELECT domain, lang, source, have, cap, {_weight('source', weights)} AS w, l2.budget FROM leaf JOIN (SELECT domain, lang, budget FROM l2) l2 USING (domain, lang)", "domain, lang", "source")},
    g AS (SELECT domain, lang, source, CAST(floor(budget / have) AS INT) AS whole, budget % have AS rest FROM l3),
    k AS (SELECT r.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY substr(md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15), doc_id, n_tokens
        ROWS UNBOUNDED PRECEDING) AS upto FROM r JOIN g USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CAST(upto <= rest AS INT) AS INT) AS epochs
    FROM k WHERE whole + CAST(upto <= rest AS INT) > 0"""


#: Target weights of op6_mix_sources; names that aren't listed weigh 1.
MIX_WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}

_AUDIT = """
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    m AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
        'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS fails FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM f a, f b, f c, f e, f g
        WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
    s AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    c AS (SELECT part, struct_extract(fails, 'A') AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    z AS (SELECT part, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failed FROM c),
    y AS (SELECT part, filter_order, step, filter, n, good, toxic, list_contains(failed, filter) AS fail, len(failed) AS n_failed,
        len(list_filter(failed, lambda x: contains(earlier, x))) > 0 AS gone FROM z, s),
    r AS (SELECT part, filter_order, step, filter, CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN fail AND n_failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM y GROUP BY part, filter_order, step, filter)
    SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""

_JOIN = """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS hs FROM d),
    t AS (SELECT list_sort(hs) AS hs, row_number() OVER () AS id FROM (SELECT DISTINCT list_sort(hs) AS hs FROM s WHERE len(hs) > 0)),
    g AS (SELECT id, len(hs) AS n, unnest(hs) AS h FROM t),
    p AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    reach AS (SELECT id AS node, id AS other FROM t UNION SELECT node, e.b FROM reach JOIN e ON e.a = reach.other),
    m AS (SELECT s.doc_id, len(s.hs) AS n, t.id FROM s LEFT JOIN t ON t.hs = list_sort(s.hs)),
    c AS (SELECT node, min(doc_id) AS component_id FROM reach JOIN m ON m.id = reach.other GROUP BY node)
    SELECT m.doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN m.doc_id ELSE component_id END AS component_id
    FROM m LEFT JOIN c ON c.node = m.id"""

#: CRC-32 byte by byte, its table made from the polynomial.
_SPELLING = """
    WITH RECURSIVE step AS (SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
    r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
    b AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x), 2), lambda i: CAST(('0x' || x[i + 1:i + 2]) AS BIGINT))),
        lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM b, step),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
    k AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS key FROM p),
    c AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS cut FROM p),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word
        UNION ALL SELECT c.word, w.word, w.n FROM c JOIN w ON c.cut = w.word
        UNION ALL SELECT w.word, c.word, c.n FROM c JOIN w ON c.cut = w.word),
    g AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'word': other}) AS best FROM near GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.word END AS form,
        CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN g USING (word)),
    path AS (SELECT word, word AS root FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, path.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
    FROM f JOIN path ON path.word = f.word JOIN f last ON last.word = path.root AND last.form IS NULL"""

ORACLE_SQL = {
    "op2_quality_rules": _quality(),
    "op4_lm_scoring": _lm(2),
    "op4_lm_scoring_all_pairs": _lm(2),
    "op4_lm_scoring_trigrams": _lm(3),
    "op6_mix_sources": _mix(MIX_WEIGHTS),
    "op11_filter_audit": _AUDIT,
    "op12_shingle_join": _JOIN,
    "op13_spelling_variants": _SPELLING,
}
