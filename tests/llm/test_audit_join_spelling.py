"""The filter audit, the shingle join and spelling variants against brute force and SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tabmine.llm import filter_audit, queries, shingle_join, spelling
from tabmine.llm.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    key = lambda row: [(v is None, str(v)) for v in row]
    rows = [sorted((tuple(r) for r in x), key=key) for x in (out.select(*columns).collect(), want.select(*[f'"{c}"' for c in columns]).fetchall())]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows, strict=True):
        assert a == pytest.approx(b) if not any(isinstance(v, str) for v in a) else a == b


# filter audit


def _audit(docs, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    fails = []
    for d, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)}
        f |= {"D": any(c in "#$%&*|" for c in text), "E": d is not None and text in first and d > first[text]}
        fails.append((d, source or "", {k for k, v in f.items() if v}))
    out = {}
    for part in {p for _, p, _ in fails}:
        own = [(d, f) for d, p, f in fails if p == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                left = [(d, f) for d, f in own if not f & set(order[:k])]
                gone = [d for d, f in left if x in f]
                row = [len(left) - len(gone), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own)]
                out[part, order, k + 1] = [*row, sum(d in good for d in gone), sum(d in toxic for d in gone)]
                total[x] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                out[part, order, k + 1].append(total[x])
    return out


def test_filter_audit(spark):
    draw = random.Random(3)
    prose = lambda n, most: " ".join(f"w{draw.randrange(most)}" for _ in range(n))
    texts = [None, "", " \n", "ONE two", "a # b", prose(60, 10**6), prose(60, 5), prose(80, 10**6) + " | " + "X" * 40, "\x85".join("ab" * 60)]
    docs = [(draw.choice([None, 5, *range(40)]), draw.choice(texts), draw.choice([None, "", "s1", "s2"])) for _ in range(150)]
    labels = [(k, draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for k in (*range(0, 40, 2), 4, 4, None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, source string, mask string, digest string")
    got = filter_audit.audit(spark, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = _audit(docs, labels)
    assert len(got) == len(want) and {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == want
    assert all(r.filter == r.filter_order[r.step - 1] for r in got)


# shingle join


def _set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def _linked(a, b, percent=85):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def _joined(docs):
    sets = [_set(t) for _, t in docs]
    label = list(range(len(docs)))
    near = [[j for j in range(len(docs)) if j != i and _linked(sets[i], sets[j])] for i in range(len(docs))]
    moved = True
    while moved:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(docs))]
        moved, label = new != label, new
    least = defaultdict(list)
    for (d, _), g in zip(docs, label, strict=True):
        if d is not None:
            least[g].append(d)
    return sorted(((d, len(s), min(least[g], default=None)) for (d, _), s, g in zip(docs, sets, label, strict=True)), key=str)


def _edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        words[at : at + 1] = draw.choice([[], [f"n{draw.randrange(10**6)}"], [words[at], f"n{draw.randrange(10**6)}"]])
    return words


def _copies(seed):
    """Groups of near copies and chains about the limit, passages that many texts share, short texts, copies."""
    draw = random.Random(seed)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (3, 4, 8, 9, 10, 12, 30, 80, 200, 900):
        words = new(n)
        for _ in range(8):
            texts.append(" ".join(words))
            words = _edited(draw, words, draw.choice([0, 1, max(1, n // 60), max(1, n // 45), max(1, n // 30)]))
    shared = new(120)
    texts += [" ".join(shared + new(draw.choice([10, 20, 40, 120]))) for _ in range(25)]
    texts += ["Same TEXT of a few words é", "same text of a few WORDS é", "same text of a few words É", None, "", " ", "one", "One", "\ttwo words "]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "no other has this text"), (3, texts[3]), (1000, texts[15]), (1001, texts[15])]
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_shingle_join(spark, seed):
    docs = _copies(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, node string, key int").repartition(5)
    got = sorted((tuple(r) for r in shingle_join.near_duplicates(spark, frame).collect()), key=str)
    assert got == _joined(docs)
    assert shingle_join.near_duplicates(spark, frame).columns == ["doc_id", "n_shingles", "component_id"]


def test_linked_sets_share_a_key_and_sketches_bound():
    draw = np.random.default_rng(4)
    bands, checked = shingle_join.Bands(85), 0
    for _ in range(1500):
        n = int(draw.choice([6, 7, 8, 10, 13, 20, 40, 90, 250, 700]))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        d = int(draw.integers(0, bands.differences(2 * n) + 3))
        gone = min(int(draw.integers(0, d + 1)), n - 1)
        b = np.unique(np.concatenate([a[draw.permutation(len(a))[gone:]], draw.integers(0, 1 << 63, d - gone, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        both = len(np.intersect1d(a, b))
        x, y = shingle_join.sketch(a), shingle_join.sketch(b)
        words = min(len(x), len(y))
        assert np.bitwise_count(shingle_join.folded(x[None], words) ^ shingle_join.folded(y[None], words)).sum() <= len(a) + len(b) - 2 * both
        if both < max(len(a), len(b)) and 100 * both >= 85 * (len(a) + len(b) - both):
            checked += 1
            assert set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())
    assert checked > 500


def test_meetings_over_batches(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(12) if draw.random() < 0.8 else draw.randrange(10**6), draw.randrange(15)) for _ in range(400)] + [(77, 1)] * 30
    groups = defaultdict(set)
    for key, node in rows:
        groups[key].add(node)
    want = sorted((k, n, min(g)) for k, g in groups.items() if len(g) > 1 for n in g)
    frame = spark.createDataFrame(rows, "key long, node long")
    for size in (1, 2, 3, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(tuple(r) for r in shingle_join.meetings(frame).collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _reach(pairs, n):
    """The groups of sets 0 to n - 1, two and two joined beforehand, that pairs connect."""
    group = [k // 2 for k in range(n)]
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize("most_bytes", [1, 200, 1 << 25])
def test_crossing_in_tiles(spark, most_bytes):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(300) < keep], draw.integers(0, 1 << 63, int(n), dtype=np.uint64)])) for keep in (0.75, 0.9, 1.0) for n in (0, 8, 30, 200)]
    rows = [(k % 2, n, n // 2, len(s), bytearray(shingle_join.sketch(s).tobytes())) for n, s in enumerate(sets) for k in (0, 1, 2)]
    frame = spark.createDataFrame(rows, "key long, node long, root long, n long, sketch binary")
    got = [(r.a, r.b) for r in shingle_join.crossing(spark, frame, most_bytes=most_bytes).collect()]
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if i // 2 != j // 2 and _linked(set(sets[i].tolist()), set(sets[j].tolist()))}
    far = {(i, j) for j in range(len(sets)) for i in range(j) if i // 2 == j // 2 or len(np.intersect1d(sets[i], sets[j])) < 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert len(got) == len(set(got)) and linked <= set(got) and not far & set(got) and linked
    rows = shingle_join.crossing(spark, frame, forest=True, most_bytes=most_bytes).collect()
    some = [(r.a, r.b) for r in rows if r.key is None]
    assert len(some) == len(got) or any(r.key is not None for r in rows)  # where pairs were left out
    assert set(some) <= set(got) and (most_bytes < 1 << 25 or len(some) < len(got))
    assert _reach(got, len(sets)) == _reach(some, len(sets))


def test_chains_about_the_limit(spark):
    """Versions of one text, some linked with each other and not with the others."""
    draw, parts = random.Random(12), []
    for _ in range(30):
        words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        far = _edited(draw, words, 2)
        parts += [words, far, _edited(draw, far, 1), _edited(draw, words, 1), _edited(draw, words, 3)]
    docs = [(k, " ".join(w)) for k, w in enumerate(parts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in shingle_join.near_duplicates(spark, frame).collect()), key=str)
    assert got == _joined(docs) and 60 < len({r[2] for r in got}) < 150


# spelling variants


def _variants(docs):
    count = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, around = {}, {}
    for w in n:
        around[w] = [x for x in n if near(w, x)]
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(out)


def test_spelling_variants(spark):
    draw = random.Random(9)
    stems = ["".join(draw.choice("abé") for _ in range(draw.choice([5, 6, 7]))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaab"]
    words = []
    for k, s in enumerate(stems):
        for _ in range(4):
            at = draw.randrange(len(s))
            words += [draw.choice([s, s, s[:at] + s[at + 1 :], s[:at] + draw.choice("abcÉ") + s[at:], s[:at] + "z" + s[at + 1 :]])] * draw.choice([1, 5, 6, 30, 30 * 5 ** (k % 3)])
    draw.shuffle(words)
    docs = [(draw.choice([None, *range(90)]), draw.choice([" ", "\n", "7", "œ", "\U0001f600"]).join(w.upper() if draw.random() < 0.1 else w for w in words[k : k + 50])) for k in range(0, len(words), 50)]
    docs += [(90 + k, w) for w, n in (("vwxyzvw", 300), ("vwxyzv", 40), ("vwxyav", 6)) for k in range(n)]
    docs += [(1, None), (2, ""), (None, "no id here"), (3, "wxyzwxyz " * 40_000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    out = spelling.variants(spark, frame)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(tuple(r) for r in out.collect())
    want = _variants(docs)
    assert got == want and any(f and r != f for _, f, r, *_ in want) and max(r[4] for r in want) > 3


def test_runs_and_partial_counts(spark):
    assert spelling.runs("Éa-B×÷ œuf STRAẞE ÿ0\ud800x") == [x.encode() for x in ("Éa", "b×÷", "uf", "stra", "e", "ÿ", "x")]
    frame = spark.createDataFrame([(k, f"commonword only{'abcdefghij'[k % 10]}word") for k in range(300)], "doc_id long, text string")
    for held in (1, 50):
        got = {r.word: r.n for r in spelling.word_counts(frame, held=held).collect()}
        assert got == {r.word: r.n for r in spelling.word_counts(frame).collect()} and sum(got.values()) == 600


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(spark, forms).collect()} == {f"w{k}": "w40" for k in range(40)}


def test_unlike_sets_share_no_keys():
    """Words of a few shingles tell unlike sets apart, however many there are; linked sets still meet."""
    draw = np.random.default_rng(4)
    bands, keys = shingle_join.Bands(85), []
    for n in (30, 31, 32) * 1_000:
        hashes = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        keys.append(np.unique(bands.keys(hashes)))
        near = np.unique(np.append(hashes[2:], draw.integers(0, 1 << 63, 2).astype(np.uint64)))
        assert 100 * (n - 2) >= 85 * (n + 2) and len(np.intersect1d(keys[-1], bands.keys(near)))
    every = np.concatenate(keys)
    assert len(np.unique(every)) == len(every)
