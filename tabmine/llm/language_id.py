"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm.common import each_batch, hash_cuts, id_and_text, in_sample
from tabmine.llm.hashed import buckets, codes, grams, words
from tabmine.llm.quality_classifier import held_out

#: Families of languages; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
}
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether some character is a letter by its Unicode category; signs such as a half or a raised two are none."""
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, some in families.items() if lang in some), lang)


def features(text: str, bits: int) -> np.ndarray:
    """Bucket numbers of lower-case words and character 1- to 3-grams, with repeats."""
    c = codes(text.lower())
    return np.concatenate([buckets(words(c), bits), *[buckets(grams(c, n), bits) for n in (1, 2, 3)]])


def _vector(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(features(text, bits), return_counts=True)
    v = n / max(1, n.sum())
    return at, v


def svm(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 6, reg: float = 1e-4, seed: int = 5):
    """Linear SVM by averaged stochastic subgradient steps (Pegasos); y is +1 or -1. Returns (weights, bias)."""
    w, total, bias, b_total, scale = np.zeros(size), np.zeros(size), 0.0, 0.0, 30.0
    draw, step, kept = np.random.default_rng(seed), 0, 0
    for epoch in range(epochs):
        for k in draw.permutation(len(y)):
            step += 1
            lr = 1.0 / (1.0 + reg * 100 * step)
            at, v = docs[k]
            if y[k] * (scale * (w[at] @ v) + bias) < 1:
                w[at] += lr * y[k] * scale * v
                bias += 0.01 * lr * y[k]
        w *= 1 - reg
        if epoch >= epochs // 2:
            total, b_total, kept = total + w, b_total + bias, kept + 1
    return (scale * total / max(1, kept)).astype(np.float32), b_total / max(1, kept)


class Model:
    """One SVM per pair of families and per pair of languages in a family; most votes win, then margins."""

    def __init__(self, langs: list[str], bits: int = 15, families: dict[str, tuple[str, ...]] = FAMILIES):
        self.bits, self.tree = bits, {}
        for lang in sorted(langs):
            self.tree.setdefault(family_of(lang, families), []).append(lang)
        self.pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = {}

    def fit(self, texts: list[str], langs: list[str]) -> Model:
        docs = [_vector(t, self.bits) for t in texts]
        fam = {lang: f for f, some in self.tree.items() for lang in some}

        def pair(a: str, b: str, label: list[str]) -> None:
            rows = [k for k, x in enumerate(label) if x in (a, b)]
            y = np.array([1.0 if label[k] == a else -1.0 for k in rows])
            self.pairs[a, b] = svm([docs[k] for k in rows], y, 1 << self.bits)

        for a, b in combinations(sorted(self.tree), 2):
            pair(a, b, [fam[x] for x in langs])
        for some in self.tree.values():
            for a, b in combinations(some, 2):
                pair(a, b, langs)
        return self

    def _choose(self, names: list[str], at: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, margin = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            w, bias = self.pairs[a, b]
            z = float(w[at].mean(dtype=np.float64)) + bias
            votes[a if z >= 0 else b] += 1
            margin[a] += z
            margin[b] -= z
        best = max(names, key=lambda x: (votes[x], margin[x]))  # ties: the first by name
        return best, float(1 / (1 + np.exp(-margin[best] / (len(names) - 1))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.tree or not has_letter(text):
            return "und", 0.0
        at = features(text, self.bits)
        family, sure = self._choose(sorted(self.tree), at)
        lang, surer = self._choose(self.tree[family], at)
        return lang, sure * surer


def train(spark: SparkSession, docs: DataFrame, per_lang: int = 600, most_chars: int = 50_000) -> Model:
    """Learn from a bounded sample: of each language the ``per_lang`` ids of the smallest hashes.

    Ids and languages alone decide which rows are drawn; one scan of the texts then gets those of all
    languages, except texts over ``most_chars`` characters, so that what reaches the driver is bounded by
    the number of languages. Texts without a letter and rows without lang or doc_id teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang is not null and doc_id is not null").filter(~held_out(4, 2))
    cuts = hash_cuts(rows, per_lang, by="lang")
    drawn = rows.filter(in_sample(cuts, by="lang") & (F.length("text") <= most_chars)).distinct()
    found = [r for r in drawn.orderBy("lang", "doc_id", "text").limit(2 * per_lang * max(1, len(cuts))).collect() if has_letter(r.text)]
    return Model(sorted({r.lang for r in found})).fit([r.text for r in found], [r.lang for r in found])


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text alone.

    Texts that are null or have no letter are ``und`` with score 0, as is everything when there is no
    language to learn. Of equal votes the larger summed margin wins, of equal margins the first name. Texts
    of any length are read whole; repeated rows give repeated rows, an empty table none; columns other than
    doc_id, text and lang are ignored, whatever their names.
    """
    shared = spark.sparkContext.broadcast(model or train(spark, docs))
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=out
            )

    done = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
