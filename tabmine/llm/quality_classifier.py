"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm.common import each_batch, hash_cuts, id_and_text, in_sample
from tabmine.llm.hashed import buckets, codes, grams, words

#: Character n-grams beside words.
SIZES = (2, 3, 4)
#: So many features without a vector are counted into each average: a few words alone prove little.
PAD = 30


def features(text: str, bits: int) -> np.ndarray:
    """Bucket numbers, with repeats, of a text's words, word pairs and character n-grams.

    A pair is hashed by the difference of its words, so that a word said twice is the same pair whichever
    word it is.
    """
    c = codes(text)
    w = words(c)
    pairs = w[1:] - w[:-1]
    return np.concatenate([buckets(w, bits), buckets(pairs, bits), *[buckets(grams(c, n), bits) for n in SIZES]])


class Classifier:
    """Embeddings E (buckets x dim) and output layer U (classes x dim): softmax(U mean(E[features])).

    For scoring both are folded into one number per bucket and class, so a text costs one table look-up
    per feature.
    """

    def __init__(self, bits: int = 16, dim: int = 8, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.bits = bits
        self.e = draw.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.u = np.zeros((2, dim), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.folded = np.zeros(1 << bits, dtype=np.float32)
        self.offset = 0.0

    def fit(self, texts: list[str], labels: list[int], epochs: int = 6, rate: float = 1.0, seed: int = 13) -> Classifier:
        """Plain SGD, one document a step, with the rate falling linearly to 0. Classes weigh the same."""
        y = np.array(labels, dtype=np.int64)
        self.bias[1] = 1.0  # with nothing learned, a text is more likely good than not
        if len(y) and y.min() != y.max():
            docs = []
            for text in texts:
                at, n = np.unique(features(text, self.bits), return_counts=True)
                docs.append((at, (n / (n.sum() + PAD)).astype(np.float32)))
            weight = len(y) / (2.0 * np.bincount(y, minlength=2))
            draw, step, steps = np.random.default_rng(seed), 0, epochs * len(y)
            for _ in range(epochs):
                for k in draw.permutation(len(y)):
                    at, share = docs[k]
                    lr = np.float32(rate * (1 - step / steps) * min(5.0, weight[y[k]]))
                    mean = share @ self.e[at]
                    z = self.u @ mean + self.bias
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[y[k]] -= 1
                    back = p @ self.u
                    self.u -= lr * np.outer(p, mean)
                    self.bias -= lr * np.float32(0.1) * p
                    self.e[at] -= (lr * np.float32(20.0)) * share[:, None] * back[None, :]
                    step += 1
        elif len(y):
            self.bias[:] = (3.0, 0.0) if y.max() == 0 else (0.0, 3.0)
        self.folded = self.e @ (self.u[1] - self.u[0])
        self.offset = float(self.bias[1] - self.bias[0])
        return self

    def score(self, text: str) -> float:
        """Probability of class 1."""
        at = features(text, self.bits)
        z = self.offset + float(self.folded[at].sum(dtype=np.float64)) / (len(at) + PAD)
        return float(1 / (1 + np.exp(-z)))


def held_out(of: int, rest: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves ``rest`` when divided by ``of``; null ids never do."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, most_chars: int = 50_000
) -> Classifier:
    """Learn from a bounded sample: of each class the ``per_class`` labelled ids of the smallest hashes.

    Whole texts of those ids are learned from, except the ones over ``most_chars`` characters, so that what
    reaches the driver is bounded too. Labels alone decide which ids are drawn; the texts are then scanned
    once for both classes. Rows whose label is null or no 0 or 1 teach nothing.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    y = y.filter("doc_id is not null and y in (0, 1)").filter(~held_out(5, 0))
    some = y.filter(in_sample(hash_cuts(y, per_class, by="y"), by="y")).distinct()
    texts = id_and_text(docs).filter(F.length("text") <= most_chars)
    rows = texts.join(F.broadcast(some), "doc_id").distinct().orderBy("doc_id", "text", "y").limit(4 * per_class).collect()  # at most 2 per_class ids
    return Classifier().fit([r.text for r in rows], [r.y for r in rows])


def classify(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, model: Classifier | None = None
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    The score is of the whole text alone, however long; null and empty texts get the class offset's score.
    Repeated rows give repeated rows, other columns are ignored, whatever their names, an empty table gives
    no rows, and without labels every text gets the same high score. A score of ``cut`` itself predicts 1.
    """
    model = model or train(spark, docs, labels, label)
    shared = spark.sparkContext.broadcast((model.folded, model.offset, model.bits))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Classifier.__new__(Classifier)
        scorer.folded, scorer.offset, scorer.bits = shared.value
        for batch in each_batch(batches):
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64())], schema=out)

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
