"""Spelling variants without pairs: wildcard groups for replacements, deletions for insertions and deletions.

Two words of one length differ by a replaced code point if they share a wildcard group (position, prefix,
suffix). A group keeps its size and its two most frequent words: a member has size - 1 near words in
it, the best of them the first word or, for the first itself, the second. A word and a longer one differ by
an inserted code point if the shorter is one of the longer's distinct deletions, so deletions join the
vocabulary. Both give each word counts and a best near word, which are combined; no two members of a group
are ever paired. A group has a member per letter at most, a word as many groups and deletions as code points.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmine.llm.common import each_batch, forget, id_and_text, stored

#: Every Latin-1 byte: capitals A-Z as small letters, a to z and À to ÿ as they are, all else as a space.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters of one text, A-Z lower-cased, as UTF-8."""
    return text.encode("latin-1", "replace").translate(_RUNS).decode("latin-1").encode().split()


def count_words(total: Counter, doc_id: int | None, text: str, every: int = 199) -> None:
    """Add one text's words to ``total``; a run whose checksum with the id is a multiple of ``every`` loses a letter."""
    found = runs(text)
    total.update(found)
    prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run in [r for r in set(found) if not zlib.crc32(r, prefix) % every]:
        word, n = run.decode(), found.count(run)
        at = zlib.crc32(run, prefix) % len(word)
        total[run] -= n
        if rest := word[:at] + word[at + 1 :]:
            total[rest.encode()] += n


def word_counts(docs: DataFrame, least_length: int = 6, held: int = 1 << 18) -> DataFrame:
    """(word, n) over all texts, words of ``least_length`` code points or more.

    A task adds its texts up and hands on what it holds at ``held`` words; only counts are shuffled.
    """
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def part() -> Iterator[pa.RecordBatch]:
            words = [(w, n) for k, n in total.items() if n and len(w := k.decode()) >= least_length]
            total.clear()
            for k in range(0, len(words), 1 << 14):
                w, n = zip(*words[k : k + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], schema=out)

        for batch in each_batch(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count_words(total, doc_id, text)
                if len(total) >= held:
                    yield from part()
        yield from part()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(word: str = "word", offset: int = 0) -> Column:
    """The positions of a word, from 1."""
    return F.sequence(F.lit(1), F.length(word) + offset)


def _without(place: Column, mark: str = "") -> Column:
    """The word with ``mark`` in place of one code point."""
    word = F.col("word")
    return F.concat(F.substring(word, F.lit(1), place - 1), F.lit(mark), F.substring(word, place + 1, F.length(word)))


def replaced(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) a row per word and wildcard group with other members."""
    keys = words.select("word", "n", F.explode(F.transform(_places(), lambda p: _without(p, "*"))).alias("key"))
    group = Window.partitionBy("key").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = [F.nth_value(F.struct("n", "word"), k).over(group) for k in (1, 2)]
    keys = keys.select("word", F.count("*").over(group).alias("size"), top[0].alias("first"), top[1].alias("second")).filter("size > 1")
    best = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    return keys.select("word", (F.col("size") - 1).alias("n_near"), best["n"].alias("best_n"), best["word"].alias("best"))


def shifted(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) twice per word and deletion in the vocabulary: for the longer and for the shorter word."""
    cut = words.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(F.transform(_places(), lambda p: _without(p)))).alias("word"))
    both = cut.join(words, "word")
    one = lambda word, n, best: both.select(F.col(word).alias("word"), F.lit(1).cast("long").alias("n_near"), F.col(n).alias("best_n"), F.col(best).alias("best"))
    return one("long", "n", "word").unionByName(one("word", "long_n", "long"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones; form is the most frequent, of equal ones the smallest."""
    rows = replaced(words).unionByName(shifted(words)).withColumn("order", F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    best = F.min("order")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best["word"].alias("form"), (-best["less"]).alias("form_n"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), following forms to the last by pointer doubling.

    Forms are more frequent than their words by a factor, so chains end, after as many links as its logarithm.
    """
    found = stored(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(spark, found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(spark, found)
        found = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return found


def variants(spark: SparkSession, docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_length`` code points and ``least_n`` occurrences.

    ``form`` is the near word of largest n, if that is ``times`` the word's at least, and ``root`` the last
    of its forms (the word itself without one). Null and empty texts have no words; null ids count as empty ones;
    repeated rows count each time; equal n are decided by code-point order; very long texts are read
    whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    words = stored(spark, word_counts(docs, least_length).filter(F.col("n") >= least_n), "vocabulary")
    near = near_words(words)
    rows = words.join(near, "word", "left")
    enough = F.col("form_n") >= F.col("n") * times
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(enough, F.col(c)).alias(c) for c in ("form", "form_n")])
    rows = stored(spark, rows, "forms")
    last = roots(spark, rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
