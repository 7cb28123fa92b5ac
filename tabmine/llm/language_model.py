"""Stupid-backoff scores as joins: count tables partitioned by n-gram hash, joined to exploded n-grams.

With c the corpus counts over all documents and N all words, the score of a word after its context is

    S(w | context) = c(context w) / c(context)   if c(context w) >= min_count, else   alpha * S(w | shorter context)

with c(w) / N without context. The logarithm of a document's score is a sum over its words of
ln(c(w) / N) and a ln(alpha) for each order not found, plus a sum over its n-grams found in a table of what they add to
that: ln(c(n-gram) / c(context)) minus the same of the n-gram without its first word, which is found too, and
minus ln(alpha). So each order is a stream of (document, hash) rows joined to a table hash -> value, and n-grams
without an entry need no row in it. The orders run one after the other, and those above 1 in parts by hash,
so that only one stream's shuffle files exist at a time.

Counting combines on the map side. N-grams with more than a ``hot`` share of all (at most 1 / hot of an
order, a proven bound) are broadcast and summed before the shuffle; the rest is an ordinary join on the
hash, into as many partitions as the table's size asks for.

With min_count 1 every n-gram is found, since the counts are of these documents, and nothing is backed off. Then
logarithms of counts are all that is added up: plus one for each n-gram of the highest order, minus one
for its context. The hashes and ids themselves are shuffled once, in arrays by range of the hash, and counted
where they arrive; no table of n-grams is made, and those that occur once add ln 1 = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm import hashed
from tabmine.llm.common import each_batch, forget, id_and_text, stored

#: Stands for a null id; ids must be larger.
NO_ID = -(1 << 61) + 1
#: Fixed point of the sums of frequent n-grams.
SCALE = 1 << 32

_signed = lambda h: pa.array(h.view(np.int64))


def _neighbours(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word and the next one of the same text, and the text's number."""
    same = row[1:] == row[:-1]
    return h[:-1][same], h[1:][same], row[1:][same]


def _ends(h: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first and of the last order - 1 words of each n-gram, and the number of its text."""
    for _ in range(order - 2):
        a, b, row = _neighbours(h, row)
        h = hashed.pairs(a, b)
    return _neighbours(h, row)


def _place(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``h`` is in the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _counted(docs: DataFrame, order: int, words: int = 4_000_000, among: Broadcast | None = None) -> DataFrame:
    """n-grams by the hashes h1 and h2 of their ends (the word's h1 if order is 1) with n, added up over about ``words`` words of a task.

    With ``among`` (a sorted array) only those both of whose ends are in it.
    """
    names = ["h1", "h2", "n"] if order > 1 else ["h1", "n"]

    def added(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        if order == 1:
            h, n = np.unique(np.concatenate([h for h, in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], names=names)
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        place = np.lexsort((b, a))
        a, b = a[place], b[place]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        n = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays([_signed(a[first]), _signed(b[first]), pa.array(n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in each_batch(batches):
            for h, row in hashed.words_of(batch.column(1).to_pylist()):
                ends = (h,) if order == 1 else _ends(h, row, order)[:2]
                if among is not None:
                    both = _place(among.value, ends[0])[1] & _place(among.value, ends[1])[1]
                    ends = tuple(e[both] for e in ends)
                held.append(ends)
                size += len(ends[0])
                if size >= words:
                    yield added(held)
                    held, size = [], 0
        if size:
            yield added(held)

    parts = id_and_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return parts.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def tables(spark: SparkSession, docs: DataFrame, alpha: float = 0.4, min_count: int = 1, order: int = 2) -> tuple[list[DataFrame], int]:
    """The tables (g, n, value) of each order from 1, keyed by n-gram hash, and N. ``n`` is the count."""
    single = stored(spark, _counted(docs, 1).withColumnRenamed("h1", "g"), "unigrams")
    total = single.agg(F.sum("n")).first()[0] or 0
    single = single.withColumn("ratio", F.log(F.col("n") / F.lit(float(max(1, total)))))
    found = [single.withColumn("value", F.col("ratio") + (order - 1) * float(np.log(alpha)))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([_signed(hashed.pairs(a, b)), *batch.columns[2:]], names=["g", "n", "value", "ratio"])

    for k in range(2, order + 1):
        counted = stored(spark, _counted(docs, k).filter(F.col("n") >= min_count), "counts")
        first = found[-1].select(F.col("g").alias("h1"), F.col("n").alias("n1"))
        last = found[-1].select(F.col("g").alias("h2"), F.col("ratio").alias("r2"))
        ratio = F.log(F.col("n") / F.col("n1"))
        table = counted.join(first, "h1").join(last, "h2").select("h1", "h2", "n", (ratio - F.col("r2") - float(np.log(alpha))).alias("value"), ratio.alias("ratio"))
        table = table.mapInArrow(keyed, "g long, n long, value double, ratio double")
        if k == order:
            table = table.drop("ratio")
        found.append(stored(spark, table.repartition("g"), "values"))
        forget(spark, counted)
    return [table.select("g", "n", "value") for table in found], total


def _sums(spark: SparkSession, docs: DataFrame, order: int, table: DataFrame, least: int, part: int = 0, parts: int = 1, highest: int = 2) -> DataFrame:
    """(doc_id, s, n_words, n_short): the sum of the values of each document's n-grams of one order.

    Of ``parts`` (a power of two) only those n-grams count whose hash is in ``part``.

    A task adds up the frequent n-grams of a text by itself and hands on the others, which meet their
    values in a join on the hash. Rows are two numbers, to keep what is shuffled small: x is four times the
    id, plus what the other number is: 0 a hash, 1 such a sum in fixed point, 2 the words of one row (sent
    with order 1, so that no scan of the texts is needed for them; n_short is how many orders up to ``highest``
    its first words have no context for).
    """
    table = table.filter(F.col("g").bitwiseAND(F.lit(parts - 1)) == part)
    often = table.filter(F.col("n") > least).select("g", "value").toPandas()  # at most 1 / hot rows of 16 bytes
    often = often.sort_values("g")
    shared = spark.sparkContext.broadcast((often["g"].to_numpy(np.int64), often["value"].to_numpy(np.float64)))
    out = pa.schema([("x", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in each_batch(batches, 128):
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            if len(ids) and (ids.max() >= -NO_ID or ids.min() < NO_ID):
                raise ValueError("doc_ids must lie within 61 bits")
            size, known = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
            for h, row in hashed.words_of(batch.column(1).to_pylist()):
                size += np.bincount(row, minlength=len(ids))
                if order == 1:
                    g = h.view(np.int64)
                else:
                    a, b, row = _ends(h, row, order)
                    g = hashed.pairs(a, b).view(np.int64)
                if parts > 1:
                    own = (g & (parts - 1)) == part
                    g, row = g[own], row[own]
                at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
                hit = keys[at] == g if len(keys) else np.zeros(len(g), dtype=bool)
                known += np.bincount(row[hit], values[at[hit]], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[~hit]] * 4), pa.array(g[~hit])], schema=out)
            known = np.rint(known * SCALE).astype(np.int64)
            some = np.flatnonzero(known)
            x, g = ids[some] * 4 + 1, known[some]
            if order == 1:
                x, g = np.append(x, ids * 4 + 2), np.append(g, size)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(g)], schema=out)

    others = table.filter(F.col("n") <= least).select("g", "value")
    grams = id_and_text(docs).mapInArrow(run, "x long, g long")
    need = others.count() // 1_000_000 + 1  # rows a partition's hash table may have; no key is frequent
    if need > int(spark.conf.get("spark.sql.shuffle.partitions")):
        others, grams = others.repartition(need, "g"), grams.repartition(need, "g")
    grams = grams.join(others.hint("shuffle_hash"), "g", "left")
    kind, zero = F.col("x").bitwiseAND(F.lit(3)), F.lit(0.0)
    value = F.when(kind == 0, F.coalesce("value", zero)).when(kind == 1, F.col("g") / float(SCALE)).otherwise(zero)
    begun = F.least(F.col("g"), F.lit(highest - 1))
    short = begun * highest - F.floor(begun * (begun + 1) / 2)
    sums = grams.groupBy(F.shiftright("x", 2).alias("id")).agg(
        F.sum(value).alias("s"), F.coalesce(F.sum(F.when(kind == 2, F.col("g"))), F.lit(0)).alias("n_words"), F.coalesce(F.sum(F.when(kind == 2, short)), F.lit(0)).alias("n_short")
    )
    return stored(spark, sums.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "s", "n_words", "n_short"), "sums")


def frequent(spark: SparkSession, docs: DataFrame, order: int, hot: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Hashes (sorted) and counts of the n-grams of each order from 1 that are more than ``hot`` of all words, and N.

    The ends of a frequent n-gram are frequent, so only n-grams of frequent ends are counted.
    """
    single = stored(spark, _counted(docs, 1).withColumnRenamed("h1", "g"), "unigrams")
    total = single.agg(F.sum("n")).first()[0] or 0
    least, found = max(1, int(total * hot)), []
    for k in range(1, order + 1):
        if k == 1:
            often = single.filter(F.col("n") > least).toPandas()  # at most 1 / hot rows of 16 bytes
            g, n = often["g"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
        elif len(found[-1][0]):
            ends = spark.sparkContext.broadcast(found[-1][0])
            often = _counted(docs, k, among=ends).filter(F.col("n") > least).toPandas()
            a, b = (often[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
            g, n = hashed.pairs(a, b), often["n"].to_numpy(np.int64)
        else:
            g, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        place = np.argsort(g)
        found.append((g[place], n[place]))
    forget(spark, single)
    return found, total


def _weights(row: np.ndarray, order: int, highest: int) -> np.ndarray:
    """How often the logarithm of the count of each n-gram (of text ``row``) counts, if nothing is backed off.

    Those of the ``highest`` order count once. The next are contexts, minus one, but for a text's last; and a text's
    first one of any lower order is what the score of its last word starts from.
    """
    if order == highest:
        return np.ones(len(row), dtype=np.int64)
    new = row[1:] != row[:-1]
    first, last = np.append(True, new)[: len(row)], np.append(new, True)[: len(row)]
    return (first & last).astype(np.int64) - ((order == highest - 1) & ~first & ~last)


_PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), ("least", pa.int64()), ("ids", pa.binary()), ("values", pa.binary())])


def _packed(bucket: int, kind: int, ids: np.ndarray, values: np.ndarray) -> tuple:
    """A row of ``_PACKED``: ids as what they exceed the least by, in four bytes if they fit."""
    least = int(ids.min())
    ids = ids - least
    return bucket, kind, least, ids.astype("<u4" if ids.max() < 1 << 32 else "<i8").tobytes(), values.tobytes()


def _unpacked(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and values of each kind; those of kind 2 are sums, the others whole numbers."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for _, kind, least, ids, values in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        values = np.frombuffer(values, dtype="<f8" if kind == 2 else "<i8")
        ids = np.frombuffer(ids, dtype="<u4" if len(ids) == 4 * len(values) else "<i8").astype(np.int64) + least
        found.setdefault(kind, []).append((ids, values))
    return {kind: tuple(np.concatenate(c) for c in zip(*held, strict=True)) for kind, held in found.items()}


def _added(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the sums of their values."""
    place = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(ids[place]) != 0))[: len(ids)]
    return ids[place][starts], np.add.reduceat(values[place], starts) if len(ids) else values


def _by_range(h: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` ranges each hash is in."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bucket_sums(rows: pa.Table, shards: int) -> pa.Table:
    """What the n-grams of a bucket add to each document, packed by ranges of a hash of the id: kind 2 sums, 3 words, 4 rows with words."""
    held = _unpacked(rows)
    grams = [(np.full(len(held[w][0]), w), *held[w]) for w in (-1, 0, 1) if w in held]
    if grams:
        weight, ids, g = (np.concatenate(c) for c in zip(*grams, strict=True))
        place = np.argsort(g)
        starts = np.flatnonzero(np.append(True, np.diff(g[place]) != 0))
        runs = np.diff(np.append(starts, len(g)))
        n = np.empty(len(g), dtype=np.int64)
        n[place] = np.repeat(runs, runs)
        some = np.flatnonzero((n > 1) & (weight != 0))
        logs = ids[some], weight[some] * np.log(n[some])
        held[2] = tuple(np.concatenate(c) for c in zip(held.get(2, logs), logs, strict=True)) if 2 in held else logs
    if 3 in held:
        held[4] = held[3][0], np.minimum(held[3][1], 1)
    found = []
    for kind in (2, 3, 4):
        if kind not in held or not len(held[kind][0]):
            continue
        ids, values = _added(*held[kind])
        shard = _by_range(hashed.pairs(ids.view(np.uint64), ids.view(np.uint64)), shards)
        place = np.argsort(shard, kind="stable")
        for own in np.split(place, np.flatnonzero(np.diff(shard[place])) + 1):
            found.append(_packed(int(shard[own[0]]), kind, ids[own], values[own]))
    columns = list(zip(*found, strict=True)) or [()] * len(_PACKED)
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _PACKED.types, strict=True)], schema=_PACKED)


def _document_sums(rows: pa.Table) -> pa.Table:
    """(id, s, n_words, n_begun) of the documents of a range of ids' hashes."""
    held = {kind: _added(*found) for kind, found in _unpacked(rows).items()}
    own = np.unique(np.concatenate([ids for ids, _ in held.values()]))
    columns = [own]
    for kind in (2, 3, 4):
        column = np.zeros(len(own), dtype=np.float64 if kind == 2 else np.int64)
        if kind in held:
            column[np.searchsorted(own, held[kind][0])] = held[kind][1]
        columns.append(column)
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["id", "s", "n_words", "n_begun"])


def _logs(
    spark: SparkSession, docs: DataFrame, order: int, often: Broadcast, total: int, part: int, parts: int,
    bucket_rows: int = 1_000_000, chunk: int = 2_000_000,
) -> DataFrame:
    """(doc_id, s, n_words, n_begun): the sum of the weighted logarithms of the counts of each document's n-grams.

    Of ``parts`` (a power of two) only those n-grams count whose hash is in ``part``. n_words and n_begun (how
    many rows have words) come with part 0.

    A task adds up what is in ``often`` by itself and hands on the others, ``chunk`` at a time, as arrays of ids and
    hashes by range of the hash and by weight: a bucket, about ``bucket_rows`` n-grams, is counted in one piece. No n-gram is
    frequent, so buckets are even. Kind 2 has such sums, kind 3 the words of a row. A bucket's sums go on in arrays too,
    by range of a hash of the id; there are at most as many of them as n-grams that aren't alone.
    """
    rows = sum(total - int(n.sum()) for _, n in often.value) // parts  # or less
    buckets = rows // bucket_rows + 1
    shards = buckets // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = [(keys, np.log(n)) for keys, n in often.value]
        held, extra, size = [], [], 0

        def packed() -> pa.RecordBatch:
            found = []
            if held:
                g, ids, weight = (np.concatenate(c) for c in zip(*held, strict=True))
                group = _by_range(g, buckets) * 3 + weight
                place = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(group[place]) != 0))[: len(g)]
                for own in np.split(place, starts[1:]):
                    if len(own):
                        weight_of = int(weight[own[0]])
                        found.append(_packed((int(group[own[0]]) - weight_of) // 3, weight_of, ids[own], g[own].view(np.int64)))
            for kind, ids, values in extra:
                found.append(_packed(int(ids[0]) % buckets, kind, ids, values))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

        for batch in each_batch(batches, 128):
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            if len(ids) and (ids.max() >= -NO_ID or ids.min() < NO_ID):
                raise ValueError("doc_ids must lie within 61 bits")
            n_words, known = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
            for h, row in hashed.words_of(batch.column(1).to_pylist()):
                n_words += np.bincount(row, minlength=len(ids))
                g, at = h, row
                for k in range(1, order + 1):
                    if k > 1:
                        a, b, at = _neighbours(g, at)
                        g = hashed.pairs(a, b)
                    weight = _weights(at, k, order)
                    own = (g & np.uint64(parts - 1)) == np.uint64(part)
                    some, text, weight = g[own], at[own], weight[own]
                    keys, values = logs[k - 1]
                    place, hit = _place(keys, some)
                    known += np.bincount(text[hit], values[place[hit]] * weight[hit], len(ids))
                    rest = ~hit
                    held.append((some[rest], ids[text[rest]], weight[rest]))
                    size += len(held[-1][0])
                if size >= chunk:
                    yield packed()
                    held, extra, size = [], [], 0
            if len(ids):
                extra.append((2, ids, known))
                if not part:
                    extra.append((3, ids, n_words))
        if held or extra:
            yield packed()

    kinds, least = "bucket long, kind long, least long, ids binary, values binary", int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrays = id_and_text(docs).mapInArrow(run, kinds).repartition(max(buckets, least), "bucket")
    sums = arrays.groupBy("bucket").applyInArrow(lambda rows: _bucket_sums(rows, shards), kinds).repartition(max(shards, least), "bucket")
    sums = sums.groupBy("bucket").applyInArrow(_document_sums, "id long, s double, n_words long, n_begun long")
    return stored(spark, sums.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "s", "n_words", "n_begun"), "sums")


def _every_found(spark: SparkSession, docs: DataFrame, order: int, hot: float, parts: int, *sizes: int) -> DataFrame:
    """(doc_id, n_words, s) by counts of which none is left out."""
    found, total = frequent(spark, docs, order, hot)
    often = spark.sparkContext.broadcast(found)
    sums = _logs(spark, docs, order, often, total, 0, parts, *sizes)
    for part in range(1, parts):
        sums = sums.unionByName(_logs(spark, docs, order, often, total, part, parts, *sizes))
    begun = float(np.log(max(1, total))) * F.sum("n_begun")
    return sums.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), (F.sum("s") - begun).alias("s"))


def score(
    spark: SparkSession, docs: DataFrame, alpha: float = 0.4, min_count: int = 1, hot: float = 1e-4, parts: int = 2, order: int = 2
) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document, over counts of all documents.

    ``order`` is the longest n-gram. Null and empty texts have no words: log_score 0 and a null mean. Rows that
    share a doc_id are one document's parts: their words and scores are added up (null ids are one document).
    Texts of any length are read whole, columns other than doc_id and text are ignored, whatever their names, and
    an empty table gives no rows. N-grams of more than ``hot`` of all words are added up before the shuffle. With
    ``min_count`` 1 all n-grams, else pairs and longer ones are shuffled in ``parts`` passes by hash (a power of two), so
    that only a part of them is on disk at a time.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    if min_count <= 1:
        out = _every_found(spark, docs, order, hot, parts)
    else:
        found, total = tables(spark, docs, alpha, min_count, order)
        least = max(1, int(total * hot))
        sums = _sums(spark, docs, 1, found[0], least, highest=order)
        for k in range(2, order + 1):
            for part in range(parts):
                sums = sums.unionByName(_sums(spark, docs, k, found[k - 1], least, part, parts))
        for table in found:
            forget(spark, table)
        begun = -float(np.log(alpha)) * F.sum("n_short")  # words without a context aren't backed off to
        out = sums.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), (F.sum("s") + begun).alias("s"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6))
    return out.select("doc_id", "n_words", F.round("s", 4).alias("log_score"), mean.alias("mean_log_score"))
