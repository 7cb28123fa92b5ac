"""Near-duplicate sets of word shingles by a parity-sketch join: exact Jaccard links, connected groups.

A set's sketch flips one bit for each of its hashed shingles. A shingle that two sets share flips the same
bit in both, so their sketches differ in no more bits than the sets in shingles. Sets of a and b shingles with a
Jaccard similarity of p per cent or more differ in at most (100 - p)(a + b) / (100 + p).

Sizes fall into bands so wide that linked sets are in one band or in neighbouring ones. For each band and
the next, with room for D differences, a set's shingles are dealt out into D + 1 + s blocks by their hashes, and a block's word
is the exclusive or of its hashes, 64 bits. A shingle that only one of two sets has changes one block, so by the pigeonhole
principle linked sets agree on at least s + 1 words, and meet at one of them; sets that agree on a word have just the same
shingles in its block. Words of few shingles would be frequent keys: each set leaves out its s words of fewest, in
one order for all, and the last word that linked sets agree on stays in both. Sets that meet are verified on their texts.

Rows that meet at a key are compared in two rounds. First each is verified with the smallest of the key only,
which joins large groups of near copies with a link each. Then the remaining pairs of a key whose ends are
still in different groups are compared by longer sketches, in tiles of bounded size, and verified if the
lower bound lets them through. Pairs inside one group need no comparison, so nothing that could join two
groups is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm.common import each_batch, forget, id_and_text, small, stored
from tabmine.llm.components import components
from tabmine.llm.hashed import codes, pairs, words_at

_ONE = np.uint64(1)


def shingle_set(text: str, shingle: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of all words as one if there are fewer; empty without words."""
    c = codes(text)
    c[(c >= 65) & (c <= 90)] += np.uint64(32)
    w = words_at(c)[0]
    if not len(w):
        return w
    n, h = min(shingle, len(w)), w
    h = h[: len(w) - n + 1]
    for k in range(1, n):
        h = pairs(h, w[k : len(w) - n + 1 + k])
    return np.unique(pairs(h, np.full(len(h), n, dtype=np.uint64)))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        total = np.array([pairs(hashes, hashes >> np.uint64(7)).sum(dtype=np.uint64)])
    return int(pairs(total, np.array([len(hashes)], dtype=np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands and sketch lengths for one similarity, in per cent."""

    def __init__(self, percent: int = 85):
        if not 0 < percent <= 100:
            raise ValueError("percent must be 1 to 100")
        self.percent, self.first = percent, [1]

    def differences(self, size: int) -> int:
        """The most shingles in which linked sets of together ``size`` shingles differ."""
        return (100 - self.percent) * size // (100 + self.percent)

    def _next(self) -> None:
        self.first.append(self.first[-1] * 100 // self.percent + 1)

    def band(self, n: int) -> int:
        while self.first[-1] <= n:
            self._next()
        return int(np.searchsorted(self.first, n, "right")) - 1

    def words(self, band: int) -> tuple[int, int]:
        """Words (blocks) of a band and the next, and how many of them a set leaves out."""
        while len(self.first) < band + 2:
            self._next()
        most = self.first[band + 1] - 1
        differ = self.differences(most + most * 100 // self.percent)
        spare = 1 + differ // 2
        return (differ + 1 + spare, spare) if differ else (0, 0)  # sets that may not differ are equal, hence one

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The keys at which a set meets others."""
        own = self.band(len(hashes))
        found = []
        for band in (own, own - 1):
            m, spare = self.words(band) if band >= 0 else (0, 0)
            if not m:
                continue
            block = ((hashes >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # ascending, as the hashes
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            word, size = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.int64)
            word[block[starts]] = np.bitwise_xor.reduceat(pairs(hashes, hashes), starts)
            size[block[starts]] = np.diff(np.append(starts, len(block)))
            key = pairs(pairs(np.arange(m, dtype=np.uint64), np.full(m, band, dtype=np.uint64)), word)
            found.append(key[np.lexsort((key, size))[spare:]])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A parity sketch of 4 bits or more a shingle, a power of two long; longer ones fold to shorter ones by xor."""
    size = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    place = hashes & np.uint64(size - 1)
    place, n = np.unique(place, return_counts=True)
    place = place[n % 2 == 1]
    out = np.zeros(size // 64, dtype=np.uint64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), _ONE << (place & np.uint64(63)))
    return out


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row each) folded to ``words`` words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _scan(docs: DataFrame, make, out: pa.Schema, shingle: int, once: bool) -> DataFrame:
    """Rows ``make(doc_id, text, hashes, node, new)`` of each text, columns that are arrays being many rows.

    ``node`` is the set's id, None for empty sets; ``new`` says that the task hasn't had the set before. With
    ``once`` only the new ones are taken. A task remembers the ids it has had, 8 bytes a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in each_batch(batches, 256):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingle_set(text, shingle)
                node = set_id(hashes) if len(hashes) else None
                new = node is not None and node not in seen
                if new:
                    seen.add(node)
                if new or not once:
                    rows.append(make(doc_id, text, hashes, node, new))
            if rows:
                columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else c for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return id_and_text(docs).mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in out))


def measured(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, node, n, sketch) of every row; node is null for empty sets, and a task gives each sketch once."""
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    return _scan(docs, lambda doc_id, _, hashes, node, new: (doc_id, node, len(hashes), sketch(hashes).tobytes() if new else None), out, shingle, False)


def keyed(docs: DataFrame, percent: int = 85, shingle: int = 4) -> DataFrame:
    """(key, node) for every set and key; sets in several tasks repeat."""
    bands = Bands(percent)

    def make(doc_id, text, hashes, node, new):
        keys = bands.keys(hashes).view(np.int64)
        return keys, np.full(len(keys), node, dtype=np.int64)

    return _scan(docs, make, pa.schema([("key", pa.int64()), ("node", pa.int64())]), shingle, True)


def texts_of(spark: SparkSession, docs: DataFrame, sets: DataFrame, found: DataFrame, shingle: int = 4) -> DataFrame:
    """(node, text) of the sets in the pairs of ``found``, once each, stored.

    Only rows with the first id of such a set are hashed again, and rows without an id. A task gives a set
    once, so no set has more rows than there are tasks before the last step.
    """
    nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "first_id"), "node")
    nodes = stored(spark, nodes, "nodes")
    docs = id_and_text(docs)
    ids = stored(spark, nodes.select(F.col("first_id").alias("doc_id")).filter("doc_id is not null").distinct(), "ids")
    some = docs.join(small(ids, 1_000_000), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    out = pa.schema([("node", pa.int64()), ("text", pa.string())])
    some = _scan(some, lambda doc_id, text, hashes, node, new: (node, text), out, shingle, True)
    some = stored(spark, some.join(nodes.select("node"), "node", "left_semi"), "texts")
    texts = stored(spark, some.dropDuplicates(["node"]), "texts")
    for table in (some, nodes, ids):
        forget(spark, table)
    return texts


def meetings(rows: DataFrame) -> DataFrame:
    """(key, node, center) of all sets that meet another at a key; center is the key's smallest set.

    A pass over sorted rows that holds one batch; keys with one set are dropped.
    """
    out = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("center", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, center and last set of the open run, and whether its center is written
        for batch in batches:
            key, node = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(key):
                continue
            center = np.zeros(0, dtype=np.int64)
            if last:
                key, node = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node])
            start = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(start)
            run_of = np.cumsum(start) - 1
            center = node[starts][run_of]
            fresh = np.concatenate([[False], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            other = fresh & (node != center)
            if last and len(key) > 1 and not start[1] and last[2] == node[1]:
                other[1] = False  # the set that the batch before ended with
            met = np.zeros(len(starts), dtype=bool)
            met[run_of[other]] = True
            head = met.copy()
            if last and last[3]:
                head[0] = False
            ends_written = bool(met[-1]) or bool(last and last[3] and len(starts) == 1)
            take = other.copy()
            take[starts[head]] = True
            last = (key[-1], center[-1], node[-1], ends_written)
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[take], pa.int64()) for x in (key, node, center)], schema=out)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, center long")


def _with_both(found: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the columns of both ends; the second join's left side is heavy, so a hot ``a`` can be split."""
    one = lambda end: of.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return found.join(one("b"), "b").join(one("a"), "a").select("a", "b", *[f"{c}_{end}" for c in columns for end in "ab"])


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bounded(found: DataFrame, sets: DataFrame, percent: int = 85) -> DataFrame:
    """The pairs of ``found`` that sizes and sketches of ``sets`` (node, n, sketch) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
            keep = np.flatnonzero(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            differ = np.zeros(len(keep), dtype=np.int64)
            for k, row in enumerate(keep.tolist()):
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype="<u8")[None] for c in (4, 5))
                words = min(x.shape[1], y.shape[1])
                differ[k] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)
            keep = keep[(100 + percent) * differ <= (100 - percent) * (n_a[keep] + n_b[keep])]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=_PAIRS)

    return _with_both(found, sets, "n", "sketch").mapInArrow(run, "a long, b long")


def verified(found: DataFrame, texts: DataFrame, percent: int = 85, shingle: int = 4) -> DataFrame:
    """The pairs (a, b) of ``found`` whose sets are similar enough, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, np.zeros(0, dtype=np.uint64)
        for batch in each_batch(batches, 256):
            rows = []
            for a, b, text_a, text_b in zip(*(batch.column(k) for k in range(4)), strict=True):
                if held != a.as_py():
                    held, left = a.as_py(), shingle_set(text_a.as_py(), shingle)
                right = shingle_set(text_b.as_py(), shingle)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    rows.append((held, b.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_PAIRS)

    return _with_both(found, texts, "text").mapInArrow(run, "a long, b long")


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Index pairs of sketches that may belong to similar sets, by sizes and the lower bound, and that bound; in blocks."""
    step = max(1, cells // max(1, b.size))
    for k in range(0, len(a), step):
        x, size = a[k : k + step], n_a[k : k + step, None] + n_b[None, :]
        least = np.minimum(n_a[k : k + step, None], n_b[None, :])
        may = 100 * least >= percent * (size - least)
        if may.any():
            differ = np.bitwise_count(x[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(may & ((100 + percent) * differ <= (100 - percent) * size))
            yield i + k, j, differ[i, j]


def _forest(x: np.ndarray, y: np.ndarray, differ: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs of one block span the groups of ``label`` (changed); the closest of a row's are taken first."""
    taken = []
    order = np.lexsort((differ, x))
    rows, starts = np.unique(x[order], return_index=True)
    for row, part in zip(rows.tolist(), np.split(order, starts[1:]), strict=False):  # no rows: one empty part
        part = part[label[y[part]] != label[row]]
        others, first = np.unique(label[y[part]], return_index=True)
        if len(others):
            taken.append(part[first])
            label[np.isin(label, others)] = label[row]
    return np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)


def crossing(spark: SparkSession, rows: DataFrame, percent: int = 85, forest: bool = False, most_bytes: int = 1 << 25) -> DataFrame:
    """(a, b, key): pairs of sets that share a key, are in different groups and pass the sketch's bound.

    With ``forest`` only as many of a tile's pairs come back as join its groups, and ``key`` alone tells of each key
    of which pairs were left out; else it is null.
    ``rows``: (key, node, root, n, sketch). A key whose sketches take more than ``most_bytes`` goes to tiles of
    two of its salted parts, all pairs of parts.
    """
    parts = rows.groupBy("key").agg(F.sum(F.length("sketch")).alias("size")).filter(F.col("size") > most_bytes)
    parts = stored(spark, parts.select("key", F.ceil(F.col("size") * 2 / most_bytes).cast("int").alias("parts")), "parts")
    rows = rows.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("key", "part", other, "node", "root", "n", "sketch")
    rows = rows.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "node", "root", "n", "sketch")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def tile() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            left_out = False
            held.sort(key=lambda row: len(row[-1]))
            part, node, root, n = (np.array(c) for c in list(zip(*held, strict=True))[:4])
            width = np.array([len(row[-1]) for row in held])
            edges = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(held)]
            blocks = [(a, b, np.stack([np.frombuffer(row[-1], dtype="<u8") for row in held[a:b]])) for a, b in zip(edges, edges[1:], strict=False)]
            label = np.unique(root, return_inverse=True)[1]
            for i, (a1, b1, s1) in enumerate(blocks):
                for a2, b2, s2 in blocks[i:]:
                    for x, y, differ in _close(s1, folded(s2, s1.shape[1]), n[a1:b1], n[a2:b2], percent):
                        x, y = x + a1, y + a2
                        keep = (root[x] != root[y]) & ((part[x] != part[y]) | (name[1] == name[2]))
                        x, y, differ = x[keep], y[keep], differ[keep]
                        if forest:
                            keep = _forest(x, y, differ, label)
                            left_out |= len(keep) < len(x)
                            x, y = x[keep], y[keep]
                        if len(x):
                            found = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1), axis=0)
                            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], schema=out)
            if left_out:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (None, None, name[0])], schema=out)

        for batch in batches:
            for key, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, x, y) != name:
                    yield from tile()
                    name, held = (key, x, y), []
                held.append(row)
        yield from tile()

    tiles = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return tiles.mapInArrow(run, "a long, b long, key long").distinct()


def links(spark: SparkSession, docs: DataFrame, sets: DataFrame, percent: int = 85, shingle: int = 4) -> DataFrame:
    """Pairs (a, b) of ``sets`` (node, first_id, n, sketch; stored) that are similar enough and connect all that such pairs connect."""
    shared = stored(spark, meetings(keyed(docs, percent, shingle)), "meetings")
    stars = stored(spark, shared.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    rest = stored(spark, shared.filter("node <> center").select("key", "node"), "meetings")
    forget(spark, shared)

    def similar(some: DataFrame) -> DataFrame:
        texts = texts_of(spark, docs, sets, some, shingle)
        found = stored(spark, verified(some, texts, percent, shingle), "links")
        forget(spark, texts)
        return found

    found, tested = similar(stored(spark, bounded(stars, sets, percent), "pairs")), stars
    for forest in (True, False):
        groups = stored(spark, components(spark, found), "groups")
        rooted = stored(spark, rest.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "meetings")
        keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        keys = stored(spark, keys, "keys")
        crossed = stored(spark, rooted.join(keys, "key", "left_semi"), "meetings")
        # a set's sketch goes to each of its open keys
        sketched = stored(spark, crossed.join(sets.select("node", "n", "sketch"), "node"), "meetings")
        crosses = stored(spark, crossing(spark, sketched, percent, forest), "crosses")
        more = crosses.filter("key is null").select("a", "b").join(tested, ["a", "b"], "left_anti")
        more = stored(spark, more, "pairs")
        # keys all of whose pairs have been taken are done with
        rest_open = crossed.select("key", "node").join(small(crosses.filter("key is not null").select("key")), "key", "left_semi")
        rest_open = stored(spark, rest_open, "meetings")
        for table in (groups, rest, rooted, keys, crossed, sketched, crosses):
            forget(spark, table)
        rest = rest_open
        tested, found = tested.unionByName(more), found.unionByName(similar(more))
    forget(spark, rest)
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, shingle: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A row's set are the distinct shingles of its words, lower-cased in A-Z, repeats counting once; sets are told
    apart by 64-bit hashes. Equal sets are one node, so copies cost a row each. component_id is the smallest
    doc_id reachable over links. Null and empty texts, and those without words, have 0 shingles and are linked with
    nothing; null doc_ids get their group's smallest other doc_id, or null; repeated rows give repeated rows, an
    empty table none; similarities equal to the limit are links; texts of any length are read whole; other
    columns are ignored, whatever their names.
    """
    rows = stored(spark, measured(docs, shingle), "rows")
    sets = rows.filter("node is not null").groupBy("node")
    sets = stored(spark, sets.agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")), "sets")
    slim = stored(spark, rows.drop("sketch"), "rows")  # the sketches are in sets now
    forget(spark, rows)
    rows = slim
    roots = components(spark, links(spark, docs, sets, percent, shingle))
    nodes = sets.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stored(spark, nodes, "nodes")
    least = stored(spark, nodes.groupBy("root").agg(F.min("first_id").alias("component_id")), "groups")
    found = stored(spark, nodes.join(least, "root").select("node", "component_id"), "members")  # a hot group's join can be split
    for table in (sets, nodes, least):
        forget(spark, table)
    alone = rows.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
