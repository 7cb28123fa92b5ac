"""Benchmark decontamination by the q-gram lemma: banded q-gram counts, then banded alignment.

A pattern of n characters within k edits of a piece of text shares at least n + 1 - q - kq q-grams with
it, all on diagonals (text position minus pattern position) that span at most k. Diagonals are cut into
bands of 2(k + 1) that overlap by half, so that one band holds them all. Bands with enough shared
q-grams are aligned; alignment only walks the band.

Texts and items are compared in lower case with every run of characters that are neither letters nor
digits as one space. An item is sought in overlapping segments of ``segment`` characters (whole up to
that length), and in segments of ``least`` characters so close together that every passage of
``passage`` characters holds a whole one: such a passage counts wherever in the item it begins. Items
under ``least`` characters are sought whole, those under 10 as whole words without edits.

Benchmark items are broadcast in blocks of about ``block_chars`` characters. One block is indexed on the
driver. Several are dealt out by a hash, indexed in tasks and stored; one scan of the texts with bit filters of
all items' q-grams finds the few texts that could match any, and only those meet the blocks, one block after
the other. Texts are never shuffled or paired with each other.

Repeated q-grams cost no more than the text and the index: pairs of a text position and an index entry are
made for some ``most`` at a time, patterns with more of them are counted in windows, and diagonals that touch
are aligned at once. Items of which a plain copy stands in the text need neither.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm.common import each_batch, forget, id_and_text, stored

_B = np.uint64(0x9E3779B97F4A7C15)
Q = 10
_alnum = np.zeros(0, dtype=bool)


def normal(text: str) -> np.ndarray:
    """Code points of the normal form."""
    global _alnum
    if not len(_alnum):  # once per process
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = _alnum[c]
    first = keep.copy()  # a character, or the first other one after a character
    first[1:] |= keep[:-1]
    c = np.where(keep, c, np.uint32(32))[first]
    return c[:-1] if len(c) and c[-1] == 32 else c


def qgrams(c: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all windows of 10 characters, from those of 2, 4 and 8."""
    if len(c) < Q:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        b2 = _B * _B
        c = c.astype(np.uint64)
        two = c[:-1] * _B + c[1:]
        four = two[:-2] * b2 + two[2:]
        eight = four[:-4] * (b2 * b2) + four[4:]
        return eight[:-2] * b2 + two[8:]


def banded_edits(pattern: np.ndarray, text: np.ndarray, shift: int, most: int, span: int | None = None) -> tuple[int, int, int]:
    """The least edits of ``pattern`` against a piece of ``text``, and that piece's start and end.

    Only diagonals (text minus pattern position) of the band that begins at ``shift``, ``span`` wide (2 * most + 2
    if None), and of ``most`` more on both sides, count. More than ``most`` edits give most + 1. A cell is
    edits * scale + start, so ties go to the earlier start and then to the earlier end.
    """
    low, width = shift - most, (2 * most + 2 if span is None else span) + 2 * most
    if (copy := find_copy(pattern, text, max(low, 0), low + width - 1 + len(pattern))) >= 0:
        return 0, copy, copy + len(pattern)  # no alignment beats a plain copy
    scale = len(text) + 2
    far = (most + 1) * scale
    at = low + np.arange(width)
    steps = np.arange(width) * scale
    cell = np.where((at >= 0) & (at <= len(text)), at, far)
    for i in range(1, len(pattern) + 1):
        j = at + i
        inside = (j > 0) & (j <= len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[j[inside] - 1] == pattern[i - 1]
        new = np.where(inside, cell + np.where(same, 0, scale), far)
        new[:-1] = np.minimum(new[:-1], cell[1:] + scale)
        new[(j < 0) | (j > len(text))] = far
        cell = np.minimum(np.minimum.accumulate(new - steps) + steps, far)
        cell[(j < 0) | (j > len(text))] = far
        if cell.min() >= far:
            return most + 1, 0, 0
    k = int(np.argmin(cell))
    return int(cell[k] // scale), int(cell[k] % scale), len(pattern) + low + k


def find_copy(pattern: np.ndarray, text: np.ndarray, start: int = 0, end: int | None = None) -> int:
    """Where ``text[start:end]`` first holds ``pattern`` as it is, or -1."""
    piece, sought = text[start : len(text) if end is None else max(0, end)].tobytes(), pattern.tobytes()
    copy = piece.find(sought)
    while copy >= 0 and copy % 4:
        copy = piece.find(sought, copy + 1)
    return start + copy // 4 if copy >= 0 else -1


def _merged(low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Intervals [low, high), ordered by low, as disjoint ones of at most ``most``."""
    upto = np.maximum.accumulate(high)
    cuts = np.flatnonzero(np.concatenate([[True], low[1:] > upto[:-1]]))
    ends = upto[np.append(cuts[1:], len(upto)) - 1]
    return [(a, min(a + most, end)) for start, end in zip(low[cuts].tolist(), ends.tolist(), strict=True) for a in range(start, end, most)]


def _string(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _cuts(n: int, length: int, step: int) -> set[tuple[int, int]]:
    """Pieces of ``length`` every ``step`` characters and at the end; all n characters if there are fewer."""
    return {(0, n)} if n <= length else {(s, s + length) for s in (*range(0, n - length, step), n - length)}


class Index:
    """The q-grams of a block of items, sorted by hash, behind a bit filter."""

    #: Pairs of a text position and an index entry, and diagonals aligned, at a time.
    most, widest = 1 << 20, 1 << 15

    def __init__(self, items: list[tuple[int, str]], rate: float, segment: int, least: int, passage: int = 80):
        if not Q <= least <= min(segment, passage):
            raise ValueError(f"least must be {Q} to segment and passage")
        self.items, self.patterns = [], []
        self.words: dict[str, list[int]] = {}  # items too short for a q-gram
        for item_id, text in items:
            t = normal(text)
            if len(t) < Q:
                if len(t):
                    self.words.setdefault(_string(t), []).append(item_id)
                continue
            cuts = _cuts(len(t), segment, segment // 2)
            if len(t) >= passage:
                cuts |= _cuts(len(t), least, passage - least + 1)
            for s, end in sorted(cuts, key=lambda c: (c[0] - c[1], c)):
                self.items.append(item_id)
                self.patterns.append(t[s:end])
        self.lengths = sorted({w.count(" ") + 1 for w in self.words})
        self.size = size = np.array([len(p) for p in self.patterns], dtype=np.int64)
        # no more edits than leave a shared q-gram for sure
        self.edits = np.minimum(np.array([int(rate * n) for n in size.tolist()], dtype=np.int64), size // Q - 1)
        self.need = size + 1 - Q - self.edits * Q
        grams = [qgrams(p) for p in self.patterns]
        every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.pattern = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order] if grams else order
        self.place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order] if grams else order
        bits = max(16, (len(every) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        hit = np.zeros(1 << bits, dtype=bool)
        hit[every >> self.shift] = True
        self.filter = np.packbits(hit, bitorder="little")
        # any band lies within so many text positions
        self.reach = int((size + 2 * (self.edits + 1)).max()) if len(size) else 0

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best region of each item found, positions in the normal form."""
        t = normal(text)
        found = self._as_words(t) + self._near(t)
        best = dict(sorted(((m[0], m) for m in found), key=lambda x: (x[1][3], x[1][1]), reverse=True))
        return [best[item] for item in sorted(best)]

    def _as_words(self, t: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each of the shortest items as whole words."""
        if not self.words or not len(t):
            return []
        every = _string(t).split(" ")
        start = np.concatenate([[0], np.cumsum([len(w) + 1 for w in every])]).tolist()
        found: dict[str, int] = {}
        for n in self.lengths:
            for k in range(len(every) - n + 1):
                if start[k + n] - 1 - start[k] < Q and (w := " ".join(every[k : k + n])) in self.words:
                    found.setdefault(w, start[k])
        return [(item, at, at + len(w), 0) for w, at in found.items() for item in self.words[w]]

    def _near(self, t: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The best region of each item with q-grams."""
        grams = qgrams(t)
        if not len(self.hash) or not len(grams):
            return []
        hit = _in_filter(self.filter, self.shift, grams)
        least = int(self.need.min())
        dense = _dense(hit, self.reach, least)  # positions outside of their windows can't be in a full band
        if not len(dense):
            return []
        cover = np.zeros(len(hit) + 1, dtype=np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, np.minimum(dense + self.reach, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
        every, of, times = np.unique(grams[at], return_inverse=True, return_counts=True)
        lo, hi = np.searchsorted(self.hash, every, "left"), np.searchsorted(self.hash, every, "right")
        n = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pattern, gram = self.pattern[entry], np.repeat(np.arange(len(every)), n)  # once for each distinct q-gram
        load = np.bincount(pattern, weights=times[gram], minlength=len(self.patterns)).astype(np.int64)
        best = self._copies(t, np.flatnonzero(np.bincount(pattern, minlength=len(self.patterns)) == self.size + 1 - Q))
        sought = [p for p in np.flatnonzero(load >= self.need).tolist() if best.get(self.items[p], (1,))[0]]
        regions: dict[int, list[tuple[int, int]]] = {}
        light: list[int] = []
        for p in sought:
            if load[p] > self.most:  # its q-grams are very frequent: counted in windows, not by diagonals
                regions[p] = self._windows(p, at, grams[at])
                continue
            if light and load[light].sum() + load[p] > self.most:
                regions |= self._bands(light, at, of, pattern, gram, entry, len(t))
                light = []
            light.append(p)
        regions |= self._bands(light, at, of, pattern, gram, entry, len(t)) if light else {}
        for p in sorted(regions):
            k, item = int(self.edits[p]), self.items[p]
            for low, high in regions[p]:
                if item in best and best[item][0] == 0 and best[item][1] <= max(0, low - k):
                    break  # an exact copy that starts no later
                edits, start, end = banded_edits(self.patterns[p], t, low, k, high - low)
                if edits <= k and (item not in best or (edits, start) < best[item][:2]):
                    best[item] = (edits, start, end)
        return [(item, start, end, edits) for item, (edits, start, end) in sorted(best.items())]

    def _copies(self, t: np.ndarray, whole: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The first plain copy for each item of the patterns ``whole``, all of whose q-grams stand in the text."""
        best: dict[int, tuple[int, int, int]] = {}
        for p in whole.tolist():
            item, length = self.items[p], len(self.patterns[p])
            before = best[item][1] + length - 1 if item in best else None
            if (copy := find_copy(self.patterns[p], t, 0, before)) >= 0:
                best[item] = (0, copy, copy + length)
        return best

    def _bands(self, light: list[int], at, of, pattern, gram, entry, length: int) -> dict[int, list[tuple[int, int]]]:
        """For each pattern the diagonals of bands with enough q-grams; bands that touch are one."""
        own = np.isin(pattern, np.array(light))
        pattern, gram, place = pattern[own].astype(np.int64), gram[own], self.place[entry[own]]
        order = np.argsort(of, kind="stable")  # text positions by q-gram
        first = np.searchsorted(of[order], gram, "left")
        n = np.searchsorted(of[order], gram, "right") - first
        position = at[order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]]
        pattern, place = np.repeat(pattern, n), np.repeat(place, n)
        band = (position - place) // (self.edits[pattern] + 1)
        low, span = self.reach + 2, length + 2 * self.reach + 8  # band numbers start above -low
        key = pattern * span + band + low
        bands, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        full = bands[count >= self.need[bands // span]]
        found = {}
        for p in np.unique(full // span).tolist():
            half, start = int(self.edits[p]) + 1, (full[full // span == p] % span - low) * (int(self.edits[p]) + 1)
            found[p] = _merged(start, start + 2 * half, self.widest)
        return found

    def _windows(self, p: int, at: np.ndarray, grams: np.ndarray) -> list[tuple[int, int]]:
        """The diagonals on which pattern ``p`` may stand, from windows of its length with enough of its q-grams."""
        x = at[np.isin(grams, qgrams(self.patterns[p]))]
        size, k, need = int(self.size[p]), int(self.edits[p]), int(self.need[p])
        if len(x) < need:
            return []
        first, last = x[: len(x) - need + 1], x[need - 1 :]
        near = last - first <= size - Q + k
        return _merged(last[near] - size - 2 * k, first[near] + k + 1, self.widest) if near.any() else []


class Screen:
    """Which texts could match any item of several indexes: bit filters of their q-grams, their shortest items.

    Patterns that need few shared q-grams have a filter of their own, so that one short item doesn't let
    every text through.
    """

    def __init__(self, chars: int):
        self.bits = min(30, max(16, (chars * 16).bit_length()))
        self.shift = np.uint64(64 - self.bits)
        self.filters: dict[int, np.ndarray] = {}
        self.need: dict[int, int] = {}
        self.reach: dict[int, int] = {}  # any band lies within so many text positions
        self.words = Index([], 0.06, 160, 60)

    def add(self, index: Index) -> None:
        kind = np.frexp(index.need)[1] if len(index.need) else index.need  # by powers of two
        for k in np.unique(kind).tolist():
            bits = self.filters.setdefault(k, np.zeros(1 << (self.bits - 3), dtype=np.uint8))
            at = np.unique(index.hash[kind[index.pattern] == k] >> self.shift)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            self.need[k] = min(self.need.get(k, 1 << 62), int(index.need[kind == k].min()))
            self.reach[k] = max(self.reach.get(k, 0), int((index.size + 2 * (index.edits + 1))[kind == k].max()))
        for word, items in index.words.items():
            self.words.words[word] = items
        self.words.lengths = sorted({*self.words.lengths, *index.lengths})

    def hit(self, text: str) -> bool:
        t = normal(text)
        if self.words._as_words(t):
            return True
        grams = qgrams(t)
        return any(len(_dense(_in_filter(bits, self.shift, grams), self.reach[k], self.need[k])) for k, bits in self.filters.items())


def _in_filter(bits: np.ndarray, shift: np.uint64, grams: np.ndarray) -> np.ndarray:
    at = grams >> shift
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _dense(hit: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Starts of windows of ``reach`` positions with ``least`` hits or more."""
    upto = np.concatenate([[0], np.cumsum(hit)])
    if upto[-1] < least:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(upto[np.minimum(np.arange(len(hit)) + reach, len(hit))] - upto[:-1] >= least)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")


class _Indexes:
    """The indexes of a benchmark: one made here, or several made in tasks and stored."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, block_chars: int, **params):
        items = _items(benchmark)
        self.spark, self.table, self.screen = spark, None, None
        chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
        if chars < block_chars:
            self.one = Index([(r.item_id, r.text) for r in items.toLocalIterator()], **params)
            return
        n = -(-chars // block_chars)
        out = pa.schema([("index", pa.binary())])

        def build(block: pa.Table) -> pa.Table:
            made = Index(sorted(zip(block["item_id"].to_pylist(), block["text"].to_pylist(), strict=True)), **params)
            return pa.table([pa.array([pickle.dumps(made, 5)], pa.binary())], schema=out)

        rows = items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))  # texts of one id stay together
        self.table = stored(spark, rows.groupBy("block").applyInArrow(build, "index binary"), "indexes")
        screen = Screen(chars)
        for index in self._each():
            screen.add(index)
        self.screen = spark.sparkContext.broadcast(screen)

    def _each(self) -> Iterator[Index]:
        if self.table is None:
            yield self.one
            return
        for row in self.table.toLocalIterator():  # one partition at a time
            yield pickle.loads(row["index"])  # noqa: S301  written by the tasks above

    def shared(self) -> Iterator[Broadcast]:
        """The indexes as broadcasts, each to be used before the next is asked for if there are several."""
        for index in self._each():
            shared = self.spark.sparkContext.broadcast(index)
            yield shared
            if self.table is not None:
                shared.destroy()
        if self.table is not None:
            forget(self.spark, self.table)


def _passed(docs: DataFrame, text_col: str, shared, keep: bool) -> DataFrame:
    """The rows whose text the broadcast screen or index finds (``keep``), or doesn't find."""

    def test(text):  # a pandas Series of texts
        find = getattr(shared.value, "hit", None) or shared.value.matches
        return text.map(lambda t: (t is not None and bool(find(t))) == keep)

    return docs.filter(F.pandas_udf(test, "boolean")(F.col(text_col)))


def contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.06,
    segment: int = 160,
    least: int = 60,
    passage: int = 80,
    block_chars: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the best region of each item found in each document.

    A document matches an item if a segment of it stands in the text with at most ``rate`` edits per
    character: the whole item up to ``segment`` normal characters, a segment of that length, or one of
    ``least`` characters, of which every passage of ``passage`` characters holds one. Items under 20
    characters stand there without edits (the lemma leaves room for none), those under 10 as whole
    words; items without letters or digits match nothing. Null and empty texts match nothing; ties go to
    the fewest edits, then the earliest start; repeated rows of a document give repeated matches; texts of
    any length are read whole; other columns are ignored, whatever their names; an empty table gives no rows.

    Repeated characters and words in texts and items (long runs of one word) are matched like any others.
    """
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start", "end", "edits")])
    indexes = _Indexes(spark, benchmark, block_chars, rate=rate, segment=segment, least=least, passage=passage)
    texts, schema = id_and_text(docs), "doc_id long, item_id long, start long, end long, edits long"

    def searched(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in each_batch(batches):
                rows = [
                    (doc_id, *m)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for m in index.matches(text)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows, strict=True)], schema=out)

        return texts.mapInArrow(run, schema)

    if indexes.screen is None:
        return searched(next(indexes.shared()))
    texts = stored(spark, _passed(texts, "text", indexes.screen, True), "screened")
    parts = [stored(spark, searched(shared), "matches") for shared in indexes.shared()]
    forget(spark, texts)
    return reduce(DataFrame.unionByName, parts)


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, judged where they are: no shuffle, no join.

    Null and empty texts stay, repeated rows stay or go together, texts of any length are read whole; ids
    don't matter; extra columns stay, whatever their names; an empty table or benchmark drops nothing.
    """
    params = {"rate": 0.06, "segment": 160, "least": 60, "passage": 80, "block_chars": 1_000_000} | params
    indexes = _Indexes(spark, benchmark, **params)
    if indexes.screen is None:
        return _passed(docs, text_col, next(indexes.shared()), False)
    suspects = stored(spark, _passed(docs, text_col, indexes.screen, True), "screened")
    for shared in indexes.shared():
        before, suspects = suspects, stored(spark, _passed(suspects, text_col, shared, False), "screened")
        forget(spark, before)
    return _passed(docs, text_col, indexes.screen, False).unionByName(suspects)
