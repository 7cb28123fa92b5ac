"""Token-id output: one zstandard frame per document, all sharing one trained dictionary.

Layout of a store (all of it written by Spark, so any file system that Spark can write works and a
lost executor only costs its task):

``<path>/dictionary``  one row: dict_hash (sha256 of the bytes), dictionary, width, end_id
``<path>/blocks``      one row per block of consecutive documents: shard, block, first_token (ids of the
                       shard before the block), tokens, first_id (the least that isn't null), last_id, dict_hash, width and the
                       offset index (doc_ids, n_tokens, offsets) into ``payload``, the frames one after
                       another

Documents are range-partitioned by doc_id, so shards, blocks and documents all ascend. A reader that
wants one short document prunes blocks by first_id/last_id and decompresses only that frame.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmine.llm.common import each_batch, hash_cuts, id_and_text, in_sample, small, stored

BLOCK_SCHEMA = (
    "shard int, block int, first_token long, tokens long, first_id long, last_id long, dict_hash string, width int, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
)
BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("first_token", pa.int64()),
        ("tokens", pa.int64()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
        ("dict_hash", pa.string()),
        ("width", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Letters and then marks other than the apostrophe, which also begins contractions.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
_BEFORE_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
_INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Texts that can't be cut at every space and line end: other white space, two in a row, or one at an end.
_OTHER_SPACE = "[\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = rf"\x00|{_OTHER_SPACE}|[ \n][ \n]|^[ \n]|[ \n]$"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Whole texts to little-endian id bytes, those of the plain call of the tokenizer.

    Byte-level BPE first cuts a text into pre-tokens, and a single space or line end between two other
    characters always begins one, as do marks after a letter. So texts are cut there, and the tokenizer
    sees a piece (a line end, a word with the space before it, marks) only once. Pieces of many texts are made distinct by Arrow before they
    are looked up. Texts with other white space are cut only before single spaces, and texts that spell
    an added token, which the tokenizer takes out first, not at all.
    """

    def __init__(self, path: str, width: int | None = None, cache: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.space = self.letters[32]
        self.width = width or (2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4)
        self.dtype = f"<u{self.width}"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.odd = "|".join([_ODD, *map(re.escape, added)])
        self.known: dict[str, bytes] = {"": b""}
        self.limit, self.packs = cache, {}

    def packed(self, ids: list[int]) -> bytes:
        """Little-endian bytes of some ids."""
        pack = self.packs.get(len(ids))
        if pack is None:
            pack = struct.Struct(f"<{len(ids)}{'H' if self.width == 2 else 'I'}").pack
            if len(ids) < 100:
                self.packs[len(ids)] = pack
        return pack(*ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, piece: str, lead: str, word: str) -> bytes:
        """Id bytes of a piece that isn't known yet: ``lead`` (nothing or a space) and a word, or a line end."""
        if word.isascii() and word.isalpha():  # one pre-token: straight to the merges; its letters stand for themselves
            return self.packed([t.id for t in self.tokenize(self.space + word if lead else word)])
        if _LETTERS.fullmatch(word):
            return self.packed([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        if m := _MARKED.fullmatch(word):  # two pre-tokens
            return b"".join(self.pieces([piece[: -len(m[2])], m[2]]))
        return self.whole(piece)

    def pieces(self, some: list[str]) -> list[bytes]:
        """Id bytes of each piece. What is kept of them is bounded: it is emptied when full."""
        found = list(map(self.known.get, some))
        for k, x in enumerate(found):
            if x is None:
                piece = some[k]
                found[k] = new = self.word(piece, " ", piece[1:]) if piece[0] == " " else self.word(piece, "", piece)
                if len(piece) <= 65:
                    if len(self.known) >= self.limit:
                        self.known = {"": b""}
                    self.known[piece] = new
        return found

    def _odd(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.whole(text)
        first, *rest = _INNER_SPACE.split(text)
        return b"".join([self.whole(first), *self.pieces(rest)])

    def many(self, texts: pa.Array) -> list[bytes]:
        """The id bytes of each text."""
        pieces = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        pieces = pc.split_pattern(pc.replace_substring_regex(pieces, _BEFORE_MARK, "\\1\0\\2"), "\0")
        distinct = pieces.flatten().dictionary_encode()
        found = self.pieces(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, ends = distinct.indices.to_numpy().tolist(), pieces.offsets.to_numpy().tolist()
        odd = set(pc.indices_nonzero(pc.match_substring_regex(texts, self.odd)).to_pylist())
        return [
            self._odd(texts[k].as_py()) if k in odd else b"".join(map(found.__getitem__, at[a:b]))
            for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))
        ]

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, width: int | None = None) -> Encoder:
    """One encoder per Python worker, kept for its next tasks."""
    key = (path, width)
    if key not in _encoders:
        _encoders[key] = Encoder(path, width)
    return _encoders[key]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; with too few samples to train on, their plain bytes (maybe none)."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    sample_docs: int = 1024,
    sample_chars: int = 16_384,
    dict_bytes: int = 65_536,
    level: int = 3,
    block_bytes: int = 1 << 20,
) -> str:
    """Encode every text of ``docs`` and write a store to ``path``; returns ``path``.

    The dictionary is trained on a bounded sample: of the ``sample_docs`` documents of the smallest hashed
    doc_ids, the texts of at most ``sample_chars`` characters. It only affects the size of the frames.
    Null texts are empty documents (just the end id); null doc_ids come first; rows that share a doc_id
    are ordered by a hash of the text; texts of any length are one frame; other columns are ignored, whatever their
    names; an empty table gives a store without blocks.
    """
    docs = id_and_text(docs)
    enc = Encoder(tokenizer_path)
    width = enc.width if end_id < 1 << 16 else 4
    short = (F.length("text") > 0) & (F.length("text") <= sample_chars)
    drawn = in_sample(hash_cuts(docs.select("doc_id"), sample_docs))
    sample = {r.doc_id: r.text for r in docs.filter(drawn & short).orderBy("doc_id", "text").limit(2 * sample_docs).collect()}
    enc = Encoder(tokenizer_path, width)
    end = int(end_id).to_bytes(width, "little")
    dictionary = train_dictionary([enc(text) + end for _, text in sorted(sample.items())], dict_bytes)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(dict_hash, dictionary, width, end_id)], "dict_hash string, dictionary binary, width int, end_id int"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, width)
        compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value)).compress
        shard = TaskContext.get().partitionId()
        ids, sizes, offsets, frames = [], [], [0], []
        number, before = 0, 0

        def block() -> pa.RecordBatch:
            first = next((x for x in ids if x is not None), None)
            row = [shard, number, before, sum(sizes), first, ids[-1], dict_hash, width]
            row += [ids, sizes, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], type=f.type) for x, f in zip(row, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW
            )

        for batch in each_batch(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.many(batch.column(1)), strict=True):
                raw += end
                frames.append(compress(raw))
                ids.append(doc_id)
                sizes.append(len(raw) // width)
                offsets.append(offsets[-1] + len(frames[-1]))
                if offsets[-1] >= block_bytes:
                    yield block()
                    number, before = number + 1, before + sum(sizes)
                    ids, sizes, offsets, frames = [], [], [0], []
        if ids:
            yield block()

    (
        docs.withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")  # rows of one id, or without any, are no single task
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
        .mapInArrow(encode, BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )
    return path


def _frames(row: dict, decompress) -> Iterator[tuple[int, int, np.ndarray]]:
    payload, offsets = row["payload"], row["offsets"]
    for k, (doc_id, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
        raw = decompress(payload[offsets[k] : offsets[k + 1]])
        ids = np.frombuffer(raw, dtype=f"<u{row['width']}")
        if len(ids) != n:
            raise ValueError(f"document {doc_id}: {len(ids)} ids, its index says {n}")
        yield k, doc_id, ids


def _stored_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary doesn't match its hash")
    return row.dict_hash, data


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32 of every document, none for a store without blocks.

    ``start`` is the shard's base plus the position in it. The bases come from one total per shard. Null
    doc_ids come back as null, empty texts with the end id alone, repeated rows as often as they were written.
    """
    dict_hash, dictionary = _stored_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per output file
    bases = blocks.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    bases = stored(spark, bases.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base")), "bases")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _decompressor(shared.value)
        for batch in each_batch(batches, 1):
            row = batch.to_pylist()[0]
            if row["dict_hash"] != dict_hash:
                raise ValueError("a block was written with another dictionary")
            start = row["base"] + row["first_token"]
            rows = []
            for _, doc_id, ids in _frames(row, decompress):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
            )

    fields = ["first_token", "dict_hash", "width", "doc_ids", "n_tokens", "offsets", "payload", "base"]
    return (
        blocks.join(small(bases), "shard")
        .select(*fields)
        .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def fetch(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: other blocks are pruned, other frames are left compressed.

    Ids that the store lacks give no row, ids it has twice give two, in one block or in several; null ids can't be
    asked for and hide no others; empty texts have the end id; an empty store gives no rows.
    """
    wanted = sorted({int(x) for x in doc_ids})
    dict_hash, dictionary = _stored_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    if not wanted:
        return blocks.select(F.lit(0).cast("long").alias("doc_id"), F.array(F.lit(0)).alias("ids")).limit(0)
    hit = F.lit(False)
    for x in wanted:
        hit |= (F.coalesce("first_id", "last_id") <= x) & (F.col("last_id") >= x)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress, some = _decompressor(shared.value), set(wanted)
        for batch in each_batch(batches, 1):
            row = batch.to_pylist()[0]
            if row["dict_hash"] != dict_hash:
                raise ValueError("a block was written with another dictionary")
            keep = [k for k, x in enumerate(row["doc_ids"]) if x in some]
            rows = []
            for k in keep:
                raw = decompress(row["payload"][row["offsets"][k] : row["offsets"][k + 1]])
                rows.append((row["doc_ids"][k], np.frombuffer(raw, dtype=f"<u{row['width']}").tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
                )

    fields = ["dict_hash", "width", "doc_ids", "n_tokens", "offsets", "payload"]
    return blocks.filter(hit).select(*fields).mapInArrow(decode, "doc_id long, ids array<int>")
