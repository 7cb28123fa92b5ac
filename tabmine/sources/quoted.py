"""Records of delimited text whose quoted fields may hold line ends, read in parallel splits.

Spark cuts files into splits of lines. Whether a split begins inside a quoted field depends on all text before
it, so a first pass reads each split both ways: what it would end in if it began outside, and if it began inside. A
prefix pass over one row per split fixes the states, and a second pass reads each split from its own
state. Parts of a record that runs over a split's end are put together by a join of those parts alone. A quote
opens a field only at its beginning, as in ``csv.reader``, which parses the records in the tasks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of the longest record; a longer one is an error, for its quote is likely never closed.
LONGEST = 1 << 24


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, if one was (or wasn't) before it."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':  # no quoted field: to the next one
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        inside = False
        while (at := line.find('"', at) + 1) and line[at : at + 1] == '"':  # two quotes stand for one
            at += 1
        if not at:
            return True
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(f, start, whole, value): the lines of all files with their split, in its order; ``whole`` files have one split."""
    raw = spark.read.text(path)
    meta = F.col("_metadata")
    value = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    whole = meta["file_block_length"] >= meta["file_size"]
    return raw.select(F.xxhash64(meta["file_path"]).alias("f"), meta["file_block_start"].alias("start"), whole.alias("whole"), value.alias("value"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The splits of a task: all columns but the last, which has the lines; they have to be read before the next."""
    every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held: list[tuple] = []  # the row that told the end of a split

    def lines(key: tuple, first: str) -> Iterator[str]:
        yield first
        for row in every:
            if row[:-1] != key:
                held.append(row)
                return
            yield row[-1]

    while (row := held.pop() if held else next(every, None)) is not None:
        yield row[:-1], lines(row[:-1], row[-1])


def _cleaned(lines: Iterator[str], key: tuple[int, int], skip: int) -> Iterator[str]:
    """Lines after the first ``skip``, without the byte order mark of a file's first."""
    for k, line in enumerate(lines):
        if k >= skip:
            yield line.removeprefix("\ufeff") if k == key[1] == 0 else line


def _states(spark: SparkSession, lines: DataFrame, delimiter: str, skip_rows: int) -> dict[tuple[int, int], tuple[bool, int, bool]]:
    """(begins inside, lines to skip, has the header) of the splits of files with several, where that isn't (False, 0, False).

    A row per split comes to the driver, of files that have more than one.
    """
    rows = lines.filter(~F.col("whole")).select("f", "start", "value")
    skips: dict[tuple[int, int], int] = {}
    if skip_rows:
        before = F.sum("n").over(Window.partitionBy("f").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
        counts = rows.groupBy("f", "start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
        skips = {(r.f, r.start): skip_rows - r.before for r in counts.filter(F.col("before") < skip_rows).collect()}
    out = pa.schema([("f", pa.int64()), ("start", pa.int64()), *[(n, pa.bool_()) for n in ("out", "inn", "begins")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, some in _splits(batches):
            out_, in_, begins = False, True, False
            for line in _cleaned(some, key, skips.get(key, 0)):
                begins |= not out_ and line.strip() != ""  # a record begins here, if the split begins outside
                out_, in_ = ends_inside(line, delimiter, out_), ends_inside(line, delimiter, in_)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, out_, in_, begins)], schema=out)

    found = rows.mapInArrow(run, "f long, start long, out boolean, inn boolean, begins boolean").collect()
    states: dict[tuple[int, int], tuple[bool, int, bool]] = {}
    file, inside, header = None, False, False
    for r in sorted(found, key=lambda r: (r.f, r.start)):
        if r.f != file:
            file, inside, header = r.f, False, True
        key = (r.f, r.start)
        here = header and not inside and r.begins
        if (state := (inside, skips.get(key, 0), here)) != (False, 0, False):
            states[key] = state
        header &= not here
        inside = r.inn if inside else r.out
    return states


def read_records(spark: SparkSession, path: str, delimiter: str, header: bool, encoding: str = "UTF-8", skip_rows: int = 0) -> DataFrame:
    """(cells): the fields of each record of a file or folder, trimmed, empty ones null; without header records.

    ``skip_rows`` lines are passed over at the beginning of each file, and the first record then is its header if there is
    one. Blank lines outside of quotes are dropped. A quoted field keeps its line ends, as "\\n".
    """
    lines = lines_of(spark, path, encoding)
    states = spark.sparkContext.broadcast(_states(spark, lines, delimiter, skip_rows))
    out = pa.schema([("f", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        whole = (False, skip_rows, header)
        for key, some in _splits(batches):
            inside, skip, drop = whole if key[2] else states.value.get(key[:2], (False, 0, False))
            drop &= header
            kind, open_, size, ready = 0 if inside else 2, [], 0, []  # 0: begun before this split, 2: begun in it

            def part(kind: int, text: str, key=key) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key[:2], kind, text, None), out.types, strict=True)], schema=out)

            for line in _cleaned(some, key, skip):
                if not inside and not line.strip():
                    continue
                open_.append(line)
                size += len(line) + 1
                if size > LONGEST:
                    raise ValueError(f"a record of over {LONGEST} characters; is a quote never closed?")
                inside = ends_inside(line, delimiter, inside)
                if not inside:
                    record, open_, size = "\n".join(open_), [], 0
                    if kind == 0:
                        yield part(0, record)
                    elif drop:
                        drop = False
                    else:
                        ready.append(record)
                    kind = 2
                    if len(ready) >= 4096:
                        yield _parsed(ready, delimiter, out)
                        ready = []
            if open_:  # the header may be such a record
                yield part(3 if drop else 1 if kind == 0 else 2, "\n".join(open_))
            if ready:
                yield _parsed(ready, delimiter, out)

    schema = "f long, start long, kind int, text string, cells array<string>"
    found = lines.select("f", "start", "whole", "value").mapInArrow(run, schema)
    return found.filter("cells is not null").select("cells").unionByName(_joined(found.filter("cells is null"), delimiter))


def _parsed(records: list[str], delimiter: str, out: pa.Schema) -> pa.RecordBatch:
    rows = [[c.strip() or None for c in row] for row in csv.reader((r + "\n" for r in records), delimiter=delimiter)]
    empty = [pa.nulls(len(rows), t) for t in out.types[:-1]]
    return pa.RecordBatch.from_arrays([*empty, pa.array(rows, out.types[-1])], schema=out)


def _joined(parts: DataFrame, delimiter: str) -> DataFrame:
    """(cells) of the records that run over splits, from their parts; kind 3 begins a header."""
    order = Window.partitionBy("f").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = parts.withColumn("record", F.sum(F.when(F.col("kind") >= 2, 1).otherwise(0)).over(order))
    whole = begun.groupBy("f", "record").agg(F.max("kind").alias("first"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    texts = whole.filter("first < 3").select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    out = pa.schema([("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        for batch in batches:
            yield _parsed(batch.column(0).to_pylist(), delimiter, out)

    return texts.mapInArrow(run, "cells array<string>")
