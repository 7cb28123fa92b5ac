"""Delimited text with a label: delimiter and header detection, cells, roles of columns, the dataset catalog."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmine.functions.columns import NUMBER, is_missing, number
from tabmine.sources.quoted import ends_inside, lines_of, read_records

DELIMITERS = (",", ";", "\t", "|", " ")


def _records(lines: list[str], delimiter: str, n: int) -> list[list[str]]:
    """The trimmed fields of the first records; quotes may hold delimiters and line ends."""
    rows, inside = [], False
    for line in lines:
        if inside or line.strip():
            rows = [*rows[:-1], f"{rows[-1]}\n{line}"] if inside else [*rows, line]
            inside = ends_inside(line, delimiter, inside)
    return [[c.strip() for c in row] for row in csv.reader((r + "\n" for r in rows[:n]), delimiter=delimiter)]


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter that gives all of the first records the same, largest number of fields over one; else a comma."""
    best, fields = ",", 1
    for d in DELIMITERS:
        counts = {len(row) for row in _records(lines, d, 5)}
        if len(counts) == 1 and (n := counts.pop()) > fields:
            best, fields = d, n
    return best


def detect_header(lines: list[str], delimiter: str) -> bool:
    """A header if the first record is mostly text over a mostly numeric second one, or has another field count."""
    some = _records(lines, delimiter, 2)
    if len(some) < 2:
        return False
    if len(some[0]) != len(some[1]):
        return True
    share = [sum(bool(re.match(NUMBER, c)) for c in row) / len(row) for row in some]
    return share[0] < 0.5 and share[1] > 0.5


def head(spark: SparkSession, path: str, n: int = 5, encoding: str = "UTF-8", skip_rows: int = 0) -> list[str]:
    """The first lines of a file after ``skip_rows``, blank ones aside, without a byte order mark.

    Of a folder that is the first file, or the largest if that has one line at most (an empty partition is written as
    a header alone). Spark reads a single file's splits in order, so a limit takes its first lines.
    """

    def lines(file: str) -> list[str]:
        first = [r.value for r in lines_of(spark, file, encoding).select("value").limit(skip_rows + 4 * n).collect()]
        if first:
            first[0] = first[0].removeprefix("\ufeff")
        return [x for x in first[skip_rows:] if x.strip()][:n]

    files = spark.read.text(path).inputFiles()
    if not files:
        return []
    found = lines(min(files))
    if len(found) > 1 or len(files) == 1:
        return found
    largest = spark.read.format("binaryFile").load(path).orderBy(F.desc("length"), "path").select("path").first()  # lists files, reads none
    return lines(largest.path) or found


def read_cells(
    spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, encoding: str = "UTF-8", skip_rows: int = 0
) -> DataFrame:
    """All cells as trimmed strings, empty ones as null; columns are named by the header, or c0, c1, ...

    ``path`` is a file, or a folder each of whose files begins with the header, if only that: it is the first record after
    ``skip_rows`` lines, and equal ones further on are data. Blank lines are dropped, and so are rows of fewer
    fields than the first data row has; fields beyond that are ignored. Quoted fields may hold delimiters and line
    ends (``quoted.read_records``). ``encoding`` is one that keeps line ends as single bytes. An empty file gives no
    columns.
    """
    lines = head(spark, path, 50, encoding, skip_rows)
    if not lines:
        return spark.createDataFrame([], T.StructType([]))
    delimiter = delimiter or detect_delimiter(lines)
    header = detect_header(lines, delimiter) if header is None else header
    rows = _records(lines, delimiter, 2)
    width = len(rows[1] if header and len(rows) > 1 else rows[0])
    names = [c or f"c{k}" for k, c in enumerate(rows[0][:width])] if header else []
    names += [f"c{k}" for k in range(len(names), width)]
    records = read_records(spark, path, delimiter, header, encoding, skip_rows)
    return records.filter(F.size("cells") >= width).select(*[F.col("cells")[k].alias(n) for k, n in enumerate(names)])


def labelled(cells: DataFrame, target: int = -1, skip: list[int] | None = None, row_id: str | None = None) -> DataFrame:
    """(row_id, features as double, label) from string columns.

    ``skip`` columns go first; ``target`` then counts among those that are left, from the end if negative.
    Cells that are no numbers become null; rows without a label are dropped. Without ``row_id`` ids are made
    from the cells' hash and a number among equal rows, so they are the same for any partitioning.
    """
    names = [c for k, c in enumerate(cells.columns) if k not in (skip or []) and c != row_id]
    label = names[target]
    features = [c for c in names if c != label]
    rows = cells.filter(F.col(label).isNotNull() & (F.trim(label) != ""))
    if row_id is None:
        rows = with_content_id(rows, "__row_id")
    key = F.col(row_id or "__row_id")
    return rows.select(key.alias("row_id"), *[number(F.col(c)).alias(c) for c in features], F.trim(label).alias("label"))


def with_content_id(rows: DataFrame, name: str, chunk: int = 100_000) -> DataFrame:
    """``rows`` with an id from their content: equal rows are counted and told apart by number.

    Counting combines on the map side, so a row that makes up much of the table is no hot key.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / chunk))).alias("__part")
    some = F.sequence(F.col("__part") * chunk, F.least(F.col("__n"), (F.col("__part") + 1) * chunk) - 1)
    numbered = counted.select("*", part).select(*rows.columns, F.explode(some).alias("__k"))
    cells = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return numbered.select(*rows.columns, F.concat_ws("-", F.md5(cells), F.col("__k")).alias(name))


def column_roles(cells: DataFrame) -> DataFrame:
    """(position, name, role) in one pass: feature, label or ignored.

    Columns whose cells, missing ones aside, are all numbers are features. The last other column is the
    label; if there is none, the last column is, unless it is the only one.
    """
    names = cells.columns
    text = [F.count_if(~is_missing(F.col(c)) & ~F.trim(F.col(c)).rlike(NUMBER)).alias(f"t{k}") for k, c in enumerate(names)]
    row = cells.agg(*text)
    flags = F.array(*[F.col(f"t{k}") > 0 for k in range(len(names))])
    last_text = F.array_max(F.transform(flags, lambda t, k: F.when(t, k).otherwise(-1)))
    label = F.when(last_text >= 0, last_text).when(F.lit(len(names) > 1), len(names) - 1).otherwise(-1)
    role = lambda t, k: F.when(k == label, "label").when(t, "ignored").otherwise("feature")
    cols = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("name"), F.transform(flags, role).alias("role"))
    return row.select(F.posexplode(cols).alias("position", "c")).select("position", "c.name", "c.role")


@dataclass
class Dataset:
    """A catalog entry: a delimited file or a Parquet table with its features and label."""

    path: str
    features: list[str] = field(default_factory=list)
    label: str = ""
    kind: str = "parquet"
    options: dict = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        if self.kind == "parquet":
            return spark.read.parquet(self.path).select(*self.features, self.label)
        options = dict(self.options)
        target, skip = options.pop("target", -1), options.pop("skip", None)
        return labelled(read_cells(spark, self.path, **options), target, skip).drop("row_id")


def load_all(spark: SparkSession, catalog: dict[str, Dataset], keys: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Frames by key, and messages of those that couldn't be loaded."""
    frames, errors = {}, {}
    for key in keys or list(catalog):
        try:
            frames[key] = catalog[key].load(spark)
        except Exception as error:  # the caller gets it beside the frames
            errors[key] = str(error)[:200]
    return frames, errors


def summary(frames: dict[str, DataFrame], catalog: dict[str, Dataset]) -> DataFrame:
    """(dataset, n_rows, n_features, n_classes, n_missing)."""
    from tabmine.operators.profile import overview

    out = None
    for key, frame in frames.items():
        row = overview(frame, catalog[key].features, catalog[key].label).select(F.lit(key).alias("dataset"), "*")
        out = row if out is None else out.unionByName(row)
    return out
