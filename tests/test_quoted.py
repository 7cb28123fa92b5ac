"""Delimited text with line ends in quotes, read in many small splits, against csv.reader."""

import csv
import io
import random

import pytest

from tabmine.sources import delimited, quoted


def _plain(text, delimiter=","):
    """Non-blank records as csv.reader has them, trimmed."""
    rows, blank = [], []
    for row in csv.reader(io.StringIO(text, newline=None), delimiter=delimiter):
        rows.append(tuple(c.strip() or None for c in row))
        blank.append(not row or all(not c.strip() for c in row) and len(row) == 1)
    return [r for r, b in zip(rows, blank, strict=True) if not b]


@pytest.fixture
def splits(spark):
    """Sets the size of splits; back to the default afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def to(size):
        for name in names:
            spark.conf.set(name, size)

    yield to
    for name in names:
        spark.conf.unset(name)


def test_ends_inside_as_the_parser_has_it():
    draw = random.Random(1)
    for _ in range(5000):
        text = "".join(draw.choice(['"', '"', ",", "a", " ", '""']) for _ in range(draw.randrange(9)))
        for inside in (False, True):
            whole = ('"x\n' if inside else "") + text + "\n" + "END,1\n"  # an open field swallows the next line
            closed = next(reversed(list(csv.reader(io.StringIO(whole)))), []) == ["END", "1"]
            assert quoted.ends_inside(text, ",", inside) != closed, (text, inside)


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_quoted_line_ends_in_any_split(spark, splits, tmp_path, size):
    draw = random.Random(size)
    field = lambda: draw.choice(["1", "2.5", "x", "", 'a "stray" quote', '"two\nlines"', '"three\n\nlines, with ""quotes"""', '" sp\n"', f'"{"long " * 12}\n{"text " * 9}"', "é"])
    text = "\n".join(draw.choice(["", "  "]) if draw.random() < 0.05 else ",".join(["r" + str(k), field(), field(), "end"]) for k in range(300))
    (tmp_path / "f.csv").write_text(text)
    splits(size)
    got = quoted.read_records(spark, str(tmp_path / "f.csv"), ",", False)
    assert size > 10_000 or got.rdd.getNumPartitions() > 4
    assert sorted(tuple(r.cells) for r in got.collect()) == sorted(_plain(text), key=lambda r: r[0])


@pytest.mark.parametrize("size", [8, 30, 100_000])
def test_header_by_place_and_rows_equal_to_it(spark, splits, tmp_path, size):
    splits(size)
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,x\na,b,c\n3,4,y\n")
    out = delimited.read_cells(spark, str(tmp_path / "a.csv"), header=True)
    assert out.columns == ["a", "b", "c"]
    assert sorted(map(tuple, out.collect())) == [("1", "2", "x"), ("3", "4", "y"), ("a", "b", "c")]
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(f'# note "{k}\n# more\n\n"the\nname",v\n{k},"{k}\n{k}"\nthe name,v\n' + "\n" * k)
    out = delimited.read_cells(spark, str(folder), header=True, skip_rows=2)
    assert out.columns == ["the\nname", "v"]
    assert sorted(map(tuple, out.collect())) == sorted([x for k in range(3) for x in [(f"{k}", f"{k}\n{k}"), ("the name", "v")]])


def test_skipped_rows_beyond_the_first_split(spark, splits, tmp_path):
    lines = [f"skipped {k} of the lines" for k in range(12)] + ["a;b", *[f"{k};{k}" for k in range(20)]]
    (tmp_path / "s.txt").write_text("\n".join(lines))
    splits(50)
    out = delimited.read_cells(spark, str(tmp_path / "s.txt"), skip_rows=12)
    assert out.columns == ["a", "b"] and sorted(int(r.a) for r in out.collect()) == list(range(20))


def test_quotes_never_closed(spark, splits, tmp_path, monkeypatch):
    (tmp_path / "o.csv").write_text('a,b\n1,"open\n2,3\n4,5')
    splits(6)
    out = quoted.read_records(spark, str(tmp_path / "o.csv"), ",", True).collect()
    assert [tuple(r.cells) for r in out] == [("1", "open\n2,3\n4,5")]
    assert delimited.read_cells(spark, str(tmp_path / "o.csv"), header=True).columns == ["a", "b"]


def test_line_ends_of_other_systems_and_marks(spark, splits, tmp_path):
    (tmp_path / "w.csv").write_bytes('﻿a,b\r\n1,"x\r\ny"\r\n2,é\r\n'.encode())
    (tmp_path / "l.csv").write_bytes('a,b\n1,"ä\nö"\n'.encode("latin-1"))
    for size in (5, 1000):
        splits(size)
        out = delimited.read_cells(spark, str(tmp_path / "w.csv"), header=True)
        assert out.columns == ["a", "b"] and sorted(map(tuple, out.collect())) == [("1", "x\ny"), ("2", "é")]
        out = delimited.read_cells(spark, str(tmp_path / "l.csv"), header=True, encoding="ISO-8859-1")
        assert [tuple(r) for r in out.collect()] == [("1", "ä\nö")]


def test_first_file_with_only_a_header(spark, tmp_path):
    for k, rows in enumerate(["", "1|4|x\n2|5|y\n", "", "3|6|z\n"]):
        (tmp_path / f"part-{k}.csv").write_text("id|size|label\n" + rows)
    path = str(tmp_path)
    assert delimited.detect_header(delimited.head(spark, path), "|")
    got = delimited.read_cells(spark, path)
    assert got.columns == ["id", "size", "label"]
    assert sorted(map(tuple, got.collect())) == [("1", "4", "x"), ("2", "5", "y"), ("3", "6", "z")]
    for name in ("part-1.csv", "part-3.csv"):
        (tmp_path / name).write_text("id|size|label\n")
    assert delimited.head(spark, path) == ["id|size|label"]
