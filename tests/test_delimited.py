"""Delimited files read in many splits against Python's csv module."""

import csv
import io
import random

import pytest

from lodestat.sources import delimited
from lodestat.sources.readers import read


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _rows(rng, n, long=0):
    parts = ["a", "ü", '"', ",", "\n", " ", "x y", '""', "\r\n", "q,", "1"]
    rows = [[str(k), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), rng.choice(["plain", '5" pipe'[::1], "", "z"])] for k in range(n)]
    for k in range(long):
        rows[n // 2 + k][1] = "line, of \"text\"\n" * 6000  # over several splits
    return rows


def _write(path, rows, end="\n", encoding="utf-8", sep=","):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(["id", "text, or not", "kind"])
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


def _values(frame):
    return [tuple(x or "" for x in r) for r in frame.collect()]


@pytest.mark.parametrize("sent", [64_000_000, 0])
def test_quoted_line_feeds_in_many_files_and_splits(small_splits, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(delimited, "SENT", sent)
    rng, want = random.Random(7), []
    for k in range(3):
        rows = _rows(rng, 3000, long=2 * (k == 1))
        if k == 2:
            rows = [["0", "plain beginning", "x"]] * 9000 + rows  # the first quoted line feed lies beyond 64 KB
        _write(tmp_path / f"part{k}.csv", rows, end="\r\n" if k else "\n")
        want += [tuple(r) for r in rows]
    got = delimited.read_delimited(small_splits, str(tmp_path), ",")
    assert got.columns == ["id", "text, or not", "kind"]
    assert sorted(_values(got)) == sorted(want)
    if sent:
        assert delimited._lines(small_splits, str(tmp_path)).rdd.getNumPartitions() > 20
        ids = [r[0] for r in _values(delimited.read_delimited(small_splits, str(tmp_path / "part0.csv"), ","))]
        assert ids == [str(k) for k in range(3000)]  # in the order of the file


def test_quotes_inside_plain_fields_and_other_bytes(small_splits, tmp_path):
    path = tmp_path / "one.tsv"
    path.write_bytes("﻿a\tb\nx\t5\" pipe\n\n  \ny\t\"two\nlines\"\nz\tlast \"word\"".encode())
    got = read(small_splits, str(path))
    assert got.columns == ["a", "b"] and _values(got) == [("x", '5" pipe'), ("y", "two\nlines"), ("z", 'last "word"')]
    latin = tmp_path / "two.csv"
    latin.write_bytes(b"a,b\n" + b"1,plain\n" * 20_000 + "2,Straße\n".encode("latin-1"))  # not UTF-8, seen far behind the first bytes
    assert _values(read(small_splits, str(latin)).where("a = 2").select("b")) == [("Straße",)]
    (tmp_path / "none.csv").write_bytes(b"")
    assert read(small_splits, str(tmp_path / "none.csv")).columns == []
    (tmp_path / "head.csv").write_bytes(b"a,b\n")
    assert read(small_splits, str(tmp_path / "head.csv")).count() == 0


def test_states_of_lines():
    inside = lambda line, start: delimited.ends_inside(line, ",", start)
    assert inside('a,"b', False) and not inside('a,"b"', False) and not inside('a"b', False)
    assert inside('a,"b""', False) and not inside('b"",c",d', True)
    assert not inside('end",x', True) and inside('end","x', True) and inside('still ""', True) and inside("", True)
