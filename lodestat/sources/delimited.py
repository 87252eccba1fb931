"""Delimited text with quoted line feeds, read in splits.

Spark reads lines in splits; whether a line begins inside a quoted field
depends on all quotes before it.  Each split tells, for both cases, whether it would end
inside one; put together in the order of the splits this gives the state at
each split's start.  A second pass joins lines to records in their tasks; a
record that crosses a border is finished by the next splits' first lines.  Files without such
records, which the first pass knows from all their lines, are read line by line.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import remove, written

#: Characters of border pieces up to which they are sent to all tasks; beyond, they are joined by a shuffle and the order of rows is not kept.
SENT = 64_000_000
#: The end of a quoted field: what is not a quote, or two of them, up to a single one.
_CLOSE = re.compile(r'(?:[^"]|"")*+"')
_STATES = "file string, block long, out_ends boolean, in_ends boolean, crosses boolean"


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field or outside of one ends inside."""
    at = 0
    while True:
        if inside:
            m = _CLOSE.match(line, at)
            if not m:
                return True
            at, inside = line.find(sep, m.end()), False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        else:
            at = line.find(sep + '"', at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the place where their split begins, in order within a split; a byte order mark is no text."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """Rows of a task as runs of one split each: ((file, block), rows) for each batch and run."""
    for batch in batches:
        columns = batch.to_pydict()
        rows = list(zip(*columns.values(), strict=True))
        start = 0
        keys = list(zip(columns["file"], columns["block"], strict=True))
        for k in range(1, len(rows) + 1):
            if k == len(rows) or keys[k] != keys[start]:
                yield keys[start], iter(rows[start:k])
                start = k


def _state(sep: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list[bool]] = {}
        for key, rows in _splits(batches):
            s = states.setdefault(key, [False, True, False])
            for line, *_ in rows:
                s[0], s[1] = ends_inside(line, sep, s[0]), ends_inside(line, sep, s[1])
                s[2] = s[2] or s[0]
        yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "out_ends": o, "in_ends": i, "crosses": c} for (f, b), (o, i, c) in states.items()], pa.schema([("file", pa.string()), ("block", pa.int64()), ("out_ends", pa.bool_()), ("in_ends", pa.bool_()), ("crosses", pa.bool_())]))

    return run


def _records(sep: str, begins_inside: set[tuple[str, int]]) -> Callable:
    """Lines to records: ``part`` is 0 for a whole record, 1 for one whose end is in later splits, 2 for such an end, 3 for a split all inside one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, head, out = None, [], False, False, []

        def close() -> None:
            if now is not None and held:
                out.append((*now, 3 if head else 1, "\n".join(held)))

        def flush() -> pa.RecordBatch:
            file, block, part, text = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(text, pa.string())], ["file", "block", "part", "text"])

        for key, rows in _splits(batches):
            if key != now:
                close()
                now, held, inside = key, [], key in begins_inside
                head = inside
            for line, *_ in rows:
                inside = ends_inside(line, sep, inside) if inside or '"' in line else False
                if inside:
                    held.append(line)
                elif held or head:
                    out.append((*now, 2 if head else 0, "\n".join([*held, line])))
                    held, head = [], False
                else:
                    out.append((*now, 0, line))
            yield flush()
            out = []
        close()
        yield flush()

    return run


def _stitched(parts: DataFrame) -> DataFrame:
    """(file, block, rest): the end of the record that a split leaves open, from the splits behind it."""
    order = Window.partitionBy("file").orderBy("block", F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    # an open record's end belongs to the last opening before it; a split gives its own end (2) before it opens another (1)
    owned = parts.withColumn("from", F.max(F.when(F.col("part") == 1, F.col("block"))).over(order)).where("part <> 1")
    pieces = F.sort_array(F.collect_list(F.struct("block", "text")))
    return owned.groupBy("file", F.col("from").alias("block")).agg(F.array_join(F.transform(pieces, lambda x: x.text), "\n").alias("rest"))


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text, named by the first record of the first file; each file begins with a header.

    Bytes are UTF-8 if all lines of all files are, else ISO-8859-1.  Blank records are skipped, a carriage
    return before a record's line feed is no text.  No file, or only empty ones, gives no columns.
    """
    lines = _lines(spark, path)
    plain = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("u"), F.max(F.col("value").contains('"')).alias("q")).first()
    if plain.u is None:
        return spark.createDataFrame([], T.StructType([]))
    text = F.col("value") if plain.u else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = lines.withColumn("value", text)
    inside: set[tuple[str, int]] = set()
    crosses = False
    if plain.q:
        # a row for each split, and a split without quotes ends as it begins
        found = lines.groupBy("file", "block").agg(F.max(F.col("value").contains('"')).alias("q"))
        states = {(r.file, r.block): r for r in lines.where(F.col("value").contains('"')).mapInArrow(_state(sep), _STATES).collect()}
        crosses = any(r.crosses for r in states.values())
        file, state = None, False
        for r in sorted(found.collect(), key=lambda r: (r.file, r.block)) if crosses else ():
            file, state = r.file, state and r.file == file
            if state:
                inside.add((r.file, r.block))
            if r.q:
                own = states[r.file, r.block]
                state = own.in_ends if state else own.out_ends
    if not crosses:
        rows = lines.select("file", "block", F.col("value").alias("text"))
    else:
        parts = lines.mapInArrow(_records(sep, inside), "file string, block long, part int, text string")
        rows = parts.where("part < 2")
        borders = written(parts.where("part > 0"), "borders")
        if inside:
            rest = written(_stitched(borders), "rest")
            small = rest.agg(F.coalesce(F.sum(F.length("rest")), F.lit(0))).first()[0] <= SENT
            rest = rest.withColumn("open", F.lit(1))
            joined = rows.withColumn("open", F.when(F.col("part") == 1, 1)).join(F.broadcast(rest) if small else rest, ["file", "block", "open"], "left")
            rows = joined.withColumn("text", F.when(F.col("rest").isNotNull(), F.concat("text", F.lit("\n"), "rest")).otherwise(F.col("text")))
        remove(spark, borders)
        rows = rows.select("file", "block", "text")
    rows = rows.withColumn("text", F.regexp_replace("text", r"\r$", "")).where("trim(text) <> ''")
    return _parsed(rows, sep)


def _parsed(rows: DataFrame, sep: str) -> DataFrame:
    """The fields of records; the first record of each file is its header."""
    spark = rows.sparkSession
    # a record's place in its task's order tells the first of a file, whatever it holds
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    begins = written(numbered.where("block = 0").groupBy("file").agg(F.min_by(F.struct("_n", "text"), "_n").alias("r")).select("file", "r.*"), "headers")
    first = begins.orderBy("file").limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    names = next(csv.reader(io.StringIO(first[0].text.removeprefix("\ufeff")), delimiter=sep))
    # a number for each file is sent to all tasks: Spark's own list of files is larger
    body = numbered.join(F.broadcast(begins.select("_n")), "_n", "left_anti")
    fields = [f"c{k}" for k in range(len(names))]
    parsed = body.select(F.from_csv("text", F.lit(", ".join(f"{c} string" for c in fields)), {"sep": sep, "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select(*[f"r.{c}" for c in fields]).toDF(*names)
