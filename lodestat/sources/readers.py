"""Files, databases and services as DataFrames, types inferred after reading as text."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import FALSY, TRUTHY, to_boolean, to_number, to_timestamp
from ..operators.columns import OperationError, public
from .delimited import read_delimited

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Bytes from which the delimiter of a text file is guessed.
SNIFFED = 65_536


def reader(*suffixes: str) -> Callable:
    def add(f: Callable) -> Callable:
        for s in suffixes:
            READERS[s] = f
        return f

    return add


def read(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """By suffix; column names are stripped, and repeated or blank ones made unique."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise OperationError(f"no reader for {suffix or path!r}; there are {', '.join(sorted(READERS))}")
    df = READERS[suffix](spark, path)
    df = df.toDF(*unique_names(df.columns))
    return infer_types(df) if infer and suffix in (".csv", ".tsv", ".txt") else df


def unique_names(names: list[str]) -> list[str]:
    seen: set[str] = set()
    out = []
    for k, n in enumerate(names):
        base = n.strip() or f"column_{k + 1}"
        name, i = base, 2
        while name.lower() in seen:
            name, i = f"{base}_{i}", i + 1
        seen.add(name.lower())
        out.append(name)
    return out


def head_bytes(spark: SparkSession, path: str, n: int = SNIFFED) -> bytes:
    """The first bytes of the first file, through Spark, so that any store it reads will do."""
    text = spark.read.text(path, wholetext=False).limit(50).collect()
    return "\n".join(r.value for r in text).encode()[:n]


@reader(".csv")
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ",")


@reader(".tsv")
def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "\t")


@reader(".txt")
def read_txt(spark: SparkSession, path: str) -> DataFrame:
    head = head_bytes(spark, path).decode("utf-8", "replace")
    try:
        sep = csv.Sniffer().sniff(head, delimiters=",\t;|").delimiter
    except csv.Error:
        sep = ","
    return read_delimited(spark, path, sep)


@reader(".json")
def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, a dictionary of columns, or a record on each line."""
    lines = [x for x in head_bytes(spark, path).decode("utf-8", "replace").splitlines() if x.strip()]
    if len(lines) > 1 and all(x.strip().startswith("{") and x.strip().endswith("}") for x in lines[:2]):
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    kinds = {f.dataType.typeName() for f in df.schema}
    if kinds == {"array"} and df.count() == 1:
        zipped = df.select(F.explode(F.arrays_zip(*[f"`{c}`" for c in df.columns])).alias("r"))
        return zipped.select(*[F.col("r").getField(f.name).alias(c) for f, c in zip(zipped.schema["r"].dataType, df.columns, strict=True)])
    return df


@reader(".parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _pandas(spark: SparkSession, frame: Any, labels: dict[str, str] | None = None, values: dict[str, dict] | None = None) -> DataFrame:
    """A single-machine format: one file that fits the driver; labels go to the fields' metadata."""
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None)) if len(frame) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in frame.columns))
    for c in df.columns:
        meta = {k: v for k, v in (("variable_label", (labels or {}).get(c)), ("value_labels", {str(a): b for a, b in (values or {}).get(c, {}).items()})) if v}
        if meta:
            df = df.withMetadata(c, meta)
    return df


@reader(".dta")
def read_stata(spark: SparkSession, path: str) -> DataFrame:
    """Codes stay in the data; words are metadata."""
    from pandas.io.stata import StataReader

    with StataReader(path) as r:
        frame = r.read(convert_categoricals=False)
        names = dict(zip(r._varlist, r._lbllist, strict=True)) if hasattr(r, "_lbllist") else {}
        sets = r.value_labels()
        return _pandas(spark, frame, r.variable_labels(), {c: sets[s] for c, s in names.items() if s in sets})


def _optional(module: str, what: str) -> Any:
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise OperationError(f"reading {what} needs the package {module}") from e


@reader(".sav", ".zsav", ".por")
def read_spss(spark: SparkSession, path: str) -> DataFrame:
    p = _optional("pyreadstat", "SPSS files")
    frame, meta = (p.read_por if path.endswith(".por") else p.read_sav)(path, apply_value_formats=False)
    return _pandas(spark, frame, meta.column_names_to_labels, meta.variable_value_labels)


@reader(".rds", ".rda", ".rdata")
def read_r(spark: SparkSession, path: str) -> DataFrame:
    """The largest data frame of the file."""
    frames = _optional("pyreadr", "R files").read_r(path)
    return _pandas(spark, max(frames.values(), key=lambda f: (f.size, len(f))))


@reader(".xlsx")
def read_excel(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    _optional("openpyxl", "Excel files")
    return _pandas(spark, pd.read_excel(path))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become numbers, booleans or timestamps if all their values are: one aggregation for all columns."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name in public(df)]
    if not texts:
        return df
    parts = []
    for k, n in enumerate(texts):
        c = F.when(F.trim(F.col(f"`{n}`")) != "", F.trim(F.col(f"`{n}`")))
        number = to_number(c, df.schema[n].dataType)
        parts += [F.count(c).alias(f"n{k}"), F.count(number).alias(f"d{k}"), F.count_if(number != F.floor(number)).alias(f"f{k}"), F.count(F.when(F.length(c) <= 32, to_timestamp(c, df.schema[n].dataType))).alias(f"t{k}"), F.count(to_boolean(c)).alias(f"b{k}"), F.max(F.abs(number)).alias(f"m{k}")]
    r = df.agg(*parts).first()
    out = {}
    for k, n in enumerate(texts):
        c = F.when(F.trim(F.col(f"`{n}`")) != "", F.trim(F.col(f"`{n}`")))
        if not r[f"n{k}"]:
            out[n] = c
        elif r[f"d{k}"] == r[f"n{k}"]:
            number = to_number(c, df.schema[n].dataType)
            out[n] = number.cast("bigint") if not r[f"f{k}"] and r[f"m{k}"] < 2**53 else number
        elif r[f"b{k}"] == r[f"n{k}"]:
            out[n] = to_boolean(c)
        elif r[f"t{k}"] == r[f"n{k}"]:
            out[n] = to_timestamp(c, df.schema[n].dataType)
        else:
            out[n] = c
    return df.withColumns(out)


def is_boolean_word(value: str) -> bool:
    return value.strip().lower() in TRUTHY + FALSY


# Databases and services

FIELDS = {"postgres": ("host", "database", "user"), "mysql": ("host", "database", "user"), "rest": ("url",)}


def validate_config(kind: str, config: dict[str, Any]) -> None:
    if kind not in FIELDS:
        raise OperationError(f"sources are {', '.join(FIELDS)}")
    if lost := [f for f in FIELDS[kind] if not config.get(f)]:
        raise OperationError(f"missing: {', '.join(lost)}")
    if kind != "rest" and not (config.get("table") or config.get("query")):
        raise OperationError("a table or a query is needed")


def jdbc_options(kind: str, config: dict[str, Any], password: str) -> dict[str, str]:
    """Options of Spark's reader; partition_column with bounds splits the read over executors."""
    validate_config(kind, config)
    scheme, port = {"postgres": ("postgresql", 5432), "mysql": ("mysql", 3306)}[kind]
    out = {"url": f"jdbc:{scheme}://{config['host']}:{config.get('port', port)}/{config['database']}", "user": config["user"], "password": password}
    out |= {"query": config["query"]} if config.get("query") else {"dbtable": config["table"]}
    if config.get("partition_column") and "dbtable" in out:
        out |= {"partitionColumn": config["partition_column"], "lowerBound": str(config["lower_bound"]), "upperBound": str(config["upper_bound"]), "numPartitions": str(config.get("partitions", 16))}
    return out


def read_jdbc(spark: SparkSession, kind: str, config: dict[str, Any], password: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, config, password)).load()


def rows_of(payload: Any) -> list[dict]:
    """The records of a service's answer: a list, the only list of a dictionary, data / items / results, or one record."""
    if isinstance(payload, list):
        return [x if isinstance(x, dict) else {"value": x} for x in payload]
    if isinstance(payload, dict):
        lists = [v for v in payload.values() if isinstance(v, list)]
        for key in ("data", "items", "results"):
            if isinstance(payload.get(key), list):
                return rows_of(payload[key])
        return rows_of(lists[0]) if len(lists) == 1 else [payload]
    raise OperationError("the answer holds no records")


def read_rest(spark: SparkSession, config: dict[str, Any], fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """JSON records of one answer; ``fetch`` gets its bytes (default: urllib)."""
    validate_config("rest", config)
    if fetch is None:
        from urllib.request import urlopen

        def fetch(url: str) -> bytes:
            with urlopen(url, timeout=30) as answer:
                return answer.read()

    body = fetch(config["url"]).decode("utf-8")
    try:
        records = json.dumps(rows_of(json.loads(body)))
        # one answer of a service, which the driver holds already
        cell = spark.createDataFrame([(records,)], "value string")
        kind = spark.range(1).select(F.schema_of_json(F.lit(records))).first()[0]
        return cell.select(F.from_json("value", kind).alias("r")).select(F.inline("r")) if records != "[]" else spark.createDataFrame([], "value string")
    except json.JSONDecodeError:
        rows = list(csv.reader(body.splitlines()))
        names = unique_names(rows[0])
        return infer_types(spark.createDataFrame([tuple((r + [""] * len(names))[: len(names)]) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names)))


def fetch_frame(spark: SparkSession, kind: str, config: dict[str, Any], password: str = "", limit: int | None = None) -> DataFrame:
    df = read_rest(spark, config) if kind == "rest" else read_jdbc(spark, kind, config, password)
    return df.limit(limit) if limit else df
