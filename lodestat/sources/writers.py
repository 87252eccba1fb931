"""Files out, and results as tables or as a page."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession

from ..operators.columns import POS, OperationError
from ..stats.result import Result, as_rows


def write(df: DataFrame, path: str, fmt: str = "parquet", single: bool = False) -> None:
    """csv, tsv, txt, json or parquet; ``single`` makes one file of a result that is known to be small."""
    out = df.drop(POS)
    out = (out.coalesce(1) if single else out).write
    if fmt in ("csv", "tsv", "txt"):
        out.option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)
    elif fmt in ("json", "parquet"):
        getattr(out, fmt)(path)
    else:
        raise OperationError("formats are csv, tsv, txt, json, parquet")


def flatten_analysis(spark: SparkSession, r: Result) -> DataFrame:
    return spark.createDataFrame(as_rows(r), "section string, key string, value string")


def html_report(title: str, results: list[Result]) -> str:
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for r in results:
        rows = "".join(f"<tr><td>{escape(s)}</td><td>{escape(k)}</td><td>{escape(v or '')}</td></tr>" for s, k, v in as_rows(r))
        parts.append(f"<h2>{escape(r['analysis_type'])}</h2><table><tr><th>section</th><th>key</th><th>value</th></tr>{rows}</table>")
    return "".join([*parts, "</body></html>"])
