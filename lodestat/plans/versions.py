"""Immutable dataset versions: Parquet folders, a log of operations beside them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, columns, combine, filters, grouping, ordering
from ..operators.columns import POS, OperationError, public, with_position
from ..storage import remove

LOG = "version int, parent int, operation string, configuration string, rows long, columns int"
#: One-input operations by name; merge and append take a second version.
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "select_columns": columns.select_columns,
    "drop_columns": columns.drop_columns,
    "rename_columns": columns.rename_columns,
    "cast_types": columns.cast_types,
    "calculate_column": columns.calculate_column,
    "set_values": columns.set_values,
    "filter": filters.filter_rows,
    "drop_duplicates": cleaning.drop_duplicates,
    "drop_missing": cleaning.drop_missing,
    "fill_missing": cleaning.fill_missing,
    "sort": ordering.sort,
    "group_by": grouping.group_by,
}
SECOND: dict[str, Callable[..., DataFrame]] = {"merge": combine.merge, "append": combine.append}


class Dataset:
    """Versions of one dataset under a folder; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.warnings: list[str] = []  # of the operation run last

    def _path(self, version: int) -> str:
        return f"{self.folder}/versions/v{version}"

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.folder}/log")

    def _write(self, df: DataFrame, version: int, parent: int | None, operation: str, config: Mapping[str, Any]) -> int:
        """A version counts once the log names it: what a refused or interrupted run left under its number is overwritten."""
        df.write.mode("overwrite").parquet(self._path(version))
        saved = self.read(version)
        n = saved.count()
        if not n or not public(saved):
            remove(self.spark, saved)
            raise OperationError("the result holds no rows or no columns")
        row = [(version, parent, operation, json.dumps(config, sort_keys=True, default=str), n, len(public(saved)))]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return version

    def create(self, df: DataFrame) -> int:
        return self._write(with_position(df), 1, None, "upload", {})

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version))

    def apply(self, operation: str, source: int | None = None, other: DataFrame | None = None, **config: Any) -> int:
        """Run an operation on a version (default: the newest) and write the result as the next version."""
        rows = {r.version: r for r in self.log().collect()}
        source = max(rows) if source is None else source
        if source not in rows:
            raise OperationError(f"no version {source}")
        df, self.warnings = self.read(source), []
        if operation in OPERATIONS:
            out = OPERATIONS[operation](df, **config)
        elif operation in SECOND and other is not None:
            if operation == "merge":
                # the rows are predicted from the keys: what would give none, or too many, is not computed
                report = combine.merge_report(df, other, **{k: v for k, v in config.items() if k in ("how", "on", "left_on", "right_on", "most_rows")})
                self.warnings = report["warnings"]
                if not report["rows"]:
                    raise OperationError(f"the result holds no rows or no columns; {self.warnings[-1]}")
            out = SECOND[operation](df, other, **{k: v for k, v in config.items() if k != "most_rows"})
        else:
            raise OperationError(f"operations are {', '.join([*OPERATIONS, *SECOND])}; the last two take another table")
        # a new order or new rows get new positions, a range-partitioned sort keeps its order
        if operation in ("sort", "group_by", "merge", "append", "filter", "drop_duplicates", "drop_missing") or POS not in out.columns:
            out = with_position(out if operation in ("sort", "group_by") or POS not in out.columns else out.orderBy(POS))
        return self._write(out, max(rows) + 1, source, operation, config)

    def lineage(self, version: int) -> list[dict[str, Any]]:
        """The operations that led to a version, oldest first, with the change in rows and columns of each."""
        rows, out = {r.version: r for r in self.log().collect()}, []
        while version is not None:
            r = rows[version]
            up = rows.get(r.parent)
            out.append({"version": r.version, "operation": r.operation, "configuration": json.loads(r.configuration), "rows": r.rows, "rows_change": r.rows - up.rows if up else None, "columns_change": r.columns - up.columns if up else None})
            version = r.parent
        return out[::-1]

    def fingerprint(self, version: int) -> str:
        """A hash of how a version came about: of an upload, its rows in any order; else its operation and the hash it came from."""
        r = {x.version: x for x in self.log().collect()}[version]
        if r.parent is not None:
            text = f"{self.fingerprint(r.parent)}|{r.operation}|{r.configuration}"
        else:
            df = self.read(version)
            names = public(df)
            h = df.select(F.xxhash64(*[f"`{c}`" for c in names]).alias("h"))
            sums = h.agg(F.count("*"), F.sum(F.shiftrightunsigned("h", 32).cast("decimal(38,0)")), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)"))).first()
            text = json.dumps([names, [str(x) for x in sums]])
        return hashlib.sha256(text.encode()).hexdigest()

    def page(self, version: int, number: int, size: int) -> DataFrame:
        return ordering.page(self.read(version), number, size).orderBy(POS).drop(POS)

    def preview(self, version: int, limit: int = 20) -> DataFrame:
        return self.read(version).where(F.col(POS) < limit).orderBy(POS).drop(POS)
