"""Analyses stored beside a dataset: run, replayed on another version, modified, and told apart when they are stale.

A run's key is a hash of its version's content hash, the analysis and its parameters, so the
same question asked of the same data is answered from the log.  The
graph of versions and runs tells what a run depends on and whether newer
versions descend from its own.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame

from ..operators.columns import OperationError
from ..stats import run_analysis
from .versions import Dataset

LOG = "id int, key string, version int, fingerprint string, analysis_type string, parameters string, status string, result string, origin int, change string"


def run_key(fingerprint: str, analysis_type: str, parameters: str) -> str:
    return hashlib.sha256(f"{fingerprint}|{analysis_type}|{parameters}".encode()).hexdigest()


class Runs:
    """The analyses of a dataset, a row of a log each; a run is written once and never changed."""

    def __init__(self, data: Dataset):
        self.data, self.spark = data, data.spark

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.data.folder}/runs")

    def _rows(self) -> dict[int, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.data.folder}/runs")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        return {r.id: r for r in self.log().collect()}

    def run(self, version: int, analysis_type: str, origin: int | None = None, change: str = "run", **parameters: Any) -> int:
        """Run an analysis on a version and store its result; an equal run of equal content gives its result without reading rows."""
        versions = {r.version for r in self.data.log().select("version").collect()}
        if version not in versions:
            raise OperationError(f"no version {version}")
        rows, text = self._rows(), json.dumps(parameters, sort_keys=True, default=str)
        fingerprint = self.data.fingerprint(version)
        key = run_key(fingerprint, analysis_type, text)
        known = next((r for r in rows.values() if r.key == key), None)
        if known:
            status, result = known.status, known.result
        else:
            made = run_analysis(self.data.read(version), analysis_type, **parameters)
            status, result = made["status"], json.dumps(made, sort_keys=True, default=str)
        number = max(rows, default=0) + 1
        self.spark.createDataFrame([(number, key, version, fingerprint, analysis_type, text, status, result, origin, change)], LOG).coalesce(1).write.mode("append").json(f"{self.data.folder}/runs")
        return number

    def _one(self, run: int) -> Any:
        rows = self._rows()
        if run not in rows:
            raise OperationError(f"no run {run}")
        return rows[run]

    def result(self, run: int) -> dict[str, Any]:
        return json.loads(self._one(run).result)

    def replay(self, run: int, version: int | None = None) -> int:
        """The same analysis with the same parameters, on its own version or another."""
        r = self._one(run)
        return self.run(r.version if version is None else version, r.analysis_type, run, "replay", **json.loads(r.parameters))

    def modify(self, run: int, version: int | None = None, **parameters: Any) -> int:
        """The same analysis with other parameters; those that are not named stay."""
        r = self._one(run)
        return self.run(r.version if version is None else version, r.analysis_type, run, "modify", **json.loads(r.parameters) | parameters)

    def graph(self) -> list[tuple[str, str, str]]:
        """(from, to, by): versions to versions by operation, versions to runs, runs to runs by replay and modify."""
        out = [(f"v{r.parent}", f"v{r.version}", r.operation) for r in self.data.log().orderBy("version").collect() if r.parent is not None]
        for r in (rows := self._rows()) and [rows[k] for k in sorted(rows)]:
            out.append((f"v{r.version}", f"r{r.id}", r.analysis_type))
            if r.origin is not None:
                out.append((f"r{r.origin}", f"r{r.id}", r.change))
        return out

    def stale(self) -> list[int]:
        """Runs whose version has newer descendants on which the same analysis has not been run, or whose version's content is another now."""
        log = {r.version: r for r in self.data.log().collect()}
        rows = self._rows()

        def above(version: int | None) -> set[int]:
            out: set[int] = set()
            while version is not None:
                out.add(version)
                version = log[version].parent
            return out

        out = []
        for r in rows.values():
            newer = {v for v in log if v != r.version and r.version in above(v)}
            answered = {x.version for x in rows.values() if (x.analysis_type, x.parameters) == (r.analysis_type, r.parameters)}
            if newer and max(newer) not in answered or self.data.fingerprint(r.version) != r.fingerprint:
                out.append(r.id)
        return sorted(out)


__all__ = ["Runs", "run_key"]
