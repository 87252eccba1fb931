"""SimHash near-duplicate groups over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, written
from .components import connected_components
from .hamming import linked

#: Words of one shingle, seed of XXH64, differing bits that still link.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Shingles hashed before their bits are counted, a bound on memory for very long texts.
BATCH = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 without words.

    Words are split at ASCII white space after lower-casing A-Z; a text of fewer
    words than a shingle counts as one shingle.
    """
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BATCH):
        part = words[at : min(at + BATCH, n) + shingle - 1]
        runs = zip(*[part[k:] for k in range(shingle)], strict=False) if len(part) >= shingle else [part]
        h = np.fromiter((digest(x, SEED) for x in map(b" ".join, runs)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long, the 64 bits as a signed number), a row for each row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable.  Equal fingerprints are one class, whose links
    are searched once.  Null or empty texts and texts of white space have fingerprint zero
    and link like any other.  A row without doc_id takes part but never names a component
    (null if no member has an id).  Rows that repeat a doc_id each give a row.  Other columns are ignored.  Empty in, empty out.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    parts = connected_components(linked(classes.select("fp"), radius, whole=True)).withColumnRenamed("node", "fp")
    named = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(named.join(firsts, "component").select("fp", "component_id"), "named")
    # rows of one fingerprint may be a third of all: the join's large side is split by AQE
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows without doc_id stay.  All columns stay."""
    lost = near_duplicates(docs, radius, shingle).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti")
