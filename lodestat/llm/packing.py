"""Packing into length buckets that cost the least padding.

The exact histogram of piece lengths, at most MAX_LENGTH numbers, goes to the
driver; dynamic programming over it places the bucket boundaries.  Inside each
bucket pieces are numbered in hash order, slice by slice, and cut into batches
of a token budget; no bucket, however full, meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Longest piece, buckets, and padded tokens of a batch.
MAX_LENGTH, BUCKETS, BUDGET = 2048, 12, 65_536
#: Pieces of one slice of a bucket, and the least number of slices.
SLICE, LEAST_SLICES = 50_000, 1024


def word_length(text: Column) -> Column:
    """Words between ASCII white space and one end token."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over ascending lengths with the least padding in all.

    The last bound is the largest length; of equal costs the one with the lower earlier bounds wins.
    """
    if not len(lengths):
        return []
    n = len(lengths)
    h, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    # cost[a, b]: padding of lengths a..b-1 put in one bucket of length lengths[b-1]
    upper = np.concatenate([[0], lengths])
    cost = upper[None, :] * (h[None, :] - h[:, None]) - (s[None, :] - s[:, None])
    cost[np.tril_indices(n + 1, -1)] = np.iinfo(np.int64).max // 4
    best, back = cost[0].copy(), []
    for _ in range(min(buckets, n) - 1):
        total = best[:, None] + cost
        back.append(total.argmin(0))
        best = total.min(0)
    at, out = n, []
    for choice in reversed(back):
        if at > 0:
            out.append(int(lengths[at - 1]))
            at = int(choice[at])
    if at > 0:
        out.append(int(lengths[at - 1]))
    return sorted(set(out))


def pack(docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, n_tokens, bucket (padded length), batch, place.

    A document longer than ``max_length`` is cut into full pieces and a rest, so
    that no token is lost; ``length`` (default: words and an end token) below 1 or null counts
    as 1, the end token.  batch numbers the batches of a bucket from 0, place
    the rows of a batch; a batch holds ``budget // bucket`` rows, at least one.
    Null doc_ids and repeated rows are packed like any other; other columns are ignored; empty in, empty out.
    """
    size = F.greatest(F.coalesce((word_length(F.col("text")) if length is None else length).cast("long"), F.lit(1)), F.lit(1))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    pieces = pieces.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / max_length))).alias("piece"))
    start = F.col("piece") * max_length
    pieces = written(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(max_length)).alias("n_tokens")), "pieces")

    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    bounds = boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    total = int(histogram["count"].sum())
    bucket = F.lit(max_length)
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    slices = max(LEAST_SLICES, -(-total // SLICE))
    h = F.xxhash64("doc_id", "piece", "n_tokens")
    rows = pieces.withColumn("bucket", bucket).withColumn("h", h).withColumn("slice", F.pmod("h", F.lit(slices)))
    counts = rows.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bucket", "slice", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("h", "doc_id", "piece")) - 1
    rows = rows.withColumn("own", own).join(offsets, ["bucket", "slice"]).withColumn("number", F.col("before") + F.col("own"))
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("long")
    return rows.select("doc_id", "piece", "start", "n_tokens", "bucket", F.floor(F.col("number") / capacity).alias("batch"), (F.col("number") % capacity).alias("place"))
