"""Importance resampling towards a target corpus over bucket-partitioned inverted postings.

Features are runs of words, hashed into buckets.  Tasks read chunks of
documents and write postings (bucket, document, count), in blocks that hold
a chunk's postings for one range of buckets, sorted by bucket.  The counts of both corpora
meet bucket by bucket, which gives each bucket's gain; the gains of a range go to the
posting blocks of that range, each block gives contributions to its documents, and these are
added up by document.  Scores add seeded Gumbel noise, so that the highest are a
sample without replacement.  Ranks are counted by ranges of the scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, remove, written

BUCKETS, RUNS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Ranges of buckets that postings are dealt by, and parts of each range.
RANGES, SALTS = 16, 16
#: Characters of text whose postings are sorted together; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Features of which a worker remembers the bucket.
REMEMBERED = 1_000_000

#: A word: all but ASCII signs, blanks and (after lower-casing) capitals.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLOCKS = pa.list_(pa.struct([("range", pa.int32()), ("bucket", pa.binary()), ("doc", pa.binary()), ("count", pa.binary())]))
_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("blocks", _BLOCKS)])
_CHUNK_DDL = "chunk long, doc_id array<long>, n_words array<long>, n_features array<long>, blocks array<struct<range: int, bucket: binary, doc: binary, count: binary>>"


class _Buckets(dict):
    """Bucket of a feature, worked out once."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes, runs: int) -> tuple[int, list[bytes]]:
    """Words of a lower-cased text, and all runs of 1 to ``runs`` of them."""
    words = _WORD.findall(text)
    return len(words), words + [b" ".join(words[i : i + r]) for r in range(2, runs + 1) for i in range(len(words) - r + 1)]


def _postings(buckets: int, runs: int, ranges: int) -> Callable:
    width = -(-buckets // ranges)

    def chunk(number: int, ids: list, counts: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(x) for x in found]
        # sorted by bucket, then document
        mixed, count = np.unique(np.concatenate(found) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
        bucket, doc = np.divmod(mixed, len(ids))
        cuts = np.searchsorted(bucket, np.arange(ranges + 1) * width)
        blocks = [{"range": r, "bucket": bucket[b:e].astype("<u4").tobytes(), "doc": doc[b:e].astype("<u4").tobytes(), "count": count[b:e].astype("<u4").tobytes()} for r, (b, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > b]
        return pa.RecordBatch.from_pylist([{"chunk": number, "doc_id": ids, "n_words": counts, "n_features": sizes, "blocks": blocks}], _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 32, _Buckets(buckets)
        ids: list = []
        counts: list[int] = []
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").encode().translate(ASCII_LOWER)
                if ids and size + len(text) > CHUNK:
                    yield chunk(number, ids, counts, found)
                    number, ids, counts, found, size = number + 1, [], [], [], 0
                words, runs_of = features(text, runs)
                ids.append(doc_id)
                counts.append(words)
                found.append(np.fromiter(map(known.__getitem__, runs_of), np.int64, len(runs_of)))
                size += len(text)
        if ids:
            yield chunk(number, ids, counts, found)

    return run


def postings(docs: DataFrame, id_column: str, buckets: int = BUCKETS, runs: int = RUNS, ranges: int = RANGES) -> DataFrame:
    """A row for each chunk of documents: ids, numbers of words and features, and blocks of postings by range of buckets."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_postings(buckets, runs, ranges), _CHUNK_DDL)


def _blocks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.explode("blocks").alias("b")).select("chunk", "b.*")


def _block_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bucket, at = np.unique(np.frombuffer(row["bucket"], "<u4"), return_inverse=True)
            n = np.bincount(at, weights=np.frombuffer(row["count"], "<u4"), minlength=len(bucket)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n)], ["bucket", "n"])


def totals(chunks: DataFrame) -> DataFrame:
    """(bucket, n): occurrences of each bucket's features in a corpus."""
    per_block = _blocks(chunks).select("bucket", "count").mapInArrow(_block_totals, "bucket long, n long")
    return per_block.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a thousand times the log ratio of smoothed frequencies, of both corpora's (bucket, n), rounded down."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(target.select("bucket", F.lit(0).cast("long"), "n"))
    each = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "gains")
    all_s, all_t = each.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1) * F.lit(float(all_s + buckets)) / ((F.col("s") + 1) * F.lit(float(all_t + buckets)))
    return each.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            known = {g["bucket"]: g["gain"] for g in row["gains"]}
            bucket, at = np.unique(np.frombuffer(row["bucket"], "<u4"), return_inverse=True)
            gain = np.array([known[b] for b in bucket.tolist()], np.int64)[at] * np.frombuffer(row["count"], "<u4")
            doc = np.frombuffer(row["doc"], "<u4")
            total = np.zeros(int(doc.max()) + 1, np.int64)
            np.add.at(total, doc, gain)
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["chunk", "part"])


def _weights(chunks: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in chunks.itertuples():
        total, n = np.zeros(len(row.n_features), np.int64), np.asarray(row.n_features, np.int64)
        for part in parts["part"]:
            part = np.frombuffer(part, np.int64)
            total[: len(part)] += part
        ids = pd.array([None if x is None or x != x else int(x) for x in row.doc_id], "Int64")
        out.append(pd.DataFrame({"doc_id": ids, "n_words": np.asarray(row.n_words, np.int64), "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("doc_id", "n_words", "n_features", "weight")})


def weights(docs: DataFrame, target: DataFrame, target_id: str = "item_id", buckets: int = BUCKETS, runs: int = RUNS, ranges: int = RANGES) -> DataFrame:
    """doc_id, n_words, n_features and weight, the mean gain of a document's features rounded down (none: 0)."""
    width = -(-buckets // ranges)
    chunks = written(postings(docs, "doc_id", buckets, runs, ranges), "postings")
    found = gains(totals(chunks), totals(postings(target, target_id, buckets, runs, ranges)), buckets)
    # a range has at most ``width`` gains; its copies meet the parts of its posting blocks
    ranged = found.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.collect_list(F.struct("bucket", "gain")).alias("gains"))
    ranged = ranged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = _blocks(chunks).withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int"))
    parts = blocks.join(ranged, ["range", "salt"]).select("chunk", "bucket", "doc", "count", "gains").mapInArrow(_contributions, "chunk long, part binary")
    ids = chunks.select("chunk", "doc_id", "n_words", "n_features")
    out = ids.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInPandas(lambda l, r: _weights(l, r), "doc_id long, n_words long, n_features long, weight long")
    out = written(out, "weights")
    remove(docs.sparkSession, chunks)
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from a hash of its id (null: the empty text)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(F.log(-F.log(u)) * -1000)


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """Draw floor(``percent`` N / 100) of the N documents with ``least_words`` words and more, likelier the closer they are to ``target``.

    Gives every document's doc_id, n_features, weight, score (weight plus noise) and rank: 1, 2, 3... by
    descending score, ties to the smaller doc_id (null: last), null if it is not drawn.  Null and empty texts have
    no features and weight 0; rows that repeat are returned each and may be drawn each; an empty target leaves all gains to
    the smoothing; no documents give no rows.  Other columns are ignored.
    """
    scored = weights(docs, target, target_id, buckets, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("_enough", F.col("n_words") >= least_words)
    order = [F.col("_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    ranged = written(scored.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    n = ranged.where("_enough").count()
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")
    placed = ranged.join(F.broadcast(before), "_p").withColumn("_place", place)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") <= percent * n // 100, F.col("_place")).cast("long").alias("rank"))
