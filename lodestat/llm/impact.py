"""Exact top-k by inner product, score at a time over an impact-ordered index.

Components become integers.  Vectors are dealt by id into slices; a slice's
index holds, for each component, its vectors in order of their value, in segments
of one quantised impact.  A query reads the segments of all components by
descending impact, that is by how much they may add above the least that their
component can give, and sums for each vector what is certain.  It stops only
when the sums prove that few vectors can still be members; these are scored exactly.
Where nothing is proved before, all segments are read, and whatever quantising leaves open is scored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Vectors of a slice and queries of a block, the units of one task.
SLICE, BLOCK = 8192, 512
#: Levels of quantised impact: segments of a component's posting list.
LEVELS = 256
#: Steps of the impact down to which segments are read before the proof is tried again.
ROUNDS = 12
#: A query stops when at most this many vectors of a slice can be members.
STOP = 1024

_INDEX = "dim int, slice int, vectors binary, order binary, ids binary, of binary"


class Found(NamedTuple):
    vectors: np.ndarray
    postings: int


class ImpactIndex:
    """Posting lists of distinct integer vectors, one a component, in segments of equal width."""

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None, levels: int = LEVELS):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").astype("<i4").T.copy() if order is None else order
        self.low, self.high = x.min(0), x.max(0)
        self.width = -(-(self.high - self.low + 1) // levels)
        # of each segment the least and greatest value that it may hold, and where its postings begin
        self.least = self.low[:, None] + self.width[:, None] * np.arange(levels)
        self.greatest = np.minimum(self.least + self.width[:, None] - 1, self.high[:, None])
        level = (x - self.low) // self.width
        sizes = np.stack([np.bincount(level[:, d], minlength=levels) for d in range(x.shape[1])])
        self.sizes, self.begin = sizes, np.concatenate([np.zeros((len(sizes), 1), np.int64), np.cumsum(sizes, 1)], 1)

    def possible(self, q: np.ndarray, k: int, eligible: np.ndarray, stop: int, rounds: int = ROUNDS) -> Found:
        """All eligible vectors that may be among the ``k`` of greatest inner product with ``q``, ties included."""
        n, dim = self.x.shape
        if np.count_nonzero(eligible) <= max(k, stop):
            return Found(np.flatnonzero(eligible), 0)
        floor = np.minimum(q * self.low, q * self.high)
        ends = [q[:, None] * edge - floor[:, None] for edge in (self.least, self.greatest)]
        sure, most = np.minimum(*ends), np.maximum(*ends)
        slack = int((np.abs(q) * (self.width - 1)).sum())
        # sum and number of the postings of a vector go into one double, exact below 2^53
        bits = dim.bit_length()
        packed = int(most.max(1).sum() + 1) << bits < 1 << 53
        adds = ((sure << bits) + 1).astype(np.float64) if packed else sure
        total, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        up, levels, rows = q > 0, most.shape[1], np.arange(dim)
        done = np.where(up, levels, 0)
        top, found, postings, certain = int(most.max()), eligible, 0, None
        for r in range(1, rounds + 1):
            impact = top * (rounds - r) // rounds if r < rounds else -1
            # segments above the impact lie at one end of each component's list
            above = (most > impact).sum(1)
            upto = np.where(up, levels - above, above)
            parts = [(d, *sorted((done[d], upto[d]))) for d in rows if done[d] != upto[d]]
            done = upto
            if parts:
                ids = np.concatenate([self.order[d, self.begin[d, b] : self.begin[d, e]] for d, b, e in parts])
                each = np.concatenate([np.repeat(adds[d, b:e], self.sizes[d, b:e]) for d, b, e in parts])
                if packed:
                    both = np.bincount(ids, weights=each, minlength=n).astype(np.int64)
                    total, seen = total + (both >> bits), seen + (both & (1 << bits) - 1)
                else:
                    np.add.at(total, ids, each)
                    np.add.at(seen, ids, 1)
                postings += len(ids)
            # the k best sums so far belong to vectors whose exact scores no member falls below
            sums = total if eligible.all() else np.where(eligible, total, -1)
            best = np.argpartition(sums, n - k)[n - k :]
            proof = int((self.x[best] @ q).min() - floor.sum())
            certain = proof if certain is None else max(certain, proof)
            # what any vector may have at most: unread components give the impact or less
            found = eligible & (total + slack + (dim - seen) * max(impact, 0) >= certain)
            if np.count_nonzero(found) <= stop:
                break
        return Found(np.flatnonzero(found), postings)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["vec_id"].to_numpy(np.int64)
    at = np.argsort(ids, kind="stable")
    x = np.stack(rows["v"].to_numpy()).astype("<i8").reshape(len(rows), -1)[at]
    if x.shape[1]:
        x, of = np.unique(x, axis=0, return_inverse=True)
        order = ImpactIndex(x).order
    else:
        x, of, order = x[:1], np.zeros(len(ids), np.int64), np.zeros((0, 1), "<i4")
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "slice": rows["slice"].iloc[:1], "vectors": [x.tobytes()], "order": [order.tobytes()], "ids": [ids[at].astype("<i8").tobytes()], "of": [of.ravel().astype("<i4").tobytes()]})


def index(vectors: DataFrame, slices: int) -> DataFrame:
    """The index of rows (dim, vec_id, v): a row for each slice of vectors of one length."""
    dealt = vectors.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    return dealt.select("dim", "slice", "vec_id", "v").groupBy("dim", "slice").applyInPandas(_build, _INDEX)


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            row = left.iloc[0]
            dim = int(row["dim"])
            ids, of = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["of"], "<i4")
            x = np.frombuffer(row["vectors"], "<i8").reshape(int(of.max()) + 1, dim)
            by = np.argsort(of, kind="stable")
            ids = ids[by]  # of one vector together, ascending
            first = np.searchsorted(of[by], np.arange(len(x) + 1))
            q = np.stack(right["v"].to_numpy()).astype(np.int64).reshape(len(right), dim)
            largest = [max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0 for y in (x, q)]
            if 2 * dim * largest[0] * largest[1] >= 1 << 63:
                raise ValueError("inner products of these vectors do not fit in 64 bits")
            lists = ImpactIndex(x, np.frombuffer(row["order"], "<i4").reshape(dim, len(x))) if dim else None
            for own, v in zip(right["vec_id"].tolist(), q, strict=True):
                eligible = (ids[first[:-1]] != own) | (ids[first[1:] - 1] != own)
                found = lists.possible(v, k, eligible, max(STOP, k)) if lists else Found(np.flatnonzero(eligible), 0)
                score = x[found.vectors] @ v
                if len(score) > k:
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = Found(found.vectors[keep], found.postings), score[keep]
                members = []
                for j, s in zip(found.vectors.tolist(), score.tolist(), strict=True):
                    same = ids[first[j] : first[j + 1]]
                    members += [(-s, i) for i in same[same != own][:k].tolist()]
                out += [(own, i, -s, found.postings) for s, i in sorted(members)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "postings"]).astype("int64")

    return run


def _usable(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """The k greatest integer inner products for each row of (vec_id, embedding) that ``queries`` selects: query_id, rank, vec_id, score.

    Components x become floor(``scale`` * x).  The result is exact; ties go to the smaller
    vec_id.  Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; zero
    vectors do, and vectors of other lengths are no candidates.  Rows that repeat a vec_id are candidates each, but
    never of a query of that vec_id, which is asked once, by the smallest of its vectors.  Fewer candidates than k
    give them all.  Products beyond 64 bits are an error.  Other columns are ignored.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding").cast("array<double>")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), queries.alias("asked")).withColumn("dim", F.size("v"))
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    slices, blocks = -(-n // SLICE) or 1, -(-asked // BLOCK) or 1
    lists = written(index(rows, slices), "impact").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asks = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    by = ("dim", "slice", "block")
    found = lists.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(_search(k), "query_id long, vec_id long, score long, postings long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
