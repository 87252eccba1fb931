"""Approximate nearest neighbours with a forest of sorted hash strings.

Vectors are dealt by id into slices of bounded size.  Each slice holds several
trees, each a sorted array of 64-bit hash strings (signs of random
projections).  A query descends in every tree to its longest matching prefix,
then all trees ascend together, one bit at a time, until the prefixes shared
hold enough candidates; these are ranked by exact distance, and the slices' best are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a slice and queries of a block, the units of one task.
SLICE, BLOCK = 8192, 4096
#: Trees, and candidates that end the ascent: a share of the slice's distinct vectors, and at least so many.
TREES, SHARE, LEAST = 16, 0.7, 256
SEED = 17


class Forest:
    """Sorted hash strings of distinct vectors, one array a tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.x, self.centre = x, x.mean(0)
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * 64))
        codes = self.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)
        self.square = np.einsum("ij,ij->i", x, x)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[tree, vector] hash strings, the first bit on top."""
        bits = ((x - self.centre) @ self.planes > 0).reshape(len(x), -1, 64)
        return np.packbits(bits, axis=2).view(">u8").reshape(len(x), -1).T.astype(np.uint64)

    def candidates(self, code: np.ndarray, least: int) -> np.ndarray:
        """Vectors that share the longest prefixes with a query's code in any tree, at least ``least`` of them."""
        depth = np.arange(64, -1, -1)
        low_bits = np.array([(1 << int(64 - d)) - 1 for d in depth], np.uint64)
        lo, hi = np.empty((2, len(code), len(depth)), np.int64)
        for t, c in enumerate(code):
            lo[t] = np.searchsorted(self.sorted[t], c & ~low_bits, "left")
            hi[t] = np.searchsorted(self.sorted[t], c | low_bits, "right")
        found = np.zeros(len(self.x), bool)
        # levels whose ranges cannot hold enough are ascended in one step
        for level in range(int(np.argmax((hi - lo).sum(0) >= least)), len(depth)):
            for t in range(len(code)):
                found[self.order[t, lo[t, level] : hi[t, level]]] = True
            if np.count_nonzero(found) >= least:
                break
        return np.flatnonzero(found)


def _usable(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _search(k: int, trees: int, share: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, ids = np.stack(left["v"].to_numpy()).astype(np.float64), left["vec_id"].to_numpy(np.int64)
        at = np.argsort(ids, kind="stable")
        x, inverse = np.unique(x[at], axis=0, return_inverse=True)
        inverse, ids = inverse.ravel(), ids[at]
        # of equal vectors the k + 1 smallest ids are all that a query's k nearest can hold, its own left out
        by = np.argsort(inverse, kind="stable")
        begin = np.searchsorted(inverse[by], np.arange(len(x)))
        end = np.minimum(np.append(begin[1:], len(ids)), begin + k + 1)
        forest = Forest(x, trees)
        q = np.stack(right["v"].to_numpy()).astype(np.float64)
        codes = forest.codes(q)
        least = min(len(x), max(LEAST, int(share * len(x)) + 1, k + 1))
        out = []
        for n, (own, v) in enumerate(zip(right["vec_id"], q, strict=True)):
            c = forest.candidates(codes[:, n], least)
            near = forest.square[c] - 2 * (x[c] @ v)
            if len(c) > 2 * k + 2:
                cut = np.partition(near, k + 1)[k + 1]
                c = c[near <= cut + 1e-9 * (abs(cut) + v @ v + 1)]
            score = np.sqrt(((x[c] - v) ** 2).sum(1))
            rows = [(s, i) for s, j in zip(score.tolist(), c, strict=True) for i in ids[by[begin[j] : end[j]]].tolist() if i != own]
            out += [(own, i, s) for s, i in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """The k nearest found for each row of (vec_id, embedding) that ``queries`` selects: query_id, rank, vec_id, score.

    Nearness is Euclidean distance in double precision, ties go to the smaller
    vec_id.  Vectors that are null, zero, empty or hold null or non-finite
    components, and rows without vec_id, take no part.  Vectors of another length are no candidates.  Rows
    that repeat a vec_id are candidates each, but never of a query of that
    vec_id, which is asked once, by the smallest of its vectors.  Fewer candidates than k give them all.  Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asked"))
    rows = rows.where("vec_id IS NOT NULL").where(_usable(F.col("v"))).withColumn("dim", F.size("v"))
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    slices, blocks = -(-n // SLICE) or 1, -(-asked // BLOCK) or 1
    # every query goes to every slice; slices meet the queries block by block
    data = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asks = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asks = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    by = ("dim", "slice", "block")
    found = data.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(_search(k, trees, share), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
