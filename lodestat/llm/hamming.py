"""All pairs of 64-bit fingerprints within a small Hamming radius.

Fingerprints meet in pigeonhole groups (two that differ in at most ``radius``
bits agree on one of ``radius + 1`` blocks).  Inside the groups a Gray-order
hierarchical index is searched.  A group above ``GROUP`` members is split on
blocks of its free bits, and what is still larger on pairs of chunks, so no
task holds a whole hot group and no pair is lost.  Groups give spanning forests, not all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_buckets, written

#: Members up to which one pigeonhole group is searched whole.
GROUP = 4096
#: Rows of one bucket of groups, the unit that one Python call gets.
BUCKET = 40_000
#: Rows of a bucket that is searched by one index: the nodes a query visits grow with it.
INDEXED = 4_000
#: Children of a node of the index, queries searched together, and pairs of a query and a code that are in memory at once at worst.
FANOUT, QUERIES, FRONTIER = 8, 2048, 1_000_000


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    cut = [len(bits) * k // n for k in range(n + 1)]
    return [bits[cut[k] : cut[k + 1]] for k in range(n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def block_mask(k: int, n: int) -> int:
    """Bits of the k-th of n blocks of a fingerprint, as a signed number."""
    return _mask(_blocks(list(range(64)), n)[k])


def grouped(fps: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """Distinct fingerprints (fp long) -> (fp, gid, b): fingerprints within ``radius`` share a gid for every block b they agree on.

    gid is a 64-bit hash of the group's key; a chance collision only merges two
    groups, which adds comparisons and changes no result.
    """
    spark = fps.sparkSession
    first = _blocks(list(range(64)), radius + 1)
    level = written(fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("b"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_mask(bits)))).alias("gid")) for k, bits in enumerate(first)])).alias("x")).select("fp", "x.b", "x.gid"), "blocks")
    hot = written(level.groupBy("gid").count().where(F.col("count") > group), "hot")
    if hot.isEmpty():
        return level.select("fp", "gid", "b")
    cold = level.join(hot, "gid", "left_anti").select("fp", "gid", "b")
    split = level.join(hot, "gid").drop("count")
    parts = [[F.struct(F.xxhash64("gid", F.lit(j), F.col("fp").bitwiseAND(F.lit(_mask(sub)))).alias("gid")) for j, sub in enumerate(_blocks([x for x in range(64) if x not in bits], radius + 1))] for bits in first]
    chosen = F.array(*parts[0])
    for k in range(1, len(parts)):
        chosen = F.when(F.col("b") == k, F.array(*parts[k])).otherwise(chosen)
    split = written(split.select("fp", "b", F.explode(chosen).alias("x")).select("fp", "x.gid", "b"), "split")
    large = written(split.groupBy("gid").count().where(F.col("count") > group), "hot")
    if large.isEmpty():
        return cold.unionAll(split)
    fine = split.join(large, "gid", "left_anti")
    chunks = F.ceil(F.col("count") * 2 / group).cast("int")
    mine = split.join(large, "gid").withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
    paired = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("fp", F.xxhash64("gid", F.least("c", "o"), F.greatest("c", "o")).alias("gid"), "b")
    return cold.unionAll(fine.select("fp", "gid", "b")).unionAll(paired)


def bucketed(rows: DataFrame, n: int, per_bucket: int = BUCKET) -> DataFrame:
    """Adds ``bucket``, a number for whole groups of about ``per_bucket`` rows, of ``n`` rows in all."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("gid", F.lit(11)), F.lit(shuffle_buckets(rows.sparkSession, n, per_bucket))))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence (the prefix XOR of its bits)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over codes in Gray order.

    Neighbours in Gray order share long bit patterns.  Each node holds the bits
    that all codes below it share; a child keeps only what its parent does not
    already hold, so distances add up from the top and a whole group falls
    away once the sum passes the radius.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        value, mask = codes[self.order], np.full(len(codes), np.uint64(2**64 - 1))
        self.levels = [(value, mask)]
        while len(value) > FANOUT:
            at = np.arange(0, len(value), FANOUT)
            mask = np.bitwise_and.reduceat(mask & ~(value ^ np.repeat(value[at], np.diff(np.append(at, len(value))))), at)
            value = value[at] & mask
            self.levels.append((value, mask))
        self.rest = [m & ~np.repeat(up[1], FANOUT)[: len(m)] for (_, m), up in zip(self.levels, self.levels[1:], strict=False)] + [self.levels[-1][1]]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions of all pairs within ``radius``."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        far = np.zeros(len(q), np.uint8)
        for k in range(top, -1, -1):
            far = far + np.bitwise_count((queries[q] ^ self.levels[k][0][node]) & self.rest[k][node])
            keep = far <= radius
            q, node, far = q[keep], node[keep], far[keep]
            if k:
                below = len(self.levels[k - 1][0])
                q, far = np.repeat(q, FANOUT), np.repeat(far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                keep = node < below
                q, node, far = q[keep], node[keep], far[keep]
        return q, self.order[node]


def least_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Spread the least label over the links (i, j) until nothing changes.

    Labels are places whose label is themselves; all that has a label moves with it, so links of earlier calls need not be given again.
    """
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        # only labels change; whatever has one follows it, so that no link is lost that a lesser one overrides
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        if (new == label).all():
            return label
        while (new[new] != new).any():
            new = new[new]
        label = new


def pairs_within(gid: np.ndarray, codes: np.ndarray, radius: int, small: int = 96) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of pairs of one group within ``radius``; rows sorted by gid.

    Groups of up to ``small`` rows are compared by shifted arrays, larger ones through the index.
    """
    start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
    size = np.diff(np.append(start, len(gid)))
    left = np.repeat(np.where(size <= small, start + size, 0), size)  # one past the last row of a small group
    i = np.flatnonzero(left > np.arange(len(gid)) + 1)
    s = 1
    while len(i):
        near = i[np.bitwise_count(codes[i] ^ codes[i + s]) <= radius]
        if len(near):
            yield near, near + s
        s += 1
        i = i[i + s < left[i]]
    for at, n in zip(start[size > small], size[size > small], strict=True):
        own = codes[at : at + n]
        for q, c in index_pairs(own, radius):
            yield at + q, at + c


def index_pairs(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs within ``radius``, by searching one Gray-order index for all its codes."""
    index = GrayIndex(codes)
    # where all codes are near each other nothing is pruned, and each query meets each code
    step = max(16, min(QUERIES, FRONTIER // max(1, len(codes))))
    for k in range(0, len(codes), step):
        # queries in Gray order walk the same nodes
        own = index.order[k : k + step]
        q, c = index.within(codes[own], radius)
        keep = c > own[q]
        yield own[q[keep]], c[keep]


def linked(fps: DataFrame, radius: int = 3, group: int = GROUP, whole: bool = False) -> DataFrame:
    """Distinct fingerprints (fp long) -> edges (a, b) whose components are those of all links within ``radius``.

    ``whole`` searches one Gray-order index for each bucket of groups, else each group is searched by itself.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        if whole:  # one index over the bucket: links across its groups are links too
            code = np.unique(pdf["fp"].to_numpy().view(np.uint64))
            pairs = index_pairs(code, radius)
        else:
            pdf = pdf.sort_values("gid", kind="stable")
            code = pdf["fp"].to_numpy().view(np.uint64)
            pairs = pairs_within(pdf["gid"].to_numpy(), code, radius)
        label = np.arange(len(code))
        for i, j in pairs:
            if len(i):
                label = least_labels(label, i, j)
        at = np.flatnonzero(label != np.arange(len(code)))
        signed = code.view(np.int64)
        return pd.DataFrame({"a": signed[at], "b": signed[label[at]]})

    rows = written(grouped(fps, radius, group).drop("b"), "groups")
    n = rows.count()
    return bucketed(rows, n, INDEXED if whole else BUCKET).groupBy("bucket").applyInPandas(search, "a long, b long").distinct()
