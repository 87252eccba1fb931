"""Connected components by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum and an equi-join, so a node with very
many neighbours costs one combined row per task, and AQE splits the join's
side that holds its edges.  The rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
    low = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
    return both.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("r"))
    rest = e.join(low, "u").where("v <> r").select(F.col("v").alias("u"), F.col("r").alias("v"))
    return rest.unionAll(low.select("u", F.col("r").alias("v"))).distinct()


def _is_star(e: DataFrame) -> bool:
    """Each node points to one root, and no root points further."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b), any order, repeats and loops allowed -> (node, component), the component being its least node.

    Nodes without an edge to another node are absent; null ends are ignored.
    Any orderable type of node works.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    while not _is_star(e):
        last, e = e, written(_small_star(_large_star(e)), "star")
        remove(e.sparkSession, last)
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
