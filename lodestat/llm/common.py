"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, remove, shared_folder, written

__all__ = ["ascii_lower", "id_remainder", "load", "new_folder", "remove", "shared_folder", "shuffle_buckets", "written"]

#: ASCII upper case to lower case, the only case folding that contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_remainder(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``: the fold that holds rows out of training (null: the empty text)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def shuffle_buckets(spark: SparkSession, rows: int, per_bucket: int) -> int:
    """Buckets for grouping ``rows``: enough for the session's partitions and for the memory of one task."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_bucket))
