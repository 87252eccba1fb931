"""Quantiles over ranges: exact for many values, ties, many groups and nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import cleaning, grouping, ranges

P = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def _check(spark, rows, by):
    frame = spark.createDataFrame(rows, ", ".join([*[f"{k} string" for k in by], "v double"])).repartition(5)
    got = {tuple(r[k] for k in by): (r.n, r.q) for r in ranges.quantiles(frame, P, by).collect()}
    groups = {}
    for *key, v in rows:
        if v is not None:
            groups.setdefault(tuple(key), []).append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k][0] == len(values)
        assert np.allclose(got[k][1], np.quantile(values, P), rtol=1e-12, atol=0), k


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_are_exact_for_groups_ties_and_nulls(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(ranges, "GROUPS", 1)
        monkeypatch.setattr(ranges, "RANKED", 0)
    rng = random.Random(2)
    rows = [(rng.choice("abc"), None if rng.random() < 0.3 else "x", rng.choice([rng.random(), 0.25, float(rng.randint(-3, 3)), None])) for _ in range(3000)]
    rows += [("one", "x", 5.0), ("none", "x", None), (None, None, 1.0), (None, None, 4.0)] + [("hot", "x", 7.0)] * 500
    _check(spark, rows, ["a", "b"])
    _check(spark, [(v,) for *_, v in rows], [])
    _check(spark, [], [])


def test_a_bracket_that_misses_is_made_wider(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 0)
    monkeypatch.setattr(ranges, "MARGIN", 0.0)
    monkeypatch.setattr(ranges, "ACCURACY", 3)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.gauss(0, 1)) for _ in range(2000)]
    _check(spark, rows, ["a"])
    _check(spark, [r[1:] for r in rows], [])
    monkeypatch.setattr(ranges, "GROUPS", 1)
    _check(spark, rows, ["a"])


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    # a permutation of 0 .. n - 1
    frame = spark.range(n, numPartitions=16).select(F.pmod(F.col("id") * 7_919_777, F.lit(n)).cast("double").alias("v"))
    r = ranges.quantiles(frame, [0.25, 0.5, 0.999]).first()
    assert r.n == n and r.q == pytest.approx([0.25 * (n - 1), 0.5 * (n - 1), 0.999 * (n - 1)], rel=1e-12)


def test_medians_of_groups_and_fills(spark):
    rows = [("a", 1.0, "3"), ("a", 2.0, None), ("a", 9.0, "5"), (None, 4.0, "x"), (None, None, "y"), ("b", None, None)]
    frame = spark.createDataFrame(rows, "g string, v double, t string")
    got = [tuple(r) for r in grouping.group_by(frame, ["g"], {"v": ["median", "count"], "__rows__": [], "t": ["median"]}).collect()]
    assert got == [("a", 2.0, 3, 3, 4.0), ("b", None, 0, 1, None), (None, 4.0, 1, 2, None)]
    assert [tuple(r) for r in grouping.group_by(frame, ["g"], {"v": "median"}).collect()] == [("a", 2.0), ("b", None), (None, 4.0)]
    filled = cleaning.fill_missing(frame, "median", ["v", "t"]).select("v", "t").collect()
    assert [r.v for r in filled] == [1.0, 2.0, 9.0, 4.0, 3.0, 3.0] and [r.t for r in filled] == ["3", None, "5", "x", "y", None]
