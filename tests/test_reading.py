"""Readings of results, notes on charts, tables of many cells."""

import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators.columns import OperationError
from lodestat.plans import charts
from lodestat.plans.interpret import FAMILIES, interpret
from lodestat.stats import ANALYSES, run_analysis
from lodestat.stats import association


def test_readings_rest_on_the_numbers(spark):
    df = spark.createDataFrame([(float(k + 9 * (k % 2)), "ab"[k % 2]) for k in range(14)], "v double, g string")
    r = run_analysis(df, "welch_t_test", checks=True, value_column="v", group_column="g")
    told = interpret(r)
    assert f"{r['test']['p_value']:.4g}" in told["summary"] and told["evidence"]["confidence_interval"] == r["confidence_interval"]
    assert any("14 rows" in x for x in told["limits"])
    few = interpret(run_analysis(df.limit(2), "pearson", x="v", y="v"))
    assert "did not succeed" in few["summary"] and few["evidence"]["status"] != "ok"
    plain = interpret(run_analysis(df, "descriptive", columns=["v"]))
    assert "no p-value" in plain["summary"] and plain["next_steps"][0].startswith("Choose")
    bad = interpret({"analysis_type": "pearson", "status": "ok", "sample_size": 99, "test": {"p_value": 0.2}, "assumptions": {"checks": [{"name": "Outliers", "status": "WARN", "detail": "x"}]}})
    assert bad["next_steps"] == ["Run spearman beside it."] and "not below" in bad["summary"]


def test_families_name_analyses():
    named = [n for f in FAMILIES.values() for n in f["of"]]
    assert len(named) == len(set(named))
    assert len(set(named) & set(ANALYSES)) > 35


def test_notes_and_descriptions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "x string, y double")
    panel = charts.build(df, "bar", "x", "y")["all"]
    notes = charts.placed(panel, [{"text": " top ", "x": "b", "y": 5}, {"text": "n" * 400, "x": "z"}])
    assert notes[0] == {"text": "top", "x": "b", "y": 5, "series": None, "value": 5.0}
    assert len(notes[1]["text"]) == charts.NOTE and notes[1]["value"] is None
    assert charts.annotations(None) == [] == charts.placed(panel, [])
    for wrong in ([{"text": "", "x": 1}], [{"text": "a"}], ["a"]):
        with pytest.raises(OperationError, match="note 1"):
            charts.annotations(wrong)
    assert charts.describe("bar", "x", "y", "mean", group_by="g", facet="f", filters=[{}]) == "bar: mean of y by x, for each g, in panels of f, filtered"
    assert charts.describe("heatmap", "x", group_by="g") == "heatmap: rows by x and g"
    assert charts.describe("scatter", "x", "y") == "scatter: y against x"


def test_a_table_of_many_cells_has_the_same_statistic(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice([None, *"abcdef"]), rng.choice("uvwxyz")) for _ in range(500)], "r string, c string")
    small = run_analysis(df, "chi_square", row_column="r", column_column="c")
    monkeypatch.setattr(association, "MOST_LABELS", 10)
    large = run_analysis(df, "chi_square", row_column="r", column_column="c")
    assert large["test"] == pytest.approx(small["test"], rel=1e-5)
    assert large["effect_size"]["cramers_v"] == pytest.approx(list(small["effect_size"].values())[0], rel=1e-4)
    assert large["diagnostics"]["least_expected"] == pytest.approx(small["diagnostics"]["least_expected"], rel=1e-5)


def test_many_groups_stay_in_spark(spark):
    df = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("g"), F.hash("id").cast("double").alias("v"))
    r = run_analysis(df, "kruskal_wallis", value_column="v", group_column="g")
    assert r["test"]["df"] == 999 and len(r["tables"]["groups"]) == 1000
