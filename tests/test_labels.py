"""Statistics cover all values, however few a table shows."""

from lodestat.stats import association, run_analysis


def test_statistics_cover_values_beyond_the_table(spark, monkeypatch):
    df = spark.createDataFrame([(k % 7, k % 5, k % 3, 1.0 + k % 2, k, 1) for k in range(40)], "a int, b int, c int, w double, t int, e int")
    calls = [("chi_square_gof", {"column": "a"}), ("chi_square_gof", {"column": "a", "expected": [1, 2, 3, 4, 5, 6, 7]}), ("weighted_frequencies", {"column": "a", "weight_column": "w"}), ("likert_analysis", {"items": ["a", "b"], "reversed_items": ["b"]}), ("fleiss_kappa", {"columns": ["a", "b", "c"]}), ("kaplan_meier", {"time_column": "t", "event_column": "e"})]
    whole = [run_analysis(df, name, **p) for name, p in calls]
    monkeypatch.setattr(association, "MOST_LABELS", 2)
    for (name, p), want in zip(calls, whole, strict=True):
        got = run_analysis(df, name, **p)
        assert (got["test"], got["estimate"], got["effect_size"], got["sample_size"]) == (want["test"], want["estimate"], want["effect_size"], want["sample_size"]), name
        for table, rows in want["tables"].items():
            assert got["tables"][table] == (rows if table == "items" else rows[:2]), (name, table)
        assert not want["warnings"] and "leaves out" in got["warnings"][0]
