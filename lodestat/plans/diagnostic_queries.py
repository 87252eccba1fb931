"""Diagnostics as registered queries: quantiles over ranges, merges foretold, curves, residuals, robust errors, stored runs, assumptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine, ranges
from ..operators.columns import POS, with_position
from ..stats import run_analysis
from ..stats.assumptions import pair_diagnostics
from ..storage import new_folder
from . import charts
from .analysis_queries import _double, at, solve
from .core_queries import labelled, rounded, t
from .registry import query
from .runs import Runs
from .versions import Dataset

_P = [0.01, 0.25, 0.5, 0.75, 0.99]


@query("quantiles_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{int(100 * p)}" for p in _P) + " FROM lineitem GROUP BY ALL")
def _(spark, d):
    q = ranges.quantiles(t(spark, d, "lineitem"), _P, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(q.select("l_returnflag", "l_linestatus", "n", *[F.col("q")[k].alias(f"q{int(100 * p)}") for k, p in enumerate(_P)]))


@query("quantiles_whole", "SELECT count(*) AS n, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 6)::DOUBLE AS q{int(100 * p)}" for p in _P) + " FROM documents")
def _(spark, d):
    q = ranges.quantiles(t(spark, d, "documents"), _P, (), "n_chars")
    return rounded(q.select("n", *[F.col("q")[k].alias(f"q{int(100 * p)}") for k, p in enumerate(_P)]))


@query(
    "merge_prediction",
    """WITH l AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_nationkey END AS k, count(*) AS l FROM customer GROUP BY 1), r AS (SELECT CASE WHEN s_suppkey % 10 > 0 THEN s_nationkey END AS k, count(*) AS r FROM supplier GROUP BY 1),
    b AS (SELECT coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k)
    SELECT sum(l)::BIGINT AS rows_left, sum(r)::BIGINT AS rows_right, sum(CASE WHEN r = 0 THEN l WHEN l = 0 THEN r ELSE l * r END)::BIGINT AS rows, count(*) FILTER (l > 0 AND r > 0) AS keys_shared, count(*) FILTER (r = 0) AS keys_left_only, count(*) FILTER (l = 0) AS keys_right_only, count(*) FILTER (l > 1 AND r > 1) AS keys_repeated, max(CASE WHEN r = 0 THEN l WHEN l = 0 THEN r ELSE l * r END)::BIGINT AS rows_of_largest_key FROM b""",
)
def _(spark, d):
    left = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 > 0, F.col("c_nationkey")).alias("k"))
    right = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 > 0, F.col("s_nationkey")).alias("k"))
    return combine.predict_merge(left, right, "outer", on=["k"])


_SCORED = "(SELECT d.n_chars::DOUBLE AS s, l.toxic::DOUBLE AS y FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL AND d.n_chars IS NOT NULL)"
_CURVE = f"p AS (SELECT s, sum(y) AS p, sum(1 - y) AS m FROM {_SCORED} GROUP BY s), u AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(m) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ps, sum(m) OVER () AS ms FROM p)"


@query("roc_curve", f"WITH {_CURVE} SELECT threshold, true_positives, false_positives, round(true_positives / ps, 6) AS tpr, round(false_positives / ms, 6) AS fpr FROM (SELECT arg_max(s, tp + fp) AS threshold, max(tp) AS true_positives, max(fp) AS false_positives, any_value(ps) AS ps, any_value(ms) AS ms FROM u GROUP BY ceil(fp * 200 / ms))")
def _(spark, d):
    scored = labelled(spark, d).select(F.col("n_chars").cast("double").alias("s"), F.col("toxic").cast("double").alias("y")).dropna()
    return rounded(ranges.roc_points(scored)[0])


@query("roc_area", f"WITH {_CURVE} SELECT round(sum(m * (tp - p / 2)) / any_value(ps * ms), 6) AS auc, any_value(ps) AS positives, any_value(ms) AS negatives FROM u")
def _(spark, d):
    scored = labelled(spark, d).select(F.col("n_chars").cast("double").alias("s"), F.col("toxic").cast("double").alias("y")).dropna()
    return rounded(ranges.roc_points(scored)[1])


@query(
    "moving_average",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, round((sum(v) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 3 - pos) * first(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + greatest(0, pos + 3 - n + 1) * last(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7, 4) AS smoothed FROM p""",
)
def _(spark, d):
    rows = with_position(t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"))
    return rounded(ranges.moving_average(rows, POS, "o_totalprice", 7, block=2000).select("o_orderkey", F.col("o_totalprice_moving").alias("smoothed")), 4)


_FIT = "f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*)::DOUBLE AS n FROM lineitem), e AS (SELECT l_suppkey, l_quantity AS x, a + b * l_quantity AS fit, l_extendedprice - a - b * l_quantity AS e, f.* EXCLUDE (b, a) FROM lineitem, f)"
_MOVES = solve([["n0", "n1", "n2"], ["n1", "n2", "n3"], ["n2", "n3", "n4"]], ["y0", "y1", "y2"])


@query(
    "regression_residual_flags",
    f"""WITH {_FIT}, r AS (SELECT min(fit) AS lo, max(fit) AS hi FROM e),
    b AS (SELECT least(floor((fit - lo) / (hi - lo) * 40), 39) AS band, count(*)::DOUBLE AS w, avg(fit) AS fitted, avg(e) AS y, stddev_samp(e) AS sd FROM e, r GROUP BY 1),
    c AS (SELECT *, (fitted - avg(fitted) OVER ()) / 1000 AS z, row_number() OVER (ORDER BY band) AS k, count(*) OVER () AS bands FROM b),
    s AS (SELECT sum(w) AS n0, sum(w * z) AS n1, sum(w * z * z) AS n2, sum(w * z * z * z) AS n3, sum(w * pow(z, 4)) AS n4, sum(w * y) AS y0, sum(w * y * z) AS y1, sum(w * y * z * z) AS y2 FROM c),
    q AS (SELECT *, {_MOVES[1]} AS q1, {_MOVES[2]} AS q2 FROM s)
    SELECT count(*)::DOUBLE AS bands, round(any_value(q1) / 1000, 6) AS slope, round(any_value(q2) / 1e6, 6) AS curvature, round(avg(sd) FILTER (k > bands - bands // 3) - avg(sd) FILTER (k <= bands // 3), 2) AS spread_growth, (SELECT round(any_value(n) * pow(corr(e * e, x), 2), 2) FROM e) AS breusch_pagan FROM c, q""",
)
def _(spark, d):
    r = run_analysis(t(spark, d, "lineitem"), "linear_regression", target="l_extendedprice", features=["l_quantity"])
    pattern = at(r, "diagnostics.residual_pattern")
    # the quadratic's own terms, without the centring of its square, are the same
    return spark.createDataFrame([(float(len(at(r, "tables.residual_bands"))), _double(pattern["slope"], 6), _double(pattern["curvature"], 6), _double(pattern["spread_growth"], 2), _double(at(r, "diagnostics.breusch_pagan.statistic"), 2))], "bands double, slope double, curvature double, spread_growth double, breusch_pagan double")


@query(
    "regression_robust_errors",
    f"""WITH {_FIT}, h AS (SELECT *, 1 / n + (x - mx) * (x - mx) / sxx AS lev FROM e),
    g AS (SELECT sum((x - mx) * e) AS s, any_value(sxx) AS sxx, any_value(n) AS n FROM e GROUP BY l_suppkey)
    SELECT (SELECT round(sqrt(sum(s * s) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 2)) / any_value(sxx), 4) FROM g) AS cluster_se, round(sqrt(var_pop((x - mx) * e / (1 - lev)) * (any_value(n) - 1)) / any_value(sxx), 4) AS jackknife_se FROM h""",
)
def _(spark, d):
    r = run_analysis(t(spark, d, "lineitem"), "linear_regression", target="l_extendedprice", features=["l_quantity"], cluster_column="l_suppkey", jackknife=True)
    return spark.createDataFrame([(_double(at(r, "tables.cluster_robust.1.standard_error"), 4), _double(at(r, "tables.jackknife.1.standard_error"), 4))], "cluster_se double, jackknife_se double")


_PLACE = "SELECT l_quantity AS v, l_extendedprice AS p, l_returnflag AS g FROM lineitem"


@query(
    "versions_replay",
    f"""WITH b AS ({_PLACE}), w AS (SELECT * FROM b WHERE v > 10)
    SELECT run, change, version, sample_size, round(mean, 2) AS mean, stale FROM (
      SELECT 1 AS run, 'run' AS change, 1 AS version, count(*) AS sample_size, avg(v) AS mean, false AS stale FROM b
      UNION ALL SELECT 2, 'replay', 2, count(*), avg(v), false FROM w
      UNION ALL SELECT 3, 'modify', 1, count(*), avg(p), true FROM b
      UNION ALL SELECT 4, 'replay', 1, count(*), avg(v), false FROM b)""",
)
def _(spark, d):
    data = Dataset(spark, new_folder(spark, "dataset"))
    data.create(t(spark, d, "lineitem").select(F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("g")))
    data.apply("filter", conditions=[{"column": "v", "operator": "gt", "value": 10}])
    runs = Runs(data)
    first = runs.run(1, "one_sample_t_test", value_column="v", mu=20)
    runs.replay(first, version=2)
    runs.modify(first, value_column="p")
    runs.replay(first)
    stale = runs.stale()
    rows = [(r.id, r.change, r.version, at(x := runs.result(r.id), "sample_size"), _double(at(x, "estimate.mean"), 2), r.id in stale) for r in runs.log().collect()]
    return spark.createDataFrame(rows, "run int, change string, version int, sample_size long, mean double, stale boolean")


@query(
    "assumption_evidence",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT (SELECT count(*) FROM lineitem) AS sample_size, (SELECT count(*) FROM lineitem, q WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS groups, min(n) AS least_group, round((SELECT q1 - 1.5 * (q3 - q1) FROM q), 4) AS low FROM c""",
)
def _(spark, d):
    e = pair_diagnostics(t(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "group")
    return spark.createDataFrame([(e["sample_size"], e["outliers"]["count"], e["groups"], e["least_group"], round(e["outliers"]["low"], 4))], "sample_size long, outliers long, groups long, least_group long, low double")


@query(
    "expected_counts",
    """WITH r AS (SELECT p_brand AS r, count(*)::DOUBLE AS n FROM part GROUP BY 1), c AS (SELECT p_size AS c, count(*)::DOUBLE AS n FROM part GROUP BY 1), s AS (SELECT count(*) AS n FROM part)
    SELECT (SELECT n FROM s) AS sample_size, count(*) AS cells, count(*) FILTER (r.n * c.n / s.n < 5) AS below_5, round(min(r.n * c.n / s.n), 6) AS least FROM r, c, s""",
)
def _(spark, d):
    e = pair_diagnostics(t(spark, d, "part"), "p_brand", "p_size", "table")
    return spark.createDataFrame([(e["sample_size"], e["cells"], e["cells_with_expected_below_5"], round(e["least_expected"], 6))], "sample_size long, cells long, below_5 long, least double")


@query(
    "chi_square_of_many_cells",
    """WITH o AS (SELECT l_partkey AS r, l_linenumber AS c, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL), r AS (SELECT r, sum(o) AS rn FROM o GROUP BY r), c AS (SELECT c, sum(o) AS cn FROM o GROUP BY c), s AS (SELECT sum(o) AS n FROM o)
    SELECT (SELECT n::BIGINT FROM s) AS sample_size, round(sum((coalesce(o, 0) - rn * cn / n) * (coalesce(o, 0) - rn * cn / n) / (rn * cn / n)), 4) AS statistic, (count(DISTINCT r.r) - 1) * (count(DISTINCT c.c) - 1) AS df, round(min(rn * cn / n), 4) AS least_expected FROM r CROSS JOIN c CROSS JOIN s LEFT JOIN o ON o.r = r.r AND o.c = c.c""",
)
def _(spark, d):
    r = run_analysis(t(spark, d, "lineitem"), "chi_square", row_column="l_partkey", column_column="l_linenumber")
    return spark.createDataFrame([(r["sample_size"], _double(at(r, "test.statistic"), 4), at(r, "test.df"), _double(at(r, "diagnostics.least_expected"), 4))], "sample_size long, statistic double, df long, least_expected double")


@query("chart_notes", "SELECT x, round(value, 2)::DOUBLE AS value FROM (SELECT o_orderpriority AS x, sum(o_totalprice) AS value FROM orders GROUP BY 1) WHERE x IN ('1-URGENT', '5-LOW') UNION ALL SELECT 'none', NULL")
def _(spark, d):
    panel = charts.build(t(spark, d, "orders"), "bar", "o_orderpriority", "o_totalprice")["all"]
    notes = charts.placed(panel, [{"text": "first", "x": "1-URGENT"}, {"text": "last", "x": "5-LOW"}, {"text": "nowhere", "x": "none"}])
    return rounded(spark.createDataFrame([(n["x"], n["value"]) for n in notes], "x string, value double"), 2)
