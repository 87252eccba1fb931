"""Each analysis as a registered query: its numbers as columns, and SQL that works them out by itself.

p-values need distribution functions, which SQL lacks; tests hold them against
known answers.  Analyses that iterate in ways SQL cannot follow have no SQL.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import flatten_analysis
from ..stats import run_analysis
from ..stats.result import Result
from .core_queries import TIMES, _times, t
from .registry import query


def at(r: Result, path: str) -> Any:
    """The value at a dotted path; numbers index lists."""
    for key in path.split("."):
        if r is None:
            return None
        r = r[int(key)] if isinstance(r, list) else r[key]
    return r


def _double(x: Any, places: int) -> float | None:
    return None if x is None else round(float(x), places)


def _rounded(sql: str, chosen: str) -> str:
    """``sql`` with its outermost SELECT put in brackets, and the chosen terms taken from it."""
    depth, cut = 0, 0
    for k, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if not depth and sql.startswith("SELECT ", k):
            cut = k
    return f"{sql[:cut]}SELECT {chosen} FROM ({sql[cut:]})"


def scalars(kind: str, fields: dict[str, tuple[str, int]], sql: str, prepare=None, **parameters: Any) -> None:
    """One row: column -> (path in the result, places).  ``sql`` selects the same names without rounding; results have six places."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        r = run_analysis(prepare(spark, d), kind, **parameters)
        return spark.createDataFrame([tuple(_double(at(r, path), places) for path, places in fields.values())], ", ".join(f"{c} double" for c in fields))

    query(f"analysis_{kind}", _rounded(sql, ", ".join(f"round(round({c}, 6), {p})::DOUBLE AS {c}" for c, (_, p) in fields.items())))(run)


def table(kind: str, path: str, shape: dict[str, int | None], sql: str, prepare=None, **parameters: Any) -> None:
    """Rows of a table of the result: column -> places, None for text.  ``sql`` selects the same names without rounding."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = at(run_analysis(prepare(spark, d), kind, **parameters), path)
        made = [tuple(r[c] if p is None else _double(r[c], p) for c, p in shape.items()) for r in rows]
        return spark.createDataFrame(made, ", ".join(f"`{c}` {'string' if p is None else 'double'}" for c, p in shape.items()))

    chosen = ", ".join(f'"{c}"' if p is None else f'round(round("{c}", 6), {p})::DOUBLE AS "{c}"' for c, p in shape.items())
    query(f"analysis_{kind}", _rounded(sql, chosen))(run)


def unchecked(kind: str, prepare=None, **parameters: Any) -> None:
    """All of the result, as rows of section, key and value."""
    query(f"analysis_{kind}")(lambda spark, d: flatten_analysis(spark, run_analysis(prepare(spark, d), kind, **parameters)))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")


def halves(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("half", (F.col("l_quantity") > 25).cast("string"))


def late(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("l_linenumber", (F.col("l_linenumber") > 3).cast("int"))


def zeros(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("zeros", F.greatest(F.col("l_linenumber") - 3, F.lit(0)))


def raters(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").withColumn("third", F.pmod("doc_id", F.lit(2)).cast("int"))


Z = 1.959963984540054  # the 0.975 quantile of the normal distribution
#: Moments of two groups, in order of their labels.
GROUPS = "g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), w AS (SELECT a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2 FROM g a, g b WHERE a.g < b.g)"


def spread(group: str) -> str:
    """ANOVA of distances from the median of each group, as a common table ``levene(f)``."""
    return f"""c AS (SELECT {group} AS g, quantile_cont(l_quantity, 0.5) AS c FROM lineitem GROUP BY 1), x AS (SELECT g, abs(l_quantity - c) AS v FROM lineitem JOIN c ON {group} = g),
    p AS (SELECT g, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY g), levene AS (SELECT (sum(n * pow(m - (SELECT avg(v) FROM x), 2)) / (count(*) - 1)) / (sum((n - 1) * s) / (sum(n) - count(*))) AS f FROM p)"""


def ranks(rel: str) -> str:
    return f"SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM ({rel})"


def correlation_sql(r: str, rel: str, lost: int = 0) -> str:
    """r with its t statistic and Fisher interval."""
    return f"""WITH s AS (SELECT {r} AS r, count(*)::DOUBLE - {lost} AS n FROM {rel}) SELECT r, r * sqrt((n - 2) / (1 - r * r)) AS statistic, n - 2 AS df, tanh(atanh(r) - {Z} / sqrt(n - 3)) AS low, tanh(atanh(r) + {Z} / sqrt(n - 3)) AS high FROM s"""


CORRELATION = {"r": ("estimate.r", 6), "statistic": ("test.statistic", 6), "df": ("test.df", 0), "low": ("confidence_interval.0", 6), "high": ("confidence_interval.1", 6)}

# Descriptions

MOMENTS = "count(*)::DOUBLE AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, max({c}) AS max, var_samp({c}) AS variance, stddev_samp({c}) / sqrt(count(*)) AS standard_error"
SHAPE = "avg(pow({c} - m, 3)) / pow(stddev_samp({c}), 3) AS skewness, avg(pow({c} - m, 4)) / pow(var_samp({c}), 2) - 3 AS kurtosis"


def shape_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", {SHAPE.format(c=c)} FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"


_NAMES = ("l_quantity", "l_extendedprice")
table(
    "descriptive",
    "tables.descriptives",
    {"column": None, "n": 0, "mean": 3, "sd": 3, "min": 2, "q1": 3, "median": 3, "q3": 3, "max": 2, "variance": 0, "standard_error": 6, "skewness": 6, "kurtosis": 6},
    "WITH a AS (" + " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {MOMENTS.format(c=c)} FROM lineitem)" for c in _NAMES) + "), b AS (" + " UNION ALL ".join(shape_sql(c) for c in _NAMES) + ") SELECT a.*, b.skewness, b.kurtosis FROM a JOIN b USING (\"column\")",
    prepare=lines,
    columns=list(_NAMES),
)
_NAMES = ("l_quantity", "l_discount")
table(
    "normality_tests",
    "tables.normality",
    {"column": None, "n": 0, "skewness": 6, "kurtosis": 6, "statistic": 3, "outlier_percent": 6},
    "WITH s AS (" + " UNION ALL ".join(shape_sql(c) for c in _NAMES) + "), o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::DOUBLE AS n, 100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) AS outlier_percent FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)" for c in _NAMES) + ') SELECT "column", n, skewness, kurtosis, n / 6 * (pow(skewness, 2) + pow(kurtosis, 2) / 4) AS statistic, outlier_percent FROM s JOIN o USING ("column")',
    prepare=lines,
    columns=list(_NAMES),
)
table("frequency", "tables.l_returnflag", {"value": None, "count": 0, "percentage": 6}, 'SELECT l_returnflag AS value, count(*) AS "count", 100.0 * count(*) / sum(count(*)) OVER () AS percentage FROM lineitem GROUP BY 1', prepare=lines, columns="l_returnflag")
table("weighted_frequencies", "tables.l_returnflag", {"value": None, "weight": 2, "count": 0, "percentage": 6}, 'SELECT l_returnflag AS value, sum(l_quantity) AS weight, count(*) AS "count", 100.0 * sum(l_quantity) / sum(sum(l_quantity)) OVER () AS percentage FROM lineitem GROUP BY 1', prepare=lines, columns="l_returnflag", weight_column="l_quantity")

# Groups

scalars(
    "welch_t_test",
    {"difference": ("estimate.difference", 6), "statistic": ("test.statistic", 6), "df": ("test.df", 2), "cohens_d": ("effect_size.cohens_d", 6), "levene": ("diagnostics.levene.statistic", 6), "variance_ratio": ("diagnostics.variance_ratio", 6)},
    f"WITH {GROUPS}, {spread('l_linestatus')} SELECT m1 - m2 AS difference, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cohens_d, f AS levene, greatest(v1, v2) / least(v1, v2) AS variance_ratio FROM w, levene",
    prepare=lines,
    value_column="l_quantity",
    group_column="l_linestatus",
)
scalars(
    "one_way_anova",
    {"between_": ("estimate.between", 3), "within_": ("estimate.within", 1), "statistic": ("test.statistic", 6), "df1": ("test.df1", 0), "df2": ("test.df2", 0), "eta_squared": ("effect_size.eta_squared", 6), "omega_squared": ("effect_size.omega_squared", 6), "levene": ("diagnostics.levene.statistic", 6)},
    f"WITH q AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), y AS (SELECT sum(n * pow(m - (SELECT avg(l_quantity) FROM lineitem), 2)) AS b, sum((n - 1) * v) AS w, count(*) - 1 AS d1, sum(n) - count(*) AS d2 FROM q), {spread('l_returnflag')} SELECT b AS between_, w AS within_, (b / d1) / (w / d2) AS statistic, d1 AS df1, d2 AS df2, b / (b + w) AS eta_squared, (b - d1 * w / d2) / (b + w + w / d2) AS omega_squared, f AS levene FROM y, levene",
    prepare=lines,
    value_column="l_quantity",
    group_column="l_returnflag",
)
table(
    "two_way_anova",
    "tables.anova",
    {"source": None, "ss": 2, "df": 0, "f": 6, "eta_squared": 6},
    """WITH c AS (SELECT l_linestatus AS a, l_linenumber AS b, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1, 2), k AS (SELECT sum(n * m) / sum(n) AS grand, sum((n - 1) * v) / (sum(n) - count(*)) AS ms, sum((n - 1) * v) AS within_ FROM c),
    a AS (SELECT sum(n * pow(m - (SELECT grand FROM k), 2)) AS ss, count(*) - 1 AS d FROM (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY a)), b AS (SELECT sum(n * pow(m - (SELECT grand FROM k), 2)) AS ss, count(*) - 1 AS d FROM (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY b)),
    x AS (SELECT sum(n * pow(m - (SELECT grand FROM k), 2)) AS ss FROM c), u AS (SELECT 'l_linestatus' AS source, ss, d FROM a UNION ALL SELECT 'l_linenumber', ss, d FROM b UNION ALL SELECT 'interaction', x.ss - a.ss - b.ss, a.d * b.d FROM a, b, x)
    SELECT source, u.ss, d AS df, u.ss / d / ms AS f, u.ss / (x.ss + within_) AS eta_squared FROM u, k, x""",
    prepare=lines,
    value_column="l_quantity",
    group_column="l_linestatus",
    second_group_column="l_linenumber",
)
TIES = "(SELECT sum(pow(c, 3) - c) FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity))"
scalars(
    "mann_whitney",
    {"u": ("estimate.u", 1), "z": ("test.z", 6), "rank_biserial": ("effect_size.rank_biserial", 6)},
    f"WITH x AS ({ranks('SELECT l_linestatus AS g, l_quantity AS v FROM lineitem')}), s AS (SELECT g, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS r FROM x GROUP BY g), p AS (SELECT a.n AS n1, b.n AS n2, a.n + b.n AS n, a.r - a.n * (a.n + 1) / 2 AS u1 FROM s a, s b WHERE a.g < b.g) SELECT least(u1, n1 * n2 - u1) AS u, (u1 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - {TIES} / (n * (n - 1)))) AS z, 2 * u1 / (n1 * n2) - 1 AS rank_biserial FROM p",
    prepare=lines,
    value_column="l_quantity",
    group_column="l_linestatus",
)
scalars(
    "kruskal_wallis",
    {"h": ("estimate.h", 6), "df": ("test.df", 0), "epsilon_squared": ("effect_size.epsilon_squared", 6)},
    f"WITH x AS ({ranks('SELECT l_returnflag AS g, l_quantity AS v FROM lineitem')}), s AS (SELECT g, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS r FROM x GROUP BY g), p AS (SELECT sum(n) AS n, count(*) - 1 AS df, (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - {TIES} / (pow(sum(n), 3) - sum(n))) AS h FROM s) SELECT h, df, h / (n - 1) AS epsilon_squared FROM p",
    prepare=lines,
    value_column="l_quantity",
    group_column="l_returnflag",
)
scalars("one_sample_t_test", {"mean": ("estimate.mean", 6), "sd": ("estimate.sd", 6), "statistic": ("test.statistic", 6), "df": ("test.df", 0), "cohens_d": ("effect_size.cohens_d", 6)}, "WITH s AS (SELECT avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, count(*)::DOUBLE AS n FROM lineitem) SELECT mean, sd, (mean - 25) / (sd / sqrt(n)) AS statistic, n - 1 AS df, (mean - 25) / sd AS cohens_d FROM s", prepare=lines, value_column="l_quantity", mu=25)
scalars("one_sample_z_test", {"mean": ("estimate.mean", 6), "statistic": ("test.statistic", 6), "low": ("confidence_interval.0", 6), "high": ("confidence_interval.1", 6)}, f"WITH s AS (SELECT avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem) SELECT mean, (mean - 25) / se AS statistic, mean - {Z} * se AS low, mean + {Z} * se AS high FROM s", prepare=lines, value_column="l_quantity", mu=25)
scalars("paired_t_test", {"mean": ("estimate.mean", 6), "sd": ("estimate.sd", 6), "statistic": ("test.statistic", 3), "df": ("test.df", 0), "cohens_d": ("effect_size.cohens_d", 6)}, "WITH s AS (SELECT avg(l_tax - l_discount) AS mean, stddev_samp(l_tax - l_discount) AS sd, count(*)::DOUBLE AS n FROM lineitem) SELECT mean, sd, mean / (sd / sqrt(n)) AS statistic, n - 1 AS df, mean / sd AS cohens_d FROM s", prepare=lines, x="l_discount", y="l_tax")
scalars(
    "wilcoxon_signed_rank",
    {"w": ("estimate.w", 1), "z": ("test.z", 3), "r": ("effect_size.r", 6)},
    f"WITH x AS ({ranks('SELECT abs(l_tax - l_discount) AS v, l_tax > l_discount AS up FROM lineitem WHERE l_tax - l_discount <> 0')}), s AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (up), 0)::DOUBLE AS plus, sum(r)::DOUBLE AS total FROM x), k AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)), y AS (SELECT n, least(plus, total - plus) AS w, n * (n + 1) / 4 AS mean, sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM s, k) SELECT w, (w - mean + 0.5) / sd AS z, abs((w - mean + 0.5) / sd) / sqrt(n) AS r FROM y",
    prepare=lines,
    x="l_discount",
    y="l_tax",
)

# Association

scalars("pearson", CORRELATION, correlation_sql("corr(l_quantity, l_extendedprice)", "lineitem"), prepare=lines, x="l_quantity", y="l_extendedprice")
scalars("point_biserial", CORRELATION, correlation_sql("corr((l_linenumber > 3)::INT, l_quantity)", "lineitem"), prepare=late, x="l_linenumber", y="l_quantity")
_AVERAGE = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
scalars("spearman", CORRELATION, correlation_sql("corr(a, b)", f"(SELECT {_AVERAGE.format(c='l_quantity')} AS a, {_AVERAGE.format(c='l_extendedprice')} AS b FROM lineitem)"), prepare=lines, x="l_quantity", y="l_extendedprice")
scalars(
    "kendall",
    {"tau": ("estimate.tau", 6), "statistic": ("test.statistic", 6)},
    """WITH c AS (SELECT l_quantity AS a, l_discount AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(sign(p.a - q.a) * sign(p.b - q.b) * p.n * q.n) / 2 AS s FROM c p, c q), k AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(m * (m - 1)) / 2 FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS tx, (SELECT sum(m * (m - 1)) / 2 FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS ty),
    y AS (SELECT n, s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau FROM s, k) SELECT tau, tau / sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) AS statistic FROM y""",
    prepare=lines,
    x="l_quantity",
    y="l_discount",
)
_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
table("correlation_matrix", "tables.pairs", {"x": None, "y": None, "n": 0, "r": 6}, " UNION ALL ".join(f"(SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM lineitem)" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]).join(("WITH u AS (", ") SELECT * FROM u")), prepare=lines, columns=_NUMERIC)
scalars(
    "partial_correlation",
    CORRELATION,
    f"WITH k AS (SELECT corr(l_extendedprice, l_discount) AS xy, corr(l_extendedprice, l_quantity) AS xz, corr(l_discount, l_quantity) AS yz, count(*)::DOUBLE - 1 AS n FROM lineitem), s AS (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM k) SELECT r, r * sqrt((n - 2) / (1 - r * r)) AS statistic, n - 2 AS df, tanh(atanh(r) - {Z} / sqrt(n - 3)) AS low, tanh(atanh(r) + {Z} / sqrt(n - 3)) AS high FROM s",
    prepare=lines,
    x="l_extendedprice",
    y="l_discount",
    controls=["l_quantity"],
)
CELLS = """o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT r, c, n, sum(n) OVER (PARTITION BY r) AS rn, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM o)"""
scalars("chi_square", {"statistic": ("test.statistic", 6), "df": ("test.df", 0), "cramers_v": ("effect_size.cramers_v", 6), "least_expected": ("diagnostics.least_expected", 3)}, f"WITH {CELLS}, s AS (SELECT sum(pow(n - e, 2) / e) AS x, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df, sum(n) AS n, least(count(DISTINCT r), count(DISTINCT c)) - 1 AS k, min(e) AS least_expected FROM e) SELECT x AS statistic, df, sqrt(x / (n * k)) AS cramers_v, least_expected FROM s", prepare=lines, row_column="l_returnflag", column_column="l_linestatus")
table("crosstab", "tables.cells", {"row": None, "column": None, "observed": 0, "expected": 3, "row_percent": 6}, f'WITH {CELLS} SELECT r AS "row", c AS "column", n AS observed, e AS expected, 100 * n / rn AS row_percent FROM e', prepare=lines, row_column="l_returnflag", column_column="l_linestatus")
scalars("chi_square_gof", {"statistic": ("test.statistic", 6), "df": ("test.df", 0), "cohens_w": ("effect_size.cohens_w", 6)}, "WITH o AS (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag), s AS (SELECT sum(pow(n - t / k, 2)) / any_value(t / k) AS x, any_value(t) AS n, any_value(k) - 1 AS df FROM o, (SELECT sum(n) AS t, count(*) AS k FROM o)) SELECT x AS statistic, df, sqrt(x / n) AS cohens_w FROM s", prepare=lines, column="l_returnflag")
scalars(
    "two_proportion_z_test",
    {"difference": ("estimate.difference", 6), "statistic": ("test.statistic", 6), "low": ("confidence_interval.0", 6), "high": ("confidence_interval.1", 6), "odds_ratio": ("effect_size.odds_ratio", 6), "cohens_h": ("effect_size.cohens_h", 6)},
    f"WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, (count(*) FILTER (l_quantity > 25))::DOUBLE AS x FROM lineitem GROUP BY 1), w AS (SELECT a.n AS n1, b.n AS n2, a.x AS x1, b.x AS x2, a.x / a.n AS p1, b.x / b.n AS p2, (a.x + b.x) / (a.n + b.n) AS p FROM g a, g b WHERE a.g < b.g) SELECT p1 - p2 AS difference, (p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS statistic, p1 - p2 - {Z} * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS low, p1 - p2 + {Z} * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS high, x1 * (n2 - x2) / (x2 * (n1 - x1)) AS odds_ratio, 2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)) AS cohens_h FROM w",
    prepare=halves,
    value_column="half",
    group_column="l_linestatus",
)
FOUR = "m AS (SELECT (count(*) FILTER (quality = 0 AND toxic = 0))::DOUBLE AS a, (count(*) FILTER (quality = 0 AND toxic = 1))::DOUBLE AS b, (count(*) FILTER (quality = 1 AND toxic = 0))::DOUBLE AS c, (count(*) FILTER (quality = 1 AND toxic = 1))::DOUBLE AS d FROM labels)"
scalars(
    "fisher_exact",
    {"odds_ratio": ("estimate.odds_ratio", 6), "p_value": ("test.p_value", 6)},
    # every table of these margins, by log factorials
    f"""WITH {FOUR}, k AS (SELECT a, b, c, d, unnest(range(greatest(0, (a - d)::BIGINT), least((a + b)::BIGINT, (a + c)::BIGINT) + 1)) AS x FROM m), l AS (SELECT a, x, lgamma(a + b + 1) - lgamma(x + 1.0) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS w FROM k), o AS (SELECT w AS own FROM l WHERE x = a), p AS (SELECT sum(exp(w - own)) FILTER (w <= own + 1e-7) / sum(exp(w - own)) AS p FROM l, o)
    SELECT a * d / (b * c) AS odds_ratio, p AS p_value FROM m, p""",
    prepare=raters,
    row_column="quality",
    column_column="toxic",
)
scalars("mcnemar", {"b": ("estimate.changed.0", 0), "c": ("estimate.changed.1", 0), "statistic": ("test.statistic", 6), "odds_ratio": ("effect_size.odds_ratio", 6)}, f"WITH {FOUR} SELECT b, c, pow(greatest(0, abs(b - c) - 1), 2) / (b + c) AS statistic, b / c AS odds_ratio FROM m", prepare=raters, before_column="quality", after_column="toxic")
scalars(
    "cohens_kappa",
    {"kappa": ("estimate.kappa", 6), "agreement": ("estimate.agreement", 6), "statistic": ("test.statistic", 6), "low": ("confidence_interval.0", 6)},
    f"""WITH {FOUR}, p AS (SELECT a + b + c + d AS n, (a + d) / (a + b + c + d) AS po, (a + b) / (a + b + c + d) AS r0, (c + d) / (a + b + c + d) AS r1, (a + c) / (a + b + c + d) AS c0, (b + d) / (a + b + c + d) AS c1 FROM m), q AS (SELECT *, r0 * c0 + r1 * c1 AS pe FROM p), z AS (SELECT *, (po - pe) / (1 - pe) AS k FROM q)
    SELECT k AS kappa, po AS agreement, k / (sqrt(pe + pe * pe - r0 * c0 * (r0 + c0) - r1 * c1 * (r1 + c1)) / ((1 - pe) * sqrt(n))) AS statistic, k - 1.959964 * sqrt(po * (1 - po) / n) / (1 - pe) AS low FROM z""",
    prepare=raters,
    row_column="quality",
    column_column="toxic",
)

# Scales and raters

_ITEMS = ["l_quantity", "l_discount", "l_tax"]


def _alpha(names: list[str]) -> str:
    k, total = len(names), " + ".join(names)
    return f"{k}.0 / {k - 1} * (1 - ({' + '.join(f'var_samp({c})' for c in names)}) / var_samp({total}))"


table(
    "cronbach_alpha",
    "tables.items",
    {"item": None, "item_total_r": 6, "alpha_if_deleted": 6},
    "WITH u AS (" + " UNION ALL ".join(f"(SELECT '{c}' AS item, corr({c}, {' + '.join(x for x in _ITEMS if x != c)}) AS item_total_r, {_alpha([x for x in _ITEMS if x != c])} AS alpha_if_deleted FROM lineitem)" for c in _ITEMS) + ") SELECT * FROM u",
    prepare=lines,
    items=_ITEMS,
)
_TOTAL = " + ".join(_ITEMS)
scalars(
    "mcdonalds_omega",
    {"omega": ("estimate.omega", 6), "alpha": ("estimate.alpha", 6)},
    f"WITH s AS (SELECT {', '.join(f'corr({c}, {_TOTAL}) AS r{i}, var_samp({c}) AS v{i}' for i, c in enumerate(_ITEMS))}, {_alpha(_ITEMS)} AS alpha FROM lineitem), y AS (SELECT pow({' + '.join(f'r{i} * sqrt(v{i})' for i in range(3))}, 2) AS g, {' + '.join(f'v{i} * (1 - r{i} * r{i})' for i in range(3))} AS u, alpha FROM s) SELECT g / (g + u) AS omega, alpha FROM y",
    prepare=lines,
    items=_ITEMS,
)
table("likert_analysis", "tables.frequencies", {"item": None, "value": 0, "n": 0, "percentage": 6, "weighted_percentage": 6}, "SELECT 'l_linenumber' AS item, l_linenumber AS value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percentage, 100.0 * count(*) / sum(count(*)) OVER () AS weighted_percentage FROM lineitem GROUP BY l_linenumber", prepare=lines, items=["l_linenumber"], scale_min=1, scale_max=7)
scalars(
    "fleiss_kappa",
    {"kappa": ("estimate.kappa", 6), "agreement": ("estimate.agreement", 6), "statistic": ("test.statistic", 6)},
    """WITH x AS (SELECT quality + toxic + doc_id % 2 AS ones FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT count(*)::DOUBLE AS n, avg((ones * (ones - 1) + (3 - ones) * (2 - ones)) / 6.0) AS po, avg(ones / 3.0) AS p FROM x), y AS (SELECT n, po, p * p + (1 - p) * (1 - p) AS pe, p * p * p + (1 - p) * (1 - p) * (1 - p) AS cubes FROM s),
    z AS (SELECT po, (po - pe) / (1 - pe) AS k, 2 * (pow(1 - pe, 2) - (1 - 3 * pe + 2 * cubes)) / (n * 3 * 2 * pow(1 - pe, 2)) AS v FROM y) SELECT k AS kappa, po AS agreement, k / sqrt(v) AS statistic FROM z""",
    prepare=raters,
    columns=["quality", "toxic", "third"],
)
scalars(
    "icc",
    {"icc_2_1": ("estimate.icc_2_1", 6), "icc_2_k": ("estimate.icc_2_k", 6), "statistic": ("test.statistic", 6)},
    """WITH s AS (SELECT count(*)::DOUBLE AS n, avg(l_discount) AS a, avg(l_tax) AS b, var_samp(l_discount) + var_samp(l_tax) AS tr, var_samp(l_discount + l_tax) AS total FROM lineitem), y AS (SELECT n, total / 2 AS msr, n * pow(a - b, 2) / 2 AS msc, ((n - 1) * tr - (n - 1) * total / 2) / (n - 1) AS mse FROM s)
    SELECT (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc_2_1, (msr - mse) / (msr + (msc - mse) / n) AS icc_2_k, msr / mse AS statistic FROM y""",
    prepare=lines,
    columns=["l_discount", "l_tax"],
)

# Regression: normal equations by Cramer's rule, likelihoods by Newton steps


def det(m: list[list[str]]) -> str:
    """Determinant of a matrix of SQL terms."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {det([[*row[:j], *row[j + 1 :]] for row in m[1:]])}" for j in range(len(m))) + ")"


def solve(m: list[list[str]], v: list[str]) -> list[str]:
    k = len(v)
    return [f"({det([[v[i] if j == c else m[i][j] for j in range(k)] for i in range(k)])} / {det(m)})" for c in range(k)]


def ols_sql(y: str, x: list[str]) -> str:
    """Common tables: c (moments), b (slopes b1.. and b0), r (rss, total, n)."""
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    c = ", ".join(f"covar_samp({x[i]}, {x[j]}) AS s{i}{j}" for i, j in pairs) + ", " + ", ".join(f"covar_samp({v}, {y}) AS y{i}, avg({v}) AS m{i}" for i, v in enumerate(x)) + f", avg({y}) AS my, var_samp({y}) AS vy, count(*)::DOUBLE AS n"
    slopes = solve([[f"s{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)], [f"y{i}" for i in range(k)])
    fit = " + ".join([f"b{i + 1} * y{i}" for i in range(k)])
    return f"c AS (SELECT {c} FROM lineitem), b AS (SELECT *, {', '.join(f'{s} AS b{i + 1}' for i, s in enumerate(slopes))} FROM c), r AS (SELECT *, my - {' - '.join(f'b{i + 1} * m{i}' for i in range(k))} AS b0, (n - 1) * (vy - ({fit})) AS rss, (n - 1) * vy AS total FROM b)"


_X = ["l_quantity", "l_discount", "l_tax"]
scalars(
    "linear_regression",
    {**{f"b{i}": (f"tables.coefficients.{i}.coefficient", 2) for i in range(4)}, "se1": ("tables.coefficients.1.standard_error", 6), "r_squared": ("estimate.r_squared", 6), "rmse": ("estimate.rmse", 3), "statistic": ("test.statistic", 6), "aic": ("diagnostics.aic", 1)},
    # the first slope's variance: the residual one times an entry of the inverse
    f"WITH {ols_sql('l_extendedprice', _X)} SELECT b0, b1, b2, b3, sqrt(rss / (n - 4) / (n - 1) * {det([['s11', 's12'], ['s12', 's22']])} / {det([['s00', 's01', 's02'], ['s01', 's11', 's12'], ['s02', 's12', 's22']])}) AS se1, 1 - rss / total AS r_squared, sqrt(rss / (n - 4)) AS rmse, (total - rss) / 3 / (rss / (n - 4)) AS statistic, n * ln(rss / n) + 8 AS aic FROM r",
    prepare=lines,
    target="l_extendedprice",
    features=_X,
)
#: Of two values the rarer is the positive one.
RARER = "(SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)"
scalars(
    "linear_probability_model",
    {**{f"b{i}": (f"tables.hc1.{i}.coefficient", 6) for i in range(3)}, "r_squared": ("estimate.r_squared", 6)},
    f"WITH {ols_sql(f'(l_linestatus = {RARER})::INT', _X[:2])} SELECT b0, b1, b2, 1 - rss / total AS r_squared FROM r",
    prepare=lines,
    target="l_linestatus",
    features=_X[:2],
)


def newton_sql(rel: str, score: str, weight: str, k: int, start: str = "0.0", steps: int = 8, name: str = "") -> str:
    """Common tables t0 .. of coefficients b0 ..: Newton steps on a likelihood in eta; rel has y and x1 .."""
    x = ["1.0", *[f"x{i}" for i in range(1, k)]]
    eta = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
    parts = [f"{name}r AS MATERIALIZED ({rel})", f"{name}t0 AS (SELECT {start} AS b0, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(1, k))})"]
    for s in range(steps):
        sums = ", ".join([f"sum(g * {v}) AS g{i}" for i, v in enumerate(x)] + [f"sum(w * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(k) for j in range(i, k)])
        parts.append(f"{name}g{s} AS (SELECT {sums} FROM (SELECT *, {score} AS g, {weight} AS w FROM (SELECT *, {eta} AS eta FROM {name}r, {name}t{s})))")
        moves = solve([[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)], [f"g{i}" for i in range(k)])
        parts.append(f"{name}t{s + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + {m} AS b{i}' for i, m in enumerate(moves))} FROM {name}t{s}, {name}g{s})")
    return ", ".join(parts)


_LOGIT = newton_sql(f"SELECT (l_linestatus = {RARER})::INT::DOUBLE AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem", "y - 1 / (1 + exp(-eta))", "exp(-eta) / pow(1 + exp(-eta), 2)", 3, steps=5)
scalars(
    "logistic_regression",
    {**{f"b{i}": (f"tables.coefficients.{i}.coefficient", 4) for i in range(3)}, "loglik": ("estimate.log_likelihood", 2)},
    f"WITH {_LOGIT}, l AS (SELECT sum(y * eta - ln(1 + exp(eta))) AS loglik FROM (SELECT y, b0 + b1 * x1 + b2 * x2 AS eta FROM r, t5)) SELECT b0, b1, b2, loglik FROM t5, l",
    prepare=lines,
    target="l_linestatus",
    features=_X[:2],
)
_POISSON = newton_sql("SELECT l_linenumber::DOUBLE AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem", "y - exp(eta)", "exp(eta)", 3, start="(SELECT ln(avg(l_linenumber)) FROM lineitem)", steps=5)
scalars(
    "poisson_regression",
    {**{f"b{i}": (f"tables.coefficients.{i}.coefficient", 3) for i in range(3)}, "loglik": ("estimate.log_likelihood", 2)},
    f"WITH {_POISSON}, l AS (SELECT sum(y * eta - exp(eta) - lgamma(y + 1)) AS loglik FROM (SELECT y, b0 + b1 * x1 + b2 * x2 AS eta FROM r, t5)) SELECT b0, b1, b2, loglik FROM t5, l",
    prepare=lines,
    target="l_linenumber",
    features=_X[:2],
)
_TARGETS = {"target": "l_linestatus", "features": _X[:2]}
#: Distribution function of the normal by a rational approximation (to 1.5e-7), and density, of eta.
CDF = "(CASE WHEN eta < 0 THEN 0.5 * u ELSE 1 - 0.5 * u END)"
DENSITY = "(exp(-eta * eta / 2) / sqrt(2 * pi()))"
_U = "(0.254829592 * k - 0.284496736 * k * k + 1.421413741 * k * k * k - 1.453152027 * pow(k, 4) + 1.061405429 * pow(k, 5)) * exp(-eta * eta / 2)"
_K = "1 / (1 + 0.3275911 * abs(eta) / sqrt(2))"


def _normal(term: str) -> str:
    """A term of CDF and DENSITY with the approximation put in."""
    return term.replace("CDF", CDF).replace("DENSITY", DENSITY).replace("u END", f"({_U.replace('k', f'({_K})')}) END").replace("0.5 * u ELSE", f"0.5 * ({_U.replace('k', f'({_K})')}) ELSE")


_PROBIT = newton_sql(f"SELECT (l_linestatus = {RARER})::INT::DOUBLE AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem", _normal("(y - CDF) * DENSITY / (CDF * (1 - CDF))"), _normal("DENSITY * DENSITY / (CDF * (1 - CDF))"), 3, steps=5)
scalars("probit", {f"b{i}": (f"tables.coefficients.{i}.coefficient", 4) for i in range(3)}, f"WITH {_PROBIT} SELECT b0, b1, b2 FROM t5", prepare=lines, **_TARGETS)
unchecked("negative_binomial", lines, target="l_linenumber", features=["l_discount"])


def newton_indices_sql(rel: str, designs: list[list[str]], terms: dict[str, str], start: list[str], steps: int = 12) -> str:
    """Common tables t0 .. of parameters b0 ..: Newton steps by indices e0 .., each a row of ``designs`` times b.

    ``terms`` gives g0 .. and h00, h01 .., the derivatives of the log-likelihood by the indices; it may name terms of its own before.
    """
    k, m = len(start), len(designs)
    parts = [f"r AS MATERIALIZED ({rel})", f"t0 AS (SELECT {', '.join(f'({v})::DOUBLE AS b{i}' for i, v in enumerate(start))})"]
    index = [" + ".join(f"b{j} * {v}" for j, v in enumerate(row) if v != "0") for row in designs]
    for s in range(steps):
        score = [" + ".join(f"g{i} * {designs[i][j]}" for i in range(m) if designs[i][j] != "0") for j in range(k)]
        curve = {(a, b): " + ".join(f"h{min(i, j)}{max(i, j)} * {designs[i][a]} * {designs[j][b]}" for i in range(m) for j in range(m) if "0" not in (designs[i][a], designs[j][b])) for a in range(k) for b in range(a, k)}
        sums = ", ".join([f"sum({v}) AS s{j}" for j, v in enumerate(score)] + [f"-sum({v or '0'}) AS c{a}{b}" for (a, b), v in curve.items()])
        made = ", ".join([f"{v} AS e{i}" for i, v in enumerate(index)] + [f"{v} AS {n}" for n, v in terms.items()])
        parts.append(f"n{s} AS (SELECT {sums} FROM (SELECT *, {made} FROM r, t{s}))")
        moves = solve([[f"c{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)], [f"s{i}" for i in range(k)])
        parts.append(f"t{s + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + {v} AS b{i}' for i, v in enumerate(moves))} FROM t{s}, n{s})")
    return ", ".join(parts)


_INFLATED = newton_indices_sql(
    "SELECT greatest(l_linenumber - 3, 0)::DOUBLE AS y, l_discount AS x FROM lineitem",
    [["1", "x", "0", "0"], ["0", "0", "1", "x"]],
    {
        "mu": "exp(e0)",
        "p": "1 / (1 + exp(-e1))",
        "w": "CASE WHEN y = 0 THEN 1 / (1 + exp(-e1 - mu)) ELSE 0 END",
        "g0": "CASE WHEN y = 0 THEN -(1 - w) * mu ELSE y - mu END",
        "g1": "w - p",
        "h00": "CASE WHEN y = 0 THEN -(1 - w) * mu + w * (1 - w) * mu * mu ELSE -mu END",
        "h01": "w * (1 - w) * mu",
        "h11": "w * (1 - w) - p * (1 - p)",
    },
    ["0.8", "0", "-0.5", "0"],
)
scalars(
    "zero_inflated",
    {"count0": ("tables.count.0.coefficient", 3), "count1": ("tables.count.1.coefficient", 3), "zero0": ("tables.zero.0.coefficient", 3), "zero1": ("tables.zero.1.coefficient", 3), "loglik": ("estimate.log_likelihood", 2)},
    f"WITH {_INFLATED}, l AS (SELECT sum(CASE WHEN y = 0 THEN ln(p + (1 - p) * exp(-mu)) ELSE ln(1 - p) + y * ln(mu) - mu - lgamma(y + 1) END) AS loglik FROM (SELECT y, exp(b0 + b1 * x) AS mu, 1 / (1 + exp(-b2 - b3 * x)) AS p FROM r, t12)) SELECT b0 AS count0, b1 AS count1, b2 AS zero0, b3 AS zero1, loglik FROM t12, l",
    prepare=zeros,
    target="zeros",
    features=["l_discount"],
)
_ZEROS = "greatest(l_linenumber - 3, 0)::DOUBLE"
_MEAN = "(exp(eta) / (1 - exp(-exp(eta))))"  # of a count that is not zero
_ANY = newton_sql(f"SELECT ({_ZEROS} > 0)::INT::DOUBLE AS y, l_discount AS x1 FROM lineitem", "y - 1 / (1 + exp(-eta))", "exp(-eta) / pow(1 + exp(-eta), 2)", 2, steps=6, name="a")
_MORE = newton_sql(f"SELECT {_ZEROS} AS y, l_discount AS x1 FROM lineitem WHERE {_ZEROS} > 0", f"y - {_MEAN}", f"{_MEAN} * (1 + exp(eta) - {_MEAN})", 2, start="0.5", steps=8, name="m")
scalars(
    "hurdle",
    {"count0": ("tables.count.0.coefficient", 3), "count1": ("tables.count.1.coefficient", 3), "any0": ("tables.any.0.coefficient", 3), "any1": ("tables.any.1.coefficient", 3)},
    f"WITH {_ANY}, {_MORE} SELECT mt8.b0 AS count0, mt8.b1 AS count1, at6.b0 AS any0, at6.b1 AS any1 FROM mt8, at6",
    prepare=zeros,
    target="zeros",
    features=["l_discount"],
)
# e0 the line, e1 the log of sigma; a value at the limit is known to lie below: eta is its distance in sigmas
_TOBIT = newton_indices_sql(
    "SELECT l_quantity AS y, l_discount AS x FROM lineitem",
    [["1", "x", "0"], ["0", "0", "1"]],
    {
        "sd": "exp(e1)",
        "z": "(y - e0) / sd",
        "eta": "(5 - e0) / sd",
        "a": _normal("DENSITY / (CDF)"),
        "d": "-a * (eta + a)",
        "g0": "CASE WHEN y <= 5 THEN -a / sd ELSE z / sd END",
        "g1": "CASE WHEN y <= 5 THEN -eta * a ELSE z * z - 1 END",
        "h00": "CASE WHEN y <= 5 THEN d / (sd * sd) ELSE -1 / (sd * sd) END",
        "h01": "CASE WHEN y <= 5 THEN (d * eta + a) / sd ELSE -2 * z / sd END",
        "h11": "CASE WHEN y <= 5 THEN d * eta * eta + a * eta ELSE -2 * z * z END",
    },
    ["(SELECT avg(l_quantity) FROM lineitem)", "0", "(SELECT ln(stddev_samp(l_quantity)) FROM lineitem)"],
)
scalars(
    "tobit",
    {"b0": ("tables.coefficients.0.coefficient", 3), "b1": ("tables.coefficients.1.coefficient", 3), "sigma": ("estimate.sigma", 3), "censored": ("estimate.censored", 0)},
    f"WITH {_TOBIT} SELECT b0, b1, exp(b2) AS sigma, (SELECT count(*) FROM lineitem WHERE l_quantity <= 5) AS censored FROM t12",
    prepare=lines,
    target="l_quantity",
    features=["l_discount"],
    threshold=5,
)
_ORDINAL = newton_indices_sql(
    "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_quantity AS x FROM lineitem",
    [["-x", "1", "0"], ["-x", "0", "1"]],
    {
        "f0": "1 / (1 + exp(-e0))",
        "f1": "1 / (1 + exp(-e1))",
        "d0": "f0 * (1 - f0)",
        "d1": "f1 * (1 - f1)",
        "p": "f1 - f0",
        "g0": "CASE y WHEN 0 THEN 1 - f0 WHEN 1 THEN -d0 / p ELSE 0 END",
        "g1": "CASE y WHEN 2 THEN -f1 WHEN 1 THEN d1 / p ELSE 0 END",
        "h00": "CASE y WHEN 0 THEN -d0 WHEN 1 THEN -d0 * (1 - 2 * f0) / p - g0 * g0 ELSE 0 END",
        "h01": "CASE y WHEN 1 THEN -g0 * g1 ELSE 0 END",
        "h11": "CASE y WHEN 2 THEN -d1 WHEN 1 THEN d1 * (1 - 2 * f1) / p - g1 * g1 ELSE 0 END",
    },
    ["0", "-0.7", "0.7"],
)
scalars(
    "ordinal_logit",
    {"slope": ("tables.coefficients.0.coefficient", 6), "cut_a": ("tables.cuts.A", 4), "cut_n": ("tables.cuts.N", 4)},
    f"WITH {_ORDINAL} SELECT b0 AS slope, b1 AS cut_a, b2 AS cut_n FROM t12",
    prepare=lines,
    target="l_returnflag",
    features=["l_quantity"],
)
unchecked("ridge_regression", lines, target="l_extendedprice", features=_X)
unchecked("ridge_lasso", lines, target="l_extendedprice", features=_X)
unchecked("quantile_regression", lines, target="l_extendedprice", features=["l_quantity"], quantiles=[0.25, 0.5, 0.75])

# Learning

unchecked("logistic_regression_classification", lines, **_TARGETS)
unchecked("decision_tree", lines, target="l_linestatus", features=_X)
unchecked("random_forest", lines, target="l_linestatus", features=_X, n_trees=10)
unchecked("random_forest_regression", lines, target="l_extendedprice", features=_X[:2], n_trees=10)
unchecked("kmeans", lines, features=_X[:2])
scalars(
    "pca",
    {"first": ("tables.components.0.variance", 0), "second": ("tables.components.1.variance", 6)},
    # eigenvalues of a symmetric two by two matrix
    "WITH s AS (SELECT var_samp(l_extendedprice) AS a, var_samp(l_quantity) AS b, covar_samp(l_extendedprice, l_quantity) AS c FROM lineitem), y AS (SELECT (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS top, a * b - c * c AS d FROM s) SELECT top AS first, d / top AS second FROM y",
    prepare=lines,
    features=["l_quantity", "l_extendedprice"],
)

# Survival

table(
    "kaplan_meier",
    "tables.curve",
    {"g": None, "t": 1, "at_risk": 0, "d": 0, "survival": 6, "se": 6},
    f"""WITH c AS (SELECT g, t, sum(d)::DOUBLE AS d, count(*)::DOUBLE AS n FROM {TIMES} GROUP BY g, t), r AS (SELECT g, t, d, sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS at_risk FROM c), s AS (SELECT g, t, d, at_risk, exp(sum(CASE WHEN at_risk > d THEN ln(1 - d / at_risk) ELSE -1e9 END) OVER (PARTITION BY g ORDER BY t)) AS survival, sum(CASE WHEN at_risk > d THEN d / (at_risk * (at_risk - d)) ELSE 0 END) OVER (PARTITION BY g ORDER BY t) AS v FROM r)
    SELECT g, t, at_risk, d, survival, survival * sqrt(v) AS se FROM s WHERE d > 0""",
    prepare=_times,
    time_column="t",
    event_column="d",
    group_column="g",
)
_GROUPS = ("A", "N", "R")
scalars(
    "log_rank",
    {"statistic": ("test.statistic", 6), "df": ("test.df", 0)},
    f"""WITH w AS (SELECT t, {', '.join(f"coalesce(sum(d) FILTER (g = '{g}'), 0)::DOUBLE AS d{i}, (count(*) FILTER (g = '{g}'))::DOUBLE AS n{i}" for i, g in enumerate(_GROUPS))} FROM {TIMES} GROUP BY t), k AS (SELECT t, {', '.join(f'd{i}, sum(n{i}) OVER (ORDER BY t DESC) AS n{i}' for i in range(3))} FROM w), y AS (SELECT *, d0 + d1 + d2 AS d, n0 + n1 + n2 AS n FROM k WHERE d0 + d1 + d2 > 0),
    v AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS s FROM y), m AS (SELECT sum(d0 - d * n0 / n) AS z0, sum(d1 - d * n1 / n) AS z1, sum(s * n0 / n * (1 - n0 / n)) AS v00, sum(s * n1 / n * (1 - n1 / n)) AS v11, sum(-s * n0 / n * n1 / n) AS v01 FROM v)
    SELECT (z0 * z0 * v11 - 2 * z0 * z1 * v01 + z1 * z1 * v00) / (v00 * v11 - v01 * v01) AS statistic, 2 AS df FROM m""",
    prepare=_times,
    time_column="t",
    event_column="d",
    group_column="g",
)
