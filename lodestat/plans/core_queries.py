"""The engine's operators as registered queries over the driver's tables, each with the SQL for its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import correlation, numbers
from ..operators import cleaning, columns, combine, filters, grouping, ordering
from ..operators.columns import POS
from ..sources.readers import read
from ..sources.tables import page_tables
from ..storage import new_folder
from ..stats import association, basic, run_analysis, survival
from ..stats.design import centred_products
from ..streaming import windowed_counts
from . import charts, profile
from .registry import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of places: sums in another order differ in the last bits."""
    return df.select(*[F.round(f"`{f.name}`", places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels where there are any: a table with missing values."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(t(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

# Projections and cells


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return columns.select_columns(t(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(spark, d):
    return columns.drop_columns(t(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query("rename_columns", "SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
def _(spark, d):
    return columns.rename_columns(t(spark, d, "nation"), {"n_nationkey": "id", "n_name": "nation"})


@query("cast_types_integer", "SELECT c_custkey, CAST(round_even(c_acctbal, 0) AS BIGINT) AS c_acctbal FROM customer")
def _(spark, d):
    return columns.cast_types(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "integer")


@query("cast_types_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, d):
    return columns.cast_types(t(spark, d, "part").select("p_partkey", "p_size"), "p_size", "text")


@query("cast_types_numeric", "SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS p_brand FROM part")
def _(spark, d):
    part = t(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).alias("n"), "p_brand")
    return columns.cast_types(columns.cast_types(part, "n", "numeric"), "p_brand", "numeric")


@query("calculate_column", """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  CASE WHEN l_quantity > 25 THEN l_quantity ELSE -l_quantity END AS signed, CAST(l_quantity AS BIGINT) % 7 AS rest FROM lineitem""")
def _(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    df = columns.calculate_column(df, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    df = columns.calculate_column(df, "signed", "where(l_quantity > 25, l_quantity, -l_quantity)")
    df = columns.calculate_column(df, "rest", "l_quantity % 7")
    return df.select("l_orderkey", "l_linenumber", "charge", "signed", F.col("rest").cast("bigint").alias("rest"))


@query("set_values", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'edited' WHEN 2 THEN NULL ELSE r_name END AS r_name FROM region")
def _(spark, d):
    df = t(spark, d, "region").withColumn(POS, F.col("r_regionkey"))
    return columns.set_values(df, [{"row": 1, "column": "r_name", "value": "edited"}, {"row": 2, "column": "r_name", "value": " "}]).drop(POS)


# Filters

for _name, _column, _operator, _value, _where in (
    ("eq", "quality", "eq", 1, "quality = 1"),
    ("ne", "quality", "ne", 1, "quality IS DISTINCT FROM 1"),
    ("gt", "n_chars", "gt", 2000, "n_chars > 2000"),
    ("gte", "n_chars", "gte", "2000", "n_chars >= 2000"),
    ("lt", "n_chars", "lt", 500, "n_chars < 500"),
    ("lte", "n_chars", "lte", 500, "n_chars <= 500"),
    ("between", "n_chars", "between", [3000, 1000], "n_chars BETWEEN 1000 AND 3000"),
    ("in", "lang", "in", ["de", "fr"], "lang IN ('de', 'fr')"),
    ("not_in", "toxic", "not_in", [1], "coalesce(toxic NOT IN (1), true)"),
    ("contains", "source", "contains", "C1", "contains(lower(source), 'c1')"),
    ("startswith", "source", "startswith", "SRC1", "starts_with(lower(source), 'src1')"),
    ("endswith", "source", "endswith", "9", "ends_with(lower(source), '9')"),
    ("is_null", "toxic", "is_null", None, "toxic IS NULL"),
    ("not_null", "toxic", "not_null", None, "toxic IS NOT NULL"),
):

    def _run(spark, d, column=_column, operator=_operator, value=_value):
        return filters.filter_rows(labelled(spark, d), [{"column": column, "operator": operator, "value": value}])

    query(f"filter_{_name}", f"SELECT * FROM {LABELLED} WHERE {_where}")(_run)


@query("filter_or", f"SELECT * FROM {LABELLED} WHERE n_chars < 300 OR lang = 'es'")
def _(spark, d):
    return filters.filter_rows(labelled(spark, d), [{"column": "n_chars", "operator": "lt", "value": 300}, {"column": "lang", "operator": "eq", "value": "es"}], "or")


# Cleaning


@query("drop_duplicates_first", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1")
def _(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").withColumn(POS, F.col("o_orderkey"))
    return cleaning.drop_duplicates(df, ["o_custkey", "o_orderpriority"]).drop(POS)


@query("drop_duplicates_last", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_custkey").withColumn(POS, F.col("o_orderkey"))
    return cleaning.drop_duplicates(df, ["o_custkey"], keep="last").drop(POS)


@query("drop_duplicates_rows", "SELECT DISTINCT * FROM lineitem")
def _(spark, d):
    return cleaning.drop_duplicates(t(spark, d, "lineitem"))


@query("drop_missing_columns", f"SELECT * FROM {LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, d):
    return cleaning.drop_missing(labelled(spark, d), ["quality", "toxic"])


@query("drop_missing_threshold", f"SELECT * FROM {LABELLED} WHERE (quality IS NULL)::INT + (toxic IS NULL)::INT < 2")
def _(spark, d):
    return cleaning.drop_missing(labelled(spark, d), threshold=2)


for _method, _value in (("mean", "(SELECT avg(quality) FROM labels)"), ("median", "(SELECT quantile_cont(quality, 0.5) FROM labels)"), ("zero", "0"), ("constant", "9")):

    def _run(spark, d, method=_method):
        out = cleaning.fill_missing(labelled(spark, d), method, ["quality"], value=9)
        return rounded(out.withColumn("quality", F.col("quality").cast("double")))

    query(f"fill_missing_{_method}", f"SELECT doc_id, lang, source, n_chars, round(coalesce(quality, {_value})::DOUBLE, 6) AS quality, toxic FROM {LABELLED}")(_run)


@query("fill_missing_mode", f"SELECT doc_id, lang, source, n_chars, coalesce(quality, (SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)) AS quality, toxic FROM {LABELLED}")
def _(spark, d):
    return cleaning.fill_missing(labelled(spark, d), "mode", ["quality"])


@query("change_summary", "SELECT (SELECT count(*) FROM labels) AS rows_after, (SELECT count(*) FROM documents) AS rows_before, 6 AS columns_before, 6 AS columns_after, (SELECT 2 * count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_cells_before, 0 AS missing_cells_after, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS rows_removed")
def _(spark, d):
    df = labelled(spark, d)
    return cleaning.change_summary(df, cleaning.drop_missing(df, ["quality"]))


# Grouping


@query("group_by", """SELECT c_mktsegment, c_nationkey, count(c_acctbal) AS c_acctbal_count, round(sum(c_acctbal), 2) AS c_acctbal_sum, round(avg(c_acctbal), 6) AS c_acctbal_mean,
  round(quantile_cont(c_acctbal, 0.5), 6) AS c_acctbal_median, min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max, round(stddev_samp(c_acctbal), 6) AS c_acctbal_std,
  count(DISTINCT c_custkey) AS c_custkey_nunique, count(*) AS row_count FROM customer GROUP BY ALL""")
def _(spark, d):
    out = grouping.group_by(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], {"c_acctbal": ["count", "sum", "mean", "median", "min", "max", "std"], "c_custkey": ["nunique"], "__rows__": ["count"]})
    return rounded(out.withColumn("c_acctbal_sum", F.round("c_acctbal_sum", 2)))


@query("group_by_missing_key", f"SELECT toxic, coalesce(sum(quality), 0)::DOUBLE AS quality_sum, count(quality) AS quality_count FROM {LABELLED} GROUP BY toxic")
def _(spark, d):
    return grouping.group_by(labelled(spark, d), ["toxic"], {"quality": ["sum", "count"]})


@query("value_counts", f"SELECT CAST(toxic AS VARCHAR) AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percentage FROM {LABELLED} GROUP BY toxic")
def _(spark, d):
    return grouping.value_counts(labelled(spark, d), "toxic")


@query("crosstab", f"SELECT lang AS row, coalesce(CAST(toxic AS VARCHAR), '<missing>') AS column, count(*) AS n FROM {LABELLED} GROUP BY ALL")
def _(spark, d):
    return grouping.crosstab(labelled(spark, d), "lang", "toxic")


_KINDS = {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date"}
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS missing, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, {f'round(avg({c}), 4)' if k == 'numeric' else 'NULL'} AS mean, count(DISTINCT {c}) AS distinct FROM lineitem" for c, k in _KINDS.items())


@query("profile_columns", _PROFILE)
def _(spark, d):
    # means of some 10^4: sums in another order differ in the tenth digit
    return rounded(profile.profile_columns(t(spark, d, "lineitem")), 4)


# Joins and appends

for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    def _run(spark, d, how=_how):
        left = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("n"))
        right = t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("n"))
        return combine.merge(left, right, how, on=["key"])

    query(f"merge_{_how}", f"SELECT coalesce(c.c_custkey, o.o_custkey) AS key, c.c_nationkey AS n_left, o.o_orderkey AS o, o.o_orderstatus AS n_right FROM customer c {_sql} orders o ON c.c_custkey = o.o_custkey")(_run)


@query("merge_missing_keys", f"SELECT a.toxic, a.n AS n_left, b.n AS n_right FROM (SELECT toxic, count(*) AS n FROM {LABELLED} WHERE lang = 'en' GROUP BY toxic) a JOIN (SELECT toxic, count(*) AS n FROM {LABELLED} WHERE lang = 'de' GROUP BY toxic) b ON a.toxic IS NOT DISTINCT FROM b.toxic")
def _(spark, d):
    sides = [labelled(spark, d).where(F.col("lang") == x).groupBy("toxic").agg(F.count("*").alias("n")) for x in ("en", "de")]
    return combine.merge(*sides, "inner", on=["toxic"])


@query("append", "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS place, c_acctbal, NULL::VARCHAR AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, s_name, NULL, 'supplier' FROM supplier")
def _(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("place"), "c_acctbal")
    b = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("place"), F.lit("supplier").alias("kind"))
    return combine.append(a, b)


# Order


@query("sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC")
def _(spark, d):
    return ordering.sort(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", "o_totalprice"], [True, False])


@query("top_values", "SELECT CAST(l_quantity AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY l_quantity ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, d):
    return ordering.top_values(t(spark, d, "lineitem"), "l_quantity")


@query("page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 150")
def _(spark, d):
    return ordering.page(t(spark, d, "orders").select("o_orderkey", "o_custkey").withColumn(POS, F.col("o_orderkey")), 3, 50).drop(POS)


@query("sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', o_orderkey, o_custkey, '42')), 1, 2 LIMIT 100")
def _(spark, d):
    return ordering.sample(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 100)


# Exploration and charts


@query("duplicate_rows", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax)")
def _(spark, d):
    n = profile.duplicate_rows(t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax"))
    return spark.createDataFrame([(n,)], "duplicates long")


@query("histogram", """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
  SELECT bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20, 4) AS low, round(any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 20, 4) AS high, count(*) AS n
  FROM (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20))::BIGINT, 19) AS bin, lo, hi FROM orders, b) GROUP BY bin""")
def _(spark, d):
    return rounded(profile.histogram(t(spark, d, "orders"), "o_totalprice", 20), 4)


@query("chart_bar", "SELECT o_orderpriority AS x, 'value' AS series, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(charts.build(t(spark, d, "orders"), "bar", x="o_orderpriority", y="o_totalprice", aggregation="mean")["all"])


@query("chart_line_series", "SELECT x, series, coalesce(value, 0)::DOUBLE AS value FROM (SELECT DISTINCT p_size AS x FROM part ORDER BY 1 LIMIT 50) CROSS JOIN (SELECT p_brand AS series FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) LEFT JOIN (SELECT p_size AS x, p_brand AS series, count(*) AS value FROM part GROUP BY 1, 2) USING (x, series)")
def _(spark, d):
    return charts.build(t(spark, d, "part"), "line", x="p_size", group_by="p_brand")["all"]


@query("chart_pie", "SELECT o_orderstatus AS x, count(*)::DOUBLE AS value, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(charts.build(t(spark, d, "orders"), "pie", x="o_orderstatus")["all"])


@query("chart_box", """SELECT x, n, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 4) AS low, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(least(hi, q3 + 1.5 * (q3 - q1)), 4) AS high FROM (
  SELECT o_orderpriority AS x, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)""")
def _(spark, d):
    return rounded(charts.build(t(spark, d, "orders"), "box", x="o_orderpriority", y="o_totalprice")["all"], 4)


@query("chart_heatmap", "SELECT l_returnflag AS x, l_linestatus AS series, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return rounded(charts.build(t(spark, d, "lineitem"), "heatmap", x="l_returnflag", group_by="l_linestatus", y="l_quantity")["all"], 2)


@query("chart_scatter", "SELECT l_quantity, l_extendedprice FROM lineitem ORDER BY md5(concat_ws('|', l_quantity, l_extendedprice, '42')), 1, 2 LIMIT 500")
def _(spark, d):
    return charts.build(t(spark, d, "lineitem"), "scatter", x="l_quantity", y="l_extendedprice", limit=500)["all"]


@query("page_tables", """SELECT n_regionkey AS page_id, 0 AS "table", (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS "row", ['Key', 'Name & place'] AS names, [n_nationkey::VARCHAR, n_name] AS cells FROM nation""")
def _(spark, d):
    """A page for each region, with a table of its nations."""
    row = F.format_string("<tr><td>%s</td><td><b>%s</b></td></tr>", F.col("n_nationkey").cast("string"), "n_name")
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("row"))))
    pages = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_join(F.transform(rows, lambda r: r.row), "").alias("rows"))
    html = F.concat(F.lit("<html><body><p>Nations</p><table><tr><th>Key</th><th>Name &amp; place</th></tr>"), "rows", F.lit("</table></body></html>"))
    return page_tables(pages.select("page_id", html.alias("html")))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS end, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    out = windowed_counts(t(spark, d, "events"), "ts", "event_type", "value")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), 4)


# Statistics whose aggregates SQL can express


@query("moments", """SELECT 'l_quantity' AS column, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
  quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max, round(sum(l_quantity), 6) AS sum,
  round(any_value(m3) / pow(stddev_samp(l_quantity), 3), 6) AS skewness, round(any_value(m4) / pow(stddev_samp(l_quantity), 4) - 3, 6) AS kurtosis
  FROM lineitem, (SELECT avg(pow(l_quantity - m, 3)) AS m3, avg(pow(l_quantity - m, 4)) AS m4 FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem))""")
def _(spark, d):
    return rounded(basic.moments(t(spark, d, "lineitem"), ["l_quantity"]))


@query("welch_t_test", """SELECT g1 AS g, n1, round(m1, 6) AS mean1, round(v1, 6) AS var1, n2, round(m2, 6) AS mean2, round(v2, 6) AS var2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM (
  SELECT 'F' AS g1, count(*) FILTER (l_linestatus = 'F') AS n1, avg(l_quantity) FILTER (l_linestatus = 'F') AS m1, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v1,
  count(*) FILTER (l_linestatus = 'O') AS n2, avg(l_quantity) FILTER (l_linestatus = 'O') AS m2, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v2 FROM lineitem)""")
def _(spark, d):
    return rounded(basic.welch(t(spark, d, "lineitem"), "l_quantity", "l_linestatus").withColumn("df", F.round("df", 4)))


ANOVA = """SELECT sum(n)::BIGINT AS n, count(*) AS k, round(sum(n * pow(m - grand, 2)), 4) AS between, round(sum((n - 1) * v), 4) AS within, round((sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f
  FROM (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM x GROUP BY g), (SELECT avg(v) AS grand FROM x)"""


@query("one_way_anova", f"WITH x AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem) {ANOVA}")
def _(spark, d):
    return _anova(basic.anova_parts(basic.grouped(t(spark, d, "lineitem"), "l_quantity", "l_returnflag")))


@query("brown_forsythe", f"WITH x AS (SELECT g, abs(v - c) AS v FROM (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem) JOIN (SELECT l_returnflag AS g, quantile_cont(l_quantity, 0.5) AS c FROM lineitem GROUP BY 1) USING (g)) {ANOVA}")
def _(spark, d):
    return _anova(basic.brown_forsythe(basic.grouped(t(spark, d, "lineitem"), "l_quantity", "l_returnflag")))


def _anova(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.round(c, 4) for c in ("between", "within")}))


@query("two_way_anova_cells", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return rounded(t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")))


RANKS = "SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x"


@query("mann_whitney_ranks", f"WITH x AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT g, count(*) AS n, round(sum(r), 2)::DOUBLE AS ranks FROM ({RANKS}) GROUP BY g")
def _(spark, d):
    return rounded(basic.rank_sums(t(spark, d, "orders").where("o_orderstatus IN ('F', 'O')"), "o_totalprice", "o_orderstatus"), 2)


@query("kruskal_wallis_ranks", f"WITH x AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem) SELECT g, count(*) AS n, round(sum(r), 2)::DOUBLE AS ranks FROM ({RANKS}) GROUP BY g")
def _(spark, d):
    return rounded(basic.rank_sums(t(spark, d, "lineitem"), "l_quantity", "l_returnflag"), 2)


@query("paired_difference", "SELECT count(*) AS n, round(avg(l_tax - l_discount), 6) AS mean, round(stddev_samp(l_tax - l_discount), 6) AS sd FROM lineitem")
def _(spark, d):
    a, b = numbers(t(spark, d, "lineitem"), "l_discount", "l_tax")
    return rounded(t(spark, d, "lineitem").agg(F.count(b - a).alias("n"), F.avg(b - a).alias("mean"), F.stddev_samp(b - a).alias("sd")))


@query("pairwise_correlations", """SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL
  SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def _(spark, d):
    return rounded(association.pairwise_correlations(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("spearman", "SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)")
def _(spark, d):
    return rounded(association.spearman_pairs(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("r")))


@query("kendall_tau", """WITH x AS (SELECT quality AS a, toxic AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2)
  SELECT round(sum(sign(p.a - q.a) * sign(p.b - q.b) * p.n * q.n)::DOUBLE / 2, 2) AS s FROM c p, c q""")
def _(spark, d):
    return spark.createDataFrame([(round(float(association.kendall_counts(t(spark, d, "labels"), "quality", "toxic")[1]), 2),)], "s double")


@query("chi_square", """WITH o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT r, c FROM (SELECT DISTINCT r FROM o), (SELECT DISTINCT c FROM o)),
  e AS (SELECT coalesce(n, 0) AS n, (SELECT sum(n) FROM o WHERE r = g.r) * (SELECT sum(n) FROM o WHERE c = g.c)::DOUBLE / (SELECT sum(n) FROM o) AS e FROM g LEFT JOIN o USING (r, c))
  SELECT round(sum(pow(n - e, 2) / e), 4) AS statistic, sum(n)::BIGINT AS n FROM e""")
def _(spark, d):
    m, _, _ = association.contingency(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(round(association.chi_square_of(m)["statistic"], 4), int(m.sum()))], "statistic double, n long")


@query("mcnemar_cells", "SELECT CAST(quality AS VARCHAR) AS row, CAST(toxic AS VARCHAR) AS column, count(*) AS n FROM labels GROUP BY 1, 2")
def _(spark, d):
    return grouping.crosstab(t(spark, d, "labels"), "quality", "toxic", None)


@query("cohens_kappa", """WITH p AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM labels GROUP BY 1, 2), a AS (SELECT a AS k, sum(p) AS p FROM p GROUP BY 1), b AS (SELECT b AS k, sum(p) AS p FROM p GROUP BY 1),
  s AS (SELECT (SELECT coalesce(sum(p), 0) FROM p WHERE a = b) AS po, (SELECT coalesce(sum(a.p * b.p), 0) FROM a JOIN b USING (k)) AS pe) SELECT round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS agreement FROM s""")
def _(spark, d):
    r = run_analysis(t(spark, d, "labels"), "cohens_kappa", row_column="quality", column_column="toxic")["estimate"]
    return spark.createDataFrame([(r["kappa"], r["agreement"])], "kappa double, agreement double")


@query("linear_regression_slope", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, count(*) AS n FROM lineitem")
def _(spark, d):
    n, mean, s = centred_products(t(spark, d, "lineitem").select(*numbers(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")), ["l_quantity", "l_extendedprice"])
    slope = s[0, 1] / s[0, 0]
    return spark.createDataFrame([(round(float(slope), 4), round(float(mean[1] - slope * mean[0]), 3), int(n))], "slope double, intercept double, n long")


@query("partial_correlation", """SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 5) AS r FROM (SELECT corr(l_extendedprice, l_discount) AS xy, corr(l_extendedprice, l_quantity) AS xz, corr(l_discount, l_quantity) AS yz FROM lineitem)""")
def _(spark, d):
    r = run_analysis(t(spark, d, "lineitem"), "partial_correlation", x="l_extendedprice", y="l_discount", controls=["l_quantity"])
    return spark.createDataFrame([(round(r["estimate"]["r"], 5),)], "r double")


@query("cronbach_alpha", "SELECT round(3.0 / 2 * (1 - (var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax)) / var_samp(l_quantity + l_discount + l_tax)), 5)::DOUBLE AS alpha FROM lineitem")
def _(spark, d):
    r = run_analysis(t(spark, d, "lineitem"), "cronbach_alpha", items=["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(round(r["estimate"]["alpha"], 5),)], "alpha double")


TIMES = "(SELECT date_diff('day', o.o_orderdate, l.l_shipdate)::DOUBLE AS t, (l.l_linestatus = 'F')::INT AS d, l.l_returnflag AS g FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate >= o.o_orderdate)"


def _times(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    return j.select(F.datediff("l_shipdate", "o_orderdate").cast("double").alias("t"), (F.col("l_linestatus") == "F").cast("int").alias("d"), F.col("l_returnflag").alias("g"))


@query("kaplan_meier", f"""WITH c AS (SELECT t, sum(d) AS d, count(*) AS n FROM {TIMES} GROUP BY t), r AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM c)
  SELECT 'all' AS g, t, at_risk::BIGINT AS at_risk, d::BIGINT AS d, round(exp(sum(CASE WHEN at_risk > d THEN ln(1 - d / at_risk::DOUBLE) ELSE -1e9 END) OVER (ORDER BY t)), 6) AS survival FROM r QUALIFY d > 0""")
def _(spark, d):
    return rounded(survival.curve(survival.times_of(_times(spark, d), "t", "d")).drop("se"))


@query("log_rank_expected", f"""WITH c AS (SELECT g, t, sum(d) AS d, count(*) AS n FROM {TIMES} GROUP BY ALL), w AS (SELECT t, sum(d) AS d, sum(n) AS n FROM c GROUP BY t), k AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS n FROM w),
  e AS (SELECT x.g, k.t, k.d, k.n, (SELECT coalesce(sum(c.n), 0) FROM c WHERE c.g = x.g AND c.t >= k.t) AS at_risk FROM k, (SELECT DISTINCT g FROM c) x WHERE k.d > 0)
  SELECT g, (SELECT sum(d) FROM c WHERE c.g = e.g)::DOUBLE AS observed, round(sum(d * at_risk / n::DOUBLE), 4) AS expected FROM e GROUP BY g""")
def _(spark, d):
    groups, o, e, _ = survival.log_rank_parts(survival.times_of(_times(spark, d), "t", "d", "g"))
    return spark.createDataFrame([(g, float(a), round(float(b), 4)) for g, a, b in zip(groups, o, e, strict=True)], "g string, observed double, expected double")


@query("weighted_frequencies", "SELECT l_returnflag AS value, round(sum(l_quantity), 2) AS weight, count(*) AS count FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = run_analysis(t(spark, d, "lineitem"), "weighted_frequencies", columns="l_returnflag", weight_column="l_quantity")["tables"]["l_returnflag"]
    return spark.createDataFrame([(r["value"], round(float(r["weight"]), 2), r["count"]) for r in rows], "value string, weight double, count long")


# Delimited text with quoted line feeds, written from documents and read back in splits


@query("read_csv_quoted", "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5, lang FROM documents")
def _(spark, d):
    folder = new_folder(spark, "csv") + ".csv"
    t(spark, d, "documents").select("doc_id", "text", "lang").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    text = F.coalesce("text", F.lit(""))
    return read(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"), "lang")
