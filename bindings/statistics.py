"""Profiles, ranges, quantiles, outliers, histograms, correlation."""

from pyspark.sql import functions as F

from bindings.base import SETPOINTS_SQL, query, rounded, setpoints, stamp, table
from hearthline.operators import plotdata, stats

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A1_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark, sf):
    return stats.shape(table(spark, sf, "lineitem"))


@query(
    "A2_null_counts",
    f"""WITH {SETPOINTS_SQL}
SELECT 'heating' AS "column", count(*) FILTER (heating IS NULL) AS n_missing FROM clean
UNION ALL SELECT 'cooling', count(*) FILTER (cooling IS NULL) FROM clean""",
)
def null_counts(spark, sf):
    return stats.null_counts(setpoints(spark, sf))


def _profile_sql(column):
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean,
 round(stddev_samp({column}), 6) AS std, round(min({column}), 6) AS min,
 round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
 round(quantile_cont({column}, 0.75), 6) AS q75, round(max({column}), 6) AS max FROM lineitem"""


@query("A3_profile_numeric", "\nUNION ALL ".join(_profile_sql(c) for c in LINE_NUMBERS))
def profile_numeric(spark, sf):
    return rounded(stats.profile_numeric(table(spark, sf, "lineitem"), LINE_NUMBERS))


def _text_sql(column):
    return f"""SELECT '{column}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
 arg_min({column}, (-n, {column})) AS top, max(n) AS freq
 FROM (SELECT {column}, count(*) AS n FROM lineitem WHERE {column} IS NOT NULL GROUP BY 1)"""


@query("A4_profile_text", "\nUNION ALL ".join(_text_sql(c) for c in ("l_returnflag", "l_linestatus")))
def profile_text(spark, sf):
    return stats.profile_text(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "A5_column_range",
    f"""WITH {SETPOINTS_SQL}
SELECT 'heating' AS "column", min(heating) AS min, max(heating) AS max FROM clean
UNION ALL SELECT 'cooling', round(min(cooling), 6), round(max(cooling), 6) FROM clean""",
)
def column_range(spark, sf):
    return rounded(stats.column_range(setpoints(spark, sf), ["heating", "cooling"]))


@query(
    "A6_quantiles",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS quantile FROM lineitem"
        for c in ("l_quantity", "l_extendedprice")
        for q in (0.05, 0.25, 0.5, 0.75, 0.99)
    ),
)
def quantiles(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(stats.quantiles(df, ["l_quantity", "l_extendedprice"], [0.05, 0.25, 0.5, 0.75, 0.99]))


@query(
    "A6_quantiles_by_key",
    """SELECT event_type, 'value' AS "column", q, round(CASE q WHEN 0.25 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS quantile
FROM (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.9) AS c
      FROM events GROUP BY 1), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(q)""",
)
def quantiles_by_key(spark, sf):
    return rounded(stats.quantiles(table(spark, sf, "events"), ["value"], [0.25, 0.5, 0.9], keys=["event_type"]))


@query(
    "A6_quantiles_by_bucket",
    """SELECT l_returnflag, 'l_extendedprice' AS "column", q, round(CASE q WHEN 0.25 THEN a ELSE b END, 6) AS quantile
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b
      FROM lineitem GROUP BY 1), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) t(q)""",
)
def quantiles_by_bucket(spark, sf):
    """Brackets of a coarse sketch, which hold few of the rows at every size."""
    df = table(spark, sf, "lineitem")
    return rounded(stats.quantiles(df, ["l_extendedprice"], [0.25, 0.75], keys=["l_returnflag"], accuracy=500))


IQR_SQL = """b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""


@query(
    "A7_iqr_outliers",
    f"""WITH {IQR_SQL} SELECT event_id, value, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def iqr_outliers(spark, sf):
    out = stats.iqr_outliers(table(spark, sf, "events"), "value")
    return rounded(out.select("event_id", "value", "lower", "upper"), 6, "lower", "upper")


@query(
    "A7_iqr_outliers_by_key",
    """WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, count(*) AS n FROM events JOIN b USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY 1""",
)
def iqr_outliers_by_key(spark, sf):
    out = stats.iqr_outliers(table(spark, sf, "events"), "value", keys=["event_type"])
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A8_constant_columns",
    """SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS n_unique, count(DISTINCT l_returnflag) = 1 AS is_constant, NULL::VARCHAR AS value FROM lineitem
UNION ALL SELECT 'l_tax', count(DISTINCT l_tax), count(DISTINCT l_tax) = 1, NULL FROM lineitem
UNION ALL SELECT 'kind', 1, true, 'line' FROM (SELECT count(*) FROM lineitem)""",
)
def constant_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_tax", F.lit("line").alias("kind"))
    return stats.constant_columns(df)


@query(
    "A9_grouped_stats",
    """SELECT CAST(month(o_orderdate) AS BIGINT) AS month, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max
FROM orders GROUP BY 1""",
)
def grouped_stats(spark, sf):
    df = table(spark, sf, "orders").withColumn("month", F.month("o_orderdate").cast("bigint"))
    return rounded(stats.grouped_stats(df, ["month"], "o_totalprice"), 4, "avg")


@query(
    "A10_continuity_check",
    """SELECT event_type, 24 * count(DISTINCT CAST(ts AS DATE)) AS expected_rows, count(*) AS actual_rows,
 CASE WHEN 24 * count(DISTINCT CAST(ts AS DATE)) = count(*) THEN 'ok' ELSE 'gap' END AS status FROM events GROUP BY 1""",
)
def continuity_check(spark, sf):
    df = table(spark, sf, "events").select(
        "event_type", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d")
    )
    return stats.continuity_check(df, ["y", "m", "d"], keys=["event_type"])


def _corr_sql(value="round(corr(a, b), 6)"):
    pairs = [(a, b) for a in LINE_NUMBERS for b in LINE_NUMBERS]
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value} FROM (SELECT {a} AS a, {b} AS b FROM lineitem)" for a, b in pairs
    )


@query("A11_correlation", _corr_sql("round(corr(a, b), 6) AS r"))
def correlation(spark, sf):
    return rounded(stats.correlation_long(table(spark, sf, "lineitem"), LINE_NUMBERS))


@query(
    "V4_correlation_cells",
    _corr_sql("round(corr(a, b), 6) AS r, printf('%.2f', corr(a, b)) AS label").replace("'-0.00'", "'-0.00'"),
)
def correlation_cells(spark, sf):
    return rounded(plotdata.correlation_cells(table(spark, sf, "lineitem"), LINE_NUMBERS))


HISTOGRAM_SQL = """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
n AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)) + 1, 50) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + ((hi - lo) / 50) * (i - 1), 6) AS lower, round(lo + ((hi - lo) / 50) * i, 6) AS upper, coalesce(n.n, 0) AS n
FROM range(1, 51) r(i) CROSS JOIN b LEFT JOIN n ON n.bin = r.i"""


@query("A14_histogram", HISTOGRAM_SQL)
def histogram(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "events"), "value", 50))


@query(
    "A14_histogram_excluded",
    f"""WITH {SETPOINTS_SQL} SELECT count(*) FILTER (isfinite(heating)) AS n_binned,
 count(*) FILTER (heating IS NULL OR NOT isfinite(heating)) AS n_excluded FROM setpoints""",
)
def histogram_excluded(spark, sf):
    return stats.histogram_excluded(setpoints(spark, sf), "heating")


@query("V1_series", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events")
def series(spark, sf):
    df = table(spark, sf, "events").withColumn("ts", stamp(F.col("ts")))
    return plotdata.series(df, "event_id", ["ts", "value"])


@query(
    "V1_series_buckets",
    """SELECT CAST(floor(event_id / 100) AS BIGINT) AS bucket, min(value) AS value_min, max(value) AS value_max, round(avg(value), 6) AS value_avg
FROM events GROUP BY 1""",
)
def series_buckets(spark, sf):
    return rounded(plotdata.series_buckets(table(spark, sf, "events"), "event_id", ["value"], 100), 6, "value_avg")


@query("V2_histogram_bins", HISTOGRAM_SQL.replace("value", "o_totalprice").replace("events", "orders"))
def histogram_bins(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "orders"), "o_totalprice", 50))


@query("V3_point_pairs", "SELECT l_discount AS x, l_tax AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def point_pairs(spark, sf):
    return plotdata.point_pairs(table(spark, sf, "lineitem"), "l_discount", "l_tax")


@query(
    "V3_common_range",
    "SELECT least(min(l_discount), min(l_tax)) AS line_min, greatest(max(l_discount), max(l_tax)) AS line_max FROM lineitem",
)
def common_range(spark, sf):
    return plotdata.common_range(table(spark, sf, "lineitem"), "l_discount", "l_tax")


@query(
    "L3_series_preview",
    "SELECT event_id, value FROM events ORDER BY event_id LIMIT 1000",
)
def series_preview(spark, sf):
    return plotdata.series_preview(table(spark, sf, "events"), "event_id", ["value"], 1000)
