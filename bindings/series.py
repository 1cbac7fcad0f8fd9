"""Positions, runs, alignment, comparison, columns and the assembled set."""

from pyspark.sql import functions as F

from bindings.base import OBS_SQL, SETPOINTS_SQL, observations, query, rounded, setpoints, stamp, table
from hearthline.functions import numbers, times
from hearthline.operators import align, checks, columns, position
from hearthline.plans import training


def numbered_events(spark, sf, kind, prefix):
    """One event type as a series of its own, numbered in event order."""
    df = table(spark, sf, "events").where(F.col("event_type") == kind).select("event_id", "value")
    return columns.prefix_columns(position.with_position(df, ["event_id"]), prefix)


@query(
    "J1_with_position",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS timestep FROM events""",
)
def with_position(spark, sf):
    df = table(spark, sf, "events").select("event_type", "event_id")
    return position.with_position(df, ["event_id"], keys=["event_type"])


@query(
    "J1_with_position_global",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS timestep FROM events",
)
def with_position_global(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts")
    return position.with_position(df, ["ts", "event_id"]).select("event_id", "timestep")


@query(
    "J1_with_position_chunked",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag
 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS timestep FROM lineitem""",
)
def with_position_chunked(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    df = table(spark, sf, "lineitem").select("l_returnflag", *order)
    numbered = position.with_position(df, order, keys=["l_returnflag"], parts=32)
    return numbered.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "timestep")


@query(
    "W2_row_number_of_findings",
    "SELECT n AS row, o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE o_orderstatus = 'P'",
)
def row_number_of_findings(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    numbered = position.with_position(df, ["o_orderkey"], name="row", start=1)
    return numbered.where(F.col("o_orderstatus") == "P").select("row", "o_orderkey")


RUNS_SQL = """WITH a AS (SELECT event_id, {v} AS v{k}, CASE WHEN {v} = lag({v}) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS ({p} ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER ({p} ORDER BY event_id) AS g FROM a)
SELECT {k2}max(v) AS value, count(*) AS length, min(event_id) AS "start", max(event_id) AS "end" FROM b GROUP BY {k2}g HAVING count(*) >= {n}"""


@query("W1_value_runs", RUNS_SQL.format(v="event_type", k="", k2="", p="", n=3))
def value_runs(spark, sf):
    return position.value_runs(table(spark, sf, "events"), "event_type", "event_id", min_len=3)


@query(
    "W1_value_runs_by_key",
    RUNS_SQL.format(v="event_type", k=", k", k2="k, ", p="PARTITION BY k", n=2).replace(
        "FROM events", "FROM (SELECT *, user_id % 3 AS k FROM events)"
    ),
)
def value_runs_by_key(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.col("user_id") % 3)
    return position.value_runs(df, "event_type", "event_id", keys=["k"], min_len=2, parts=50)


SERIES_SQL = """{n} AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS timestep, event_id AS {n}_event_id, value AS {n}_value
 FROM events WHERE event_type = '{t}')"""
CLICK = SERIES_SQL.format(n="click", t="click")
BUY = SERIES_SQL.format(n="buy", t="purchase")
VIEW = SERIES_SQL.format(n="view", t="view")


@query("J2_align_series", f"WITH {CLICK}, {BUY}, {VIEW} SELECT * FROM click FULL JOIN buy USING (timestep) FULL JOIN view USING (timestep)")
def align_series(spark, sf):
    return align.align_series(
        [numbered_events(spark, sf, t, n) for t, n in (("click", "click"), ("purchase", "buy"), ("view", "view"))]
    )


@query(
    "J3_assemble",
    f"""WITH {CLICK}, {BUY}, moves AS (SELECT * FROM buy UNION ALL SELECT 0, NULL, NULL)
SELECT * FROM click FULL JOIN moves USING (timestep)""",
)
def assemble(spark, sf):
    return align.assemble(numbered_events(spark, sf, "click", "click"), numbered_events(spark, sf, "purchase", "buy"))


@query(
    "J3_assemble_shifted",
    f"""WITH {CLICK}, {BUY}, moves AS (SELECT timestep + 1 AS timestep, buy_event_id, buy_value FROM buy)
SELECT * FROM click FULL JOIN moves USING (timestep)""",
)
def assemble_shifted(spark, sf):
    obs, buy = numbered_events(spark, sf, "click", "click"), numbered_events(spark, sf, "purchase", "buy")
    return align.assemble(obs, buy, align="shift")


@query(
    "J3_assemble_by_join",
    f"""WITH {CLICK}, {BUY}, moves AS (SELECT * FROM buy UNION ALL SELECT 0, NULL, NULL)
SELECT * FROM click FULL JOIN moves USING (timestep)""",
)
def assemble_by_join(spark, sf):
    obs, buy = numbered_events(spark, sf, "click", "click"), numbered_events(spark, sf, "purchase", "buy")
    return align.assemble_by_join(obs, buy)


@query(
    "J3_alignment_report",
    f"""WITH {CLICK}, {BUY}, moves AS (SELECT timestep FROM buy UNION ALL SELECT 0)
SELECT (SELECT count(*) FROM click) AS n_left, (SELECT count(*) FROM moves) AS n_right,
 (SELECT count(*) FROM click WHERE timestep NOT IN (SELECT timestep FROM moves)) AS unmatched_left,
 (SELECT count(DISTINCT timestep) FROM moves WHERE timestep NOT IN (SELECT timestep FROM click)) AS unmatched_right,
 1 AS duplicated_keys, (SELECT count(*) FROM click) = (SELECT count(*) FROM moves) AS same_length""",
)
def alignment_report(spark, sf):
    obs, buy = numbered_events(spark, sf, "click", "click"), numbered_events(spark, sf, "purchase", "buy")
    return align.alignment_report(obs, columns.leading_row(buy, "timestep", 0))


@query("U1_leading_row", f"WITH {BUY} SELECT * FROM buy UNION ALL SELECT 0, NULL, NULL")
def leading_row(spark, sf):
    return columns.leading_row(numbered_events(spark, sf, "purchase", "buy"), "timestep", 0)


@query(
    "J4_compare_series",
    """WITH o AS (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 1.01 ELSE o_totalprice END AS b FROM orders)
SELECT 'price' AS "column", 'different' AS status, round(avg(abs(a - b)), 4) AS mean_diff, round(max(abs(a - b)), 4) AS max_diff, count(*) FILTER (abs(a - b) > 0) AS n_diff FROM o
UNION ALL SELECT 'customer', 'identical', 0.0, 0.0, 0 FROM (SELECT count(*) FROM o)""",
)
def compare_series(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    b = a.withColumn("price", F.when(F.col("o_orderkey") % 3 == 0, F.col("price") * 1.01).otherwise(F.col("price")))
    return rounded(align.compare_series(a, b, ["o_orderkey"], ["price", "customer"]), 4)


@query(
    "J4_compare_series_mismatch",
    """SELECT 'o_totalprice' AS "column", 'shape_mismatch' AS status, NULL::DOUBLE AS mean_diff, NULL::DOUBLE AS max_diff, NULL::BIGINT AS n_diff
FROM (SELECT count(*) FROM orders)""",
)
def compare_series_mismatch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return align.compare_series(o, o.where(F.col("o_orderkey") > 5), ["o_orderkey"], ["o_totalprice"])


@query(
    "A13_difference_stats",
    """SELECT l_returnflag, 'l_tax' AS "column", 'different' AS status, round(avg(abs(d - t)), 6) AS mean_diff, round(max(abs(d - t)), 6) AS max_diff,
 count(*) FILTER (abs(d - t) > 0) AS n_diff
FROM (SELECT l_returnflag, l_discount AS d, l_tax AS t FROM lineitem) GROUP BY 1""",
)
def difference_stats(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    lines = position.with_position(table(spark, sf, "lineitem").select("l_returnflag", *order), order, keys=["l_returnflag"])
    a = lines.select("l_returnflag", "timestep", F.col("l_discount").alias("l_tax"))
    b = lines.select("l_returnflag", "timestep", "l_tax")
    return rounded(align.compare_series(a, b, ["timestep"], ["l_tax"], keys=["l_returnflag"]))


@query(
    "J4_compare_series_repeated",
    """SELECT 'value' AS "column", 'shape_mismatch' AS status, NULL::DOUBLE AS mean_diff, NULL::DOUBLE AS max_diff, NULL::BIGINT AS n_diff
FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS k FROM events) WHERE n <> k""",
)
def compare_series_repeated(spark, sf):
    """Several rows per user against one row per user."""
    events = table(spark, sf, "events").select("user_id", "value")
    return align.compare_series(events, events.groupBy("user_id").agg(F.max("value").alias("value")), ["user_id"], ["value"])


# --- columns ----------------------------------------------------------------

ZONED_SQL = """z AS (SELECT l_orderkey AS "Time", l_quantity AS "SPACE5-1:Temperature [C]", l_tax AS "SPACE5-1:Humidity [%]",
 l_discount AS "SPACE4-1:Humidity [%]", l_partkey AS "Other Column", l_suppkey AS "zone air" FROM lineitem)"""


def zoned(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Time"),
        F.col("l_quantity").alias("SPACE5-1:Temperature [C]"),
        F.col("l_tax").alias("SPACE5-1:Humidity [%]"),
        F.col("l_discount").alias("SPACE4-1:Humidity [%]"),
        F.col("l_partkey").alias("Other Column"),
        F.col("l_suppkey").alias("zone air"),
    )


@query("P1_select_zone_columns", f'WITH {ZONED_SQL} SELECT "Time", "SPACE5-1:Temperature [C]", "SPACE5-1:Humidity [%]" FROM z')
def select_zone_columns(spark, sf):
    return columns.select_zone_columns(zoned(spark, sf), "SPACE5-1")


@query("C6_sizing_columns", f'WITH {ZONED_SQL} SELECT "Time", "SPACE5-1:Temperature [C]", "SPACE5-1:Humidity [%]" FROM z')
def sizing_columns(spark, sf):
    return training.sizing_columns(zoned(spark, sf))


@query(
    "P3_select_training_columns",
    f'WITH {ZONED_SQL} SELECT "SPACE5-1:Temperature [C]", "SPACE5-1:Humidity [%]", "Time", "Other Column" FROM z',
)
def select_training_columns(spark, sf):
    return columns.select_training_columns(zoned(spark, sf), "SPACE5-1")


@query(
    "P4_prefix_columns",
    "SELECT event_id AS timestep, value AS reward_value, user_id AS reward_user_id FROM events",
)
def prefix_columns(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("timestep"), "value", "user_id")
    return columns.prefix_columns(df, "reward")


@query(
    "P5_coerce_numeric",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END AS DOUBLE) AS level FROM orders",
)
def coerce_numeric(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1))
    return columns.coerce_numeric(table(spark, sf, "orders").select("o_orderkey", text.alias("level")), ["level", "absent"])


@query("P6_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_columns(spark, sf):
    df = table(spark, sf, "orders")
    return columns.pick(df, columns.numeric_columns(df))


@query(
    "P7_move_column",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, value, user_id FROM events",
)
def move_column(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "user_id", stamp(F.col("ts")).alias("date"))
    return columns.move_column(df, "date", 1)


@query(
    "F5_date_from_parts",
    """SELECT event_id, strftime(make_timestamp(2021, month(ts), day(ts), 0, 0, 0) + to_hours(hour(ts)), '%Y-%m-%d %H:%M:%S') AS date
FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0""",
)
def date_from_parts(spark, sf):
    df = table(spark, sf, "events")
    month = F.when(F.col("event_id") % 7 == 0, 13).otherwise(F.month("ts"))
    return df.select("event_id", stamp(times.date_from_parts(month, F.dayofmonth("ts"), F.hour("ts"), 2021)).alias("date"))


@query(
    "F6_weather_time",
    """SELECT event_id, CASE WHEN hour(ts) < 23 THEN strftime(date_trunc('day', ts) + to_hours(hour(ts) + 1), '%Y-%m-%d %H:%M:%S') END AS date,
 strftime(date_trunc('day', ts) + to_hours(hour(ts) + 1), '%Y-%m-%d %H:%M:%S') AS date_or_next FROM events""",
)
def weather_time(spark, sf):
    parts = [F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts") + 1]
    return table(spark, sf, "events").select(
        "event_id",
        stamp(times.weather_time(*parts)).alias("date"),
        stamp(times.weather_time(*parts, hour24="next_day")).alias("date_or_next"),
    )


@query(
    "F7_position_clock",
    "SELECT event_id, CAST((event_id // 4) % 24 AS INTEGER) AS hour_of_day, CAST(event_id % 4 * 15 AS INTEGER) AS quarter_hour FROM events",
)
def position_clock(spark, sf):
    p = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", times.hour_of_position(p).alias("hour_of_day"), times.quarter_of_position(p).alias("quarter_hour")
    )


@query("F15_joined", "SELECT event_id, concat_ws('-', year(ts), month(ts), day(ts)) AS day FROM events")
def joined(spark, sf):
    parts = [F.year("ts").cast("string"), F.month("ts").cast("string"), F.dayofmonth("ts").cast("string")]
    return table(spark, sf, "events").select("event_id", times.joined(*parts).alias("day"))


@query(
    "F1_split_fields",
    "SELECT p_partkey, split_part(trim(' ' || p_name || ' '), ' ', 1) AS first, split_part(trim(' ' || p_name || ' '), ' ', 2) AS second FROM part",
)
def split_fields(spark, sf):
    fields = F.split(F.trim(F.concat(F.lit(" "), "p_name", F.lit(" "))), " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.get(fields, F.lit(0)).alias("first"), F.coalesce(F.get(fields, F.lit(1)), F.lit("")).alias("second")
    )


@query(
    "F2_text_tests",
    """SELECT o_orderkey, lower(o_orderpriority) AS lowered, contains(o_orderpriority, 'U') AS has_u, starts_with(o_orderpriority, '1') AS is_first,
 ends_with(o_orderpriority, 'LOW') AS is_low, o_orderstatus IN ('F', 'O') AS is_known FROM orders""",
)
def text_tests(spark, sf):
    c = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.lower(c).alias("lowered"),
        c.contains("U").alias("has_u"),
        c.startswith("1").alias("is_first"),
        c.endswith("LOW").alias("is_low"),
        F.col("o_orderstatus").isin("F", "O").alias("is_known"),
    )


@query(
    "F4_safe_number",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events""",
)
def safe_number(spark, sf):
    text = F.when(F.col("event_id") % 9 == 0, F.concat("event_type", F.col("value").cast("string"))).otherwise(
        F.concat(F.lit(" "), F.col("value").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", numbers.to_double(text).alias("value"))


@query(
    "F8_finite_difference",
    f"""WITH {SETPOINTS_SQL} SELECT position, CASE WHEN isfinite(heating) THEN round(abs(heating - cooling), 6) END AS gap,
 NOT coalesce(isfinite(heating), false) OR NOT coalesce(isfinite(cooling), false) AS is_bad FROM clean""",
)
def finite_difference(spark, sf):
    df = setpoints(spark, sf)
    bad = checks.nonfinite(F.col("heating"))
    return df.select(
        "position",
        F.when(~bad, F.round(F.abs(F.col("heating") - F.col("cooling")), 6)).alias("gap"),
        (bad | checks.nonfinite(F.col("cooling"))).alias("is_bad"),
    )


# --- the assembled set ------------------------------------------------------

TRAINING_SQL = f"""WITH {OBS_SQL},
rewards AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS timestep, value AS reward_reward FROM events WHERE event_type = 'view'),
agent AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS timestep, value AS "action_Heating_Setpoint_RL", user_id AS "action_Cooling_Setpoint_RL" FROM events WHERE event_type = 'click'),
sim AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS timestep, value AS "simulated_Heating_Setpoint_RL" FROM events WHERE event_type = 'signup'),
moves AS (SELECT * FROM rewards FULL JOIN agent USING (timestep) FULL JOIN sim USING (timestep) {{dummy}}),
o AS (SELECT timestep, month, day_of_month, hour, outdoor_temperature AS obs_outdoor_temperature, air_temperature AS "obs_SPACE5-1_air" FROM obs),
c AS (SELECT * FROM o FULL JOIN moves USING (timestep))
SELECT timestep, strftime(CAST(make_date(2021, month, day_of_month) AS TIMESTAMP) + to_hours(CAST(hour AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS date,
 month, day_of_month, hour, round(obs_outdoor_temperature, 6) AS obs_outdoor_temperature,
 "action_Heating_Setpoint_RL", "action_Cooling_Setpoint_RL", reward_reward, round("obs_SPACE5-1_air", 6) AS "obs_SPACE5-1_air", "simulated_Heating_Setpoint_RL" FROM c"""


def training_set(spark, sf, **options):
    obs = observations(spark, sf).select(
        "timestep",
        "month",
        "day_of_month",
        "hour",
        F.col("outdoor_temperature").alias("obs_outdoor_temperature"),
        F.col("air_temperature").alias("obs_SPACE5-1_air"),
        (F.col("air_temperature") - 1).alias("obs_SPACE4-1_air"),
    )

    def series(kind, prefix, **named):
        df = table(spark, sf, "events").where(F.col("event_type") == kind)
        numbered = position.with_position(df.select("event_id", *named), ["event_id"]).drop("event_id")
        return columns.prefix_columns(numbered.withColumnsRenamed(named), prefix)

    data = training.combine(
        obs,
        rewards=series("view", "reward", value="reward"),
        actions=series("click", "action", value="Heating_Setpoint_RL", user_id="Cooling_Setpoint_RL"),
        simulated=series("signup", "simulated", value="Heating_Setpoint_RL"),
        **options,
    )
    out = data.withColumn("date", stamp(F.col("date")))
    return rounded(out, 6, "obs_outdoor_temperature", "obs_SPACE5-1_air")


@query("C8_training_set", TRAINING_SQL.format(dummy="UNION ALL SELECT 0, NULL, NULL, NULL, NULL"))
def combined(spark, sf):
    return training_set(spark, sf)


@query(
    "C8_training_set_shifted",
    TRAINING_SQL.format(dummy="").replace("moves AS (SELECT * FROM rewards", "moves AS (SELECT timestep + 1 AS timestep, * EXCLUDE (timestep) FROM rewards"),
)
def combined_shifted(spark, sf):
    return training_set(spark, sf, align="shift")


@query(
    "C7_sizing_structure",
    f"""WITH {ZONED_SQL} SELECT count(*) AS rows, 6 AS columns, true AS has_time_column, 'Time' AS time_columns,
 'SPACE5-1:Temperature [C];SPACE5-1:Humidity [%]' AS zone_columns,
 'Time;SPACE5-1:Temperature [C];SPACE5-1:Humidity [%];SPACE4-1:Humidity [%];Other Column;zone air' AS numeric_columns,
 count(*) IN (96, 97, 98) AS is_daily_data FROM z""",
)
def sizing_structure(spark, sf):
    found = training.sizing_structure(zoned(spark, sf)).drop("sample")
    return found.withColumns({c: F.array_join(c, ";") for c in ("time_columns", "zone_columns", "numeric_columns")})
