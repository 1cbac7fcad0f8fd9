"""Single checks on the given tables, and the validation reports."""

from pyspark.sql import functions as F

from bindings.base import OBS_SQL, SETPOINTS_SQL, observations, query, rounded, setpoints, table
from hearthline.operators import checks
from hearthline.plans import validation

LINE = "l_orderkey, l_linenumber, l_partkey"


@query("P8_range_violations", f"SELECT {LINE}, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48")
def range_violations(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return checks.range_violations(df, "l_quantity", 3, 48)


@query("P9_pair_violations", f"SELECT {LINE}, l_tax, l_discount FROM lineitem WHERE l_tax >= l_discount")
def pair_violations(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")
    return checks.pair_violations(df, "l_tax", "l_discount")


@query(
    "P10_extreme_values",
    f"WITH {SETPOINTS_SQL} SELECT position FROM clean WHERE heating < 1.0 OR heating > 40.0",
)
def extreme_values(spark, sf):
    return checks.range_violations(setpoints(spark, sf), "heating", 1.0, 40.0).select("position")


@query(
    "P11_nonfinite_rows",
    f"WITH {SETPOINTS_SQL} SELECT position FROM setpoints WHERE heating IS NULL OR NOT isfinite(heating)",
)
def nonfinite_rows(spark, sf):
    return checks.nonfinite_rows(setpoints(spark, sf), "heating").select("position")


TIMES_SQL = """t AS (SELECT event_id AS row, CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_id % 14 END AS month,
 CAST(day(ts) AS BIGINT) + event_id % 3 AS day, CAST(hour(ts) AS BIGINT) AS hour FROM events)"""


@query(
    "P12_time_field_violations",
    f"""WITH {TIMES_SQL}
SELECT 'invalid_month' AS "check", row, 'month' AS "column", CAST(month AS VARCHAR) AS value FROM t WHERE NOT coalesce(month BETWEEN 1 AND 12, false)
UNION ALL SELECT 'invalid_day', row, 'day', CAST(day AS VARCHAR) FROM t WHERE NOT coalesce(day BETWEEN 1 AND 31, false)
UNION ALL SELECT 'invalid_hour', row, 'hour', CAST(hour AS VARCHAR) FROM t WHERE NOT coalesce(hour BETWEEN 1 AND 24, false)""",
)
def time_field_violations(spark, sf):
    eid, ts = F.col("event_id"), F.col("ts")
    df = table(spark, sf, "events").select(
        eid.alias("row"),
        F.when(eid % 31 != 0, eid % 14).alias("month"),
        (F.dayofmonth(ts) + eid % 3).alias("day"),
        F.hour(ts).cast("bigint").alias("hour"),
    )
    return checks.time_field_violations(df, {"month": (1, 12), "day": (1, 31), "hour": (1, 24)}, ["row"])


def _range_sql(column, lo, hi):
    low = f"min({column}) < {lo}" if lo is not None else "false"
    high = f"max({column}) > {hi}" if hi is not None else "false"
    return f"""SELECT '{column}' AS "column", round(min({column}), 6)::DOUBLE AS min, round(max({column}), 6)::DOUBLE AS max,
 {low} AS too_low, {high} AS too_high, CASE WHEN {low} OR {high} THEN 'out_of_range' ELSE 'ok' END AS status FROM obs"""


TIME_RANGES = {"month": (1, 12), "day_of_month": (1, 31), "hour": (0, 23)}
PHYSICAL_RANGES = {"outdoor_temperature": (-50.0, 39.0), "air_temperature": (-50.0, 50.0), "HVAC_electricity_demand_rate": (0.0, 1e4)}


@query(
    "P13_time_ranges", f"WITH {OBS_SQL}\n" + "\nUNION ALL ".join(_range_sql(c, *r) for c, r in TIME_RANGES.items())
)
def time_ranges(spark, sf):
    return rounded(checks.column_range_check(observations(spark, sf), TIME_RANGES))


@query(
    "P14_physical_ranges",
    f"WITH {OBS_SQL}\n" + "\nUNION ALL ".join(_range_sql(c, *r) for c, r in PHYSICAL_RANGES.items()),
)
def physical_ranges(spark, sf):
    return rounded(checks.column_range_check(observations(spark, sf), PHYSICAL_RANGES))


@query(
    "P16_row_count_check",
    """SELECT l_returnflag, count(*) AS n_rows, CASE WHEN count(*) IN (8760, 8784) THEN 'ok' ELSE 'unexpected' END AS status
FROM lineitem GROUP BY 1""",
)
def row_count_check(spark, sf):
    return checks.row_count_check(table(spark, sf, "lineitem"), [8760, 8784], by=["l_returnflag"])


@query(
    "L1_sample_violations",
    """SELECT 'range' AS "check", o_orderkey, 'o_totalprice' AS "column" FROM (SELECT * FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 400000 ORDER BY o_orderkey LIMIT 5)
UNION ALL SELECT 'pair', o_orderkey, 'o_custkey,o_orderkey' FROM (SELECT * FROM orders WHERE o_custkey >= o_orderkey ORDER BY o_orderkey LIMIT 5)""",
)
def sample_violations(spark, sf):
    rules = [checks.range_rule("o_totalprice", 50000, 400000), checks.pair_rule("o_custkey", "o_orderkey")]
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return checks.violations(df, rules, ["o_orderkey"], 5).select("check", "o_orderkey", "column")


@query("L2_first_rows", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 2")
def first_rows(spark, sf):
    return checks.first_rows(table(spark, sf, "events").select("event_id", "value"), ["event_id"], 2)


@query(
    "L5_key_order",
    "SELECT event_id, user_id FROM events",
)
def key_order(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id").orderBy("event_id")


# --- reports ----------------------------------------------------------------

ACTIONS_SQL = """a AS (SELECT event_id AS position, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 12.0 + value % 16.0 END AS h,
 18.0 + (value * 3.0) % 14.0 AS c FROM events)"""


def actions(spark, sf):
    eid, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        eid.alias("position"),
        F.when(eid % 17 != 0, 12.0 + v % 16.0).alias("Heating_Setpoint_RL"),
        (18.0 + (v * 3.0) % 14.0).alias("Cooling_Setpoint_RL"),
    )


def _fails(check, column, bad):
    return f"""SELECT '{check}' AS "check", '{column}' AS "column", CASE WHEN count(*) FILTER ({bad}) > 0 THEN 'fail' ELSE 'ok' END AS status,
 count(*) FILTER ({bad}) AS n_bad FROM a"""


H, C = "Heating_Setpoint_RL", "Cooling_Setpoint_RL"
ACTION_CHECKS_SQL = "\nUNION ALL ".join(
    [
        """SELECT 'expected_columns' AS "check", '' AS "column", 'ok' AS status, 0 AS n_bad""",
        "SELECT 'columns', '', 'info', NULL",
        _fails("missing_values", H, "h IS NULL"),
        _fails("missing_values", C, "c IS NULL"),
        _fails("range", H, "h < 15 OR h > 25"),
        _fails("range", C, "c < 20 OR c > 30"),
        _fails("pair", f"{H},{C}", "h >= c"),
    ]
)


@query("C1_validate_actions", f"WITH {ACTIONS_SQL}\n{ACTION_CHECKS_SQL}")
def validate_actions(spark, sf):
    return validation.validate_actions(actions(spark, sf)).summary.select("check", "column", "status", "n_bad")


@query(
    "C1_sample_violations",
    f"""WITH {ACTIONS_SQL}, v AS (SELECT 'range' AS "check", '{H}' AS "column", position FROM a WHERE h < 15 OR h > 25
UNION ALL SELECT 'range', '{C}', position FROM a WHERE c < 20 OR c > 30
UNION ALL SELECT 'pair', '{H},{C}', position FROM a WHERE h >= c)
SELECT "check", "column", position FROM (SELECT *, row_number() OVER (PARTITION BY "check", "column" ORDER BY position) AS n FROM v) WHERE n <= 5""",
)
def validate_actions_sample(spark, sf):
    return validation.validate_actions(actions(spark, sf)).tables["samples"].select("check", "column", "position")


@query(
    "C1_violations",
    f"""WITH {ACTIONS_SQL} SELECT 'range' AS "check", '{H}' AS "column", position FROM a WHERE h < 15 OR h > 25
UNION ALL SELECT 'range', '{C}', position FROM a WHERE c < 20 OR c > 30
UNION ALL SELECT 'pair', '{H},{C}', position FROM a WHERE h >= c""",
)
def validate_actions_violations(spark, sf):
    return validation.validate_actions(actions(spark, sf)).violations.select("check", "column", "position")


@query(
    "C2_validate_simulated_actions",
    f"""WITH {ACTIONS_SQL}
SELECT '{H}' AS "column", 'identical' AS status, 0.0 AS mean_diff, 0.0 AS max_diff, 0 AS n_diff FROM (SELECT count(*) FROM a)
UNION ALL SELECT '{C}', 'different', round(avg(abs(c - d)), 6), round(max(abs(c - d)), 6), count(*) FILTER (abs(c - d) > 0)
 FROM (SELECT c, CASE WHEN position % 4 = 0 THEN c + 0.5 ELSE c END AS d FROM a)""",
)
def validate_simulated(spark, sf):
    agent = actions(spark, sf)
    simulated = agent.withColumn(C, F.when(F.col("position") % 4 == 0, F.col(C) + 0.5).otherwise(F.col(C)))
    return rounded(validation.validate_simulated_actions(simulated, agent).tables["comparison"])


REWARDS_SQL = """a AS (SELECT event_id AS position, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('Infinity' AS DOUBLE)
 ELSE value / 10.0 - 5.0 END AS r FROM events), b AS (SELECT quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM a)"""


def rewards(spark, sf):
    eid, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        eid.alias("position"),
        F.when(eid % 17 == 0, None).when(eid % 19 == 0, float("inf")).otherwise(v / 10.0 - 5.0).alias("reward"),
    )


@query(
    "C3_validate_rewards",
    f"""WITH {REWARDS_SQL}
SELECT 'expected_columns' AS "check", '' AS "column", 'ok' AS status, 0 AS n_bad
UNION ALL SELECT 'columns', '', 'info', NULL
UNION ALL {_fails("missing_values", "reward", "r IS NULL")}
UNION ALL {_fails("extreme", "reward", "r < -10 OR r > 10")}
UNION ALL {_fails("finite", "reward", "r IS NULL OR NOT isfinite(r)")}
UNION ALL {_fails("iqr", "reward", "r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1)")}, b""",
)
def validate_rewards(spark, sf):
    return validation.validate_rewards(rewards(spark, sf)).summary.select("check", "column", "status", "n_bad")


OBS_CHECKS = {
    "month": (1, 12),
    "day_of_month": (1, 31),
    "hour": (0, 23),
    "outdoor_temperature": (-50, 50),
    "air_temperature": (-50, 50),
    "HVAC_electricity_demand_rate": (0, 1000000),
}
OBS_COLUMNS = [
    "month",
    "day_of_month",
    "hour",
    "outdoor_temperature",
    "air_temperature",
    "htg_setpoint",
    "clg_setpoint",
    "people_occupant",
    "HVAC_electricity_demand_rate",
]
OBS_ABSENT = [
    "outdoor_humidity",
    "wind_speed",
    "wind_direction",
    "diffuse_solar_radiation",
    "direct_solar_radiation",
    "air_humidity",
    "co2_emission",
    "total_electricity_HVAC",
]


@query(
    "C4_validate_observations",
    f"WITH {OBS_SQL}, a AS (SELECT * FROM obs)\n"
    + "\nUNION ALL ".join(
        [_fails("missing_values", c, f"{c} IS NULL") for c in OBS_COLUMNS]
        + [_fails("range", c, f"{c} < {lo} OR {c} > {hi}") for c, (lo, hi) in OBS_CHECKS.items()]
        + [_fails("pair", "htg_setpoint,clg_setpoint", "htg_setpoint >= clg_setpoint")]
        + [f"SELECT 'expected_columns', '{c}', 'missing', NULL" for c in OBS_ABSENT]
        + [f"SELECT 'range', '{c}', 'skipped', NULL" for c in ("outdoor_humidity", "air_humidity", "wind_speed")]
        + ["SELECT 'columns', '', 'info', NULL"]
    ),
)
def validate_observations(spark, sf):
    df = observations(spark, sf).drop("date").withColumnRenamed("timestep", "position")
    return validation.validate_observations(df).summary.select("check", "column", "status", "n_bad")
