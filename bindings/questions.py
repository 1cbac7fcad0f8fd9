"""The analytical questions over the controller log."""

from pyspark.sql import functions as F

from bindings.base import OBS_SQL, observations, query, rounded, table
from hearthline.plans import questions as qs

N = qs.Names(
    outdoor="outdoor_temperature",
    indoor="air_temperature",
    heating="htg_setpoint",
    cooling="clg_setpoint",
    occupants="people_occupant",
    demand="HVAC_electricity_demand_rate",
)
# The log covers January, so the months of interest are given.
MONTHS = (1, 2)
OUT = "(air_temperature < 20 OR air_temperature > 25)"
LAG_SQL = f"""{OBS_SQL}, l AS (SELECT *, outdoor_temperature - lag(outdoor_temperature) OVER w AS out_change, air_temperature - lag(air_temperature) OVER w AS in_change,
 clg_setpoint - lag(clg_setpoint) OVER w AS clg_change, lag(people_occupant) OVER w AS occ_before, lead(HVAC_electricity_demand_rate) OVER w AS dem_after
 FROM obs WINDOW w AS (ORDER BY timestep))"""


@query(
    "D1_demand_by_outdoor",
    f"""WITH {OBS_SQL} SELECT CAST(floor(outdoor_temperature / 5) * 5 AS BIGINT) AS outdoor_from, count(*) AS n, round(avg(HVAC_electricity_demand_rate), 4) AS avg_demand
FROM obs WHERE month IN (1, 2) GROUP BY 1""",
)
def demand_by_outdoor(spark, sf):
    return rounded(qs.demand_by_outdoor(observations(spark, sf), N, MONTHS), 4)


@query(
    "D1_demand_outdoor_fit",
    f"""WITH {OBS_SQL} SELECT count(*) AS n, round(corr(HVAC_electricity_demand_rate, outdoor_temperature), 6) AS r,
 round(regr_slope(HVAC_electricity_demand_rate, outdoor_temperature), 4) AS slope FROM obs WHERE month IN (1, 2)""",
)
def demand_outdoor_fit(spark, sf):
    return rounded(rounded(qs.demand_outdoor_fit(observations(spark, sf), N, MONTHS), 6, "r"), 4, "slope")


@query(
    "D2_efficiency_by_band",
    f"""WITH {OBS_SQL} SELECT CASE WHEN outdoor_temperature < 30 THEN '25-30' ELSE '30-35' END AS band, count(*) AS n, round(avg(HVAC_electricity_demand_rate), 4) AS avg_demand,
 round(sum(HVAC_electricity_demand_rate) / sum(outdoor_temperature - air_temperature), 4) AS demand_per_degree FROM obs WHERE outdoor_temperature >= 25 AND outdoor_temperature < 35 GROUP BY 1""",
)
def efficiency_by_band(spark, sf):
    return rounded(qs.efficiency_by_band(observations(spark, sf), N), 4)


@query(
    "D3_violations_by_change",
    f"""WITH {LAG_SQL} SELECT abs(out_change) >= 2 AS is_rapid, count(*) AS n, round(avg(CAST({OUT} AS INTEGER)), 6) AS violation_rate FROM l WHERE out_change IS NOT NULL GROUP BY 1""",
)
def violations_by_change(spark, sf):
    return rounded(qs.violations_by_change(observations(spark, sf), N))


@query(
    "D3_violations_on_day",
    f"""WITH {OBS_SQL} SELECT hour, count(*) AS n, count(*) FILTER ({OUT}) AS n_violations, round(avg(outdoor_temperature), 6) AS avg_outdoor,
 round(avg(people_occupant), 6) AS avg_occupants, round(avg(clg_setpoint), 6) AS avg_cooling FROM obs WHERE month = 1 AND day_of_month = 15 GROUP BY 1""",
)
def violations_on_day(spark, sf):
    return rounded(qs.violations_on_day(observations(spark, sf), 1, 15, N))


@query(
    "D4_violations_by_band",
    f"""WITH {OBS_SQL} SELECT 20.0 AS lower, 25.0 AS upper, round(avg(CAST({OUT} AS INTEGER)), 6) AS violation_rate FROM obs
UNION ALL SELECT 19.0, 26.0, round(avg(CAST(air_temperature < 19 OR air_temperature > 26 AS INTEGER)), 6) FROM obs""",
)
def violations_by_band(spark, sf):
    return rounded(qs.violations_by_band(observations(spark, sf), N))


@query(
    "D5_occupied_spikes",
    f"""WITH {LAG_SQL} SELECT timestep, round(HVAC_electricity_demand_rate, 6) AS demand, round(dem_after, 6) AS demand_after FROM l
WHERE occ_before = 0 AND people_occupant > 0 AND dem_after - HVAC_electricity_demand_rate >= 1000""",
)
def occupied_spikes(spark, sf):
    return rounded(qs.occupied_spikes(observations(spark, sf), N))


@query(
    "D6_excess_demand",
    f"""WITH {OBS_SQL}, u AS (SELECT hour, floor(outdoor_temperature / 5) AS bin, avg(HVAC_electricity_demand_rate) AS m, stddev_pop(HVAC_electricity_demand_rate) AS s FROM obs GROUP BY 1, 2)
SELECT timestep, round(HVAC_electricity_demand_rate, 4) AS demand, round((HVAC_electricity_demand_rate - m) / s, 4) AS z_score FROM obs
JOIN u ON u.hour = obs.hour AND u.bin = floor(outdoor_temperature / 5) WHERE s > 0 AND (HVAC_electricity_demand_rate - m) / s > 3""",
)
def excess_demand(spark, sf):
    return rounded(qs.excess_demand(observations(spark, sf), N), 4)


@query(
    "D7_hunting",
    f"""WITH {OBS_SQL}, a AS (SELECT timestep, sign(HVAC_electricity_demand_rate - lag(HVAC_electricity_demand_rate) OVER (ORDER BY timestep)) AS step FROM obs),
b AS (SELECT timestep, CASE WHEN step * lag(step) OVER (ORDER BY timestep) < 0 THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT timestep, CAST(sum(turn) OVER (ORDER BY timestep ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_turns FROM b) SELECT * FROM c WHERE n_turns >= 9""",
)
def hunting(spark, sf):
    return qs.hunting(observations(spark, sf), N, at_least=9)


@query(
    "D8_afternoon_overshoot",
    f"""WITH {OBS_SQL} SELECT hour, count(*) AS n, count(*) FILTER (air_temperature > clg_setpoint) AS n_over, round(avg(CAST(air_temperature > clg_setpoint AS INTEGER)), 6) AS over_rate
FROM obs WHERE hour BETWEEN 12 AND 18 GROUP BY 1""",
)
def afternoon_overshoot(spark, sf):
    return rounded(qs.afternoon_overshoot(observations(spark, sf), N))


@query(
    "D9_sizing_peaks",
    """SELECT 'SPACE5-1:Price [W]' AS "column", max(l_extendedprice) AS peak, min(l_orderkey) FILTER (l_extendedprice = m) AS peak_time FROM lineitem, (SELECT max(l_extendedprice) AS m FROM lineitem)
UNION ALL SELECT 'SPACE5-1:Tax [W]', max(l_tax), min(l_orderkey) FILTER (l_tax = m) FROM lineitem, (SELECT max(l_tax) AS m FROM lineitem)""",
)
def sizing_peaks(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Time"),
        F.col("l_extendedprice").alias("SPACE5-1:Price [W]"),
        F.col("l_tax").alias("SPACE5-1:Tax [W]"),
        "l_quantity",
    )
    return qs.sizing_peaks(df, "SPACE5-1")


@query(
    "D10_setpoint_response",
    f"""WITH {LAG_SQL}, e AS (SELECT timestep, air_temperature AS t FROM l WHERE clg_change <= -2 AND people_occupant > 0)
SELECT CAST(k AS INTEGER) AS step, count(*) AS n, round(avg(o.air_temperature - t), 6) AS avg_change FROM e CROSS JOIN range(1, 5) r(k) JOIN obs o ON o.timestep = e.timestep + k GROUP BY 1""",
)
def setpoint_response(spark, sf):
    return rounded(qs.setpoint_response(observations(spark, sf), N))


@query(
    "D10_indoor_stability",
    f"""WITH {LAG_SQL} SELECT abs(out_change) >= 2 AS is_rapid, count(*) AS n, round(avg(abs(in_change)), 6) AS avg_indoor_change FROM l WHERE out_change IS NOT NULL GROUP BY 1""",
)
def indoor_stability(spark, sf):
    return rounded(qs.indoor_stability(observations(spark, sf), N))


@query(
    "D11_hourly_profile",
    f"""WITH {OBS_SQL} SELECT hour, count(*) AS n, round(avg(air_temperature), 6) AS avg_indoor, round(avg(htg_setpoint), 6) AS avg_heating, round(avg(clg_setpoint), 6) AS avg_cooling,
 round(avg(HVAC_electricity_demand_rate), 4) AS avg_demand FROM obs WHERE month IN (1, 2) AND dayofweek(date) NOT IN (0, 6) GROUP BY 1""",
)
def hourly_profile(spark, sf):
    out = qs.hourly_profile(observations(spark, sf), N, MONTHS)
    return rounded(rounded(out, 6, "avg_indoor", "avg_heating", "avg_cooling"), 4, "avg_demand")


@query(
    "D11_weekday_weekend",
    f"""WITH {OBS_SQL} SELECT dayofweek(date) IN (0, 6) AS is_weekend, count(*) AS n, round(avg(air_temperature), 6) AS avg_indoor, round(stddev_pop(air_temperature), 6) AS std_indoor,
 round(avg(HVAC_electricity_demand_rate), 4) AS avg_demand FROM obs GROUP BY 1""",
)
def weekday_weekend(spark, sf):
    out = qs.weekday_weekend(observations(spark, sf), N)
    return rounded(rounded(out, 6, "avg_indoor", "std_indoor"), 4, "avg_demand")


@query(
    "D12_demand_by_occupancy",
    f"""WITH {OBS_SQL} SELECT CAST(floor(people_occupant / 5) * 5 AS BIGINT) AS occupants_from, count(*) AS n, round(avg(HVAC_electricity_demand_rate), 4) AS avg_demand FROM obs GROUP BY 1""",
)
def demand_by_occupancy(spark, sf):
    return rounded(qs.demand_by_occupancy(observations(spark, sf), N), 4)


@query(
    "D13_state_at",
    f"""WITH {OBS_SQL} SELECT timestep, hour, round(outdoor_temperature, 6) AS outdoor_temperature, htg_setpoint, clg_setpoint FROM obs WHERE timestep = 524""",
)
def state_at(spark, sf):
    out = qs.state_at(observations(spark, sf), 524, N)
    return rounded(out.select("timestep", "hour", "outdoor_temperature", "htg_setpoint", "clg_setpoint"))


@query(
    "D14_deadband_by_time",
    f"""WITH {OBS_SQL} SELECT hour >= 22 OR hour < 6 AS is_night, count(*) AS n, round(avg(clg_setpoint - htg_setpoint), 6) AS avg_deadband FROM obs GROUP BY 1""",
)
def deadband_by_time(spark, sf):
    return rounded(qs.deadband_by_time(observations(spark, sf), N))


def _situation(name, when):
    return f"""SELECT '{name}' AS situation, count(*) AS n, round(avg(htg_setpoint), 6) AS avg_heating, round(avg(clg_setpoint), 6) AS avg_cooling,
 round(min(air_temperature), 6) AS min_indoor FROM obs WHERE {when}"""


@query(
    "D14_policy_by_situation",
    f"WITH {OBS_SQL}\n"
    + "\nUNION ALL ".join(
        [
            _situation("late_afternoon_occupied", "hour BETWEEN 15 AND 18 AND people_occupant > 0"),
            _situation("afternoon_crowded", "hour BETWEEN 12 AND 18 AND people_occupant >= 15"),
            _situation("hot_outdoors", "outdoor_temperature > 30"),
            _situation("low_occupancy", "people_occupant < 5"),
        ]
    ),
)
def policy_by_situation(spark, sf):
    return rounded(qs.policy_by_situation(observations(spark, sf), N))


@query(
    "D15_state_prompts",
    f"""WITH {OBS_SQL} SELECT timestep, printf('Step %d: setpoints %.1f (cooling) and %.1f (heating); outside %.1f, inside %.1f degrees; people present: %d.',
 timestep, clg_setpoint, htg_setpoint, floor(outdoor_temperature), floor(air_temperature), people_occupant) AS prompt FROM obs""",
)
def state_prompts(spark, sf):
    # Whole degrees, since engines round halves differently when they format.
    df = observations(spark, sf)
    return qs.state_prompts(df.withColumns({c: F.floor(c).cast("double") for c in (N.outdoor, N.indoor)}), N)
