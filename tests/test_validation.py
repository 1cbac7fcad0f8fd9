"""Fixtures of actions, rewards and observations with exact findings."""

import math

import pytest
from conftest import rows

from hearthline.operators import checks, columns
from hearthline.plans import validation

INF, NAN = math.inf, math.nan


def positioned(spark, names, values, kinds=None):
    kinds = kinds or ["double"] * len(names)
    schema = "position bigint, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], schema)


def counts(report):
    return {(r["check"], r["column"]): (r["status"], r["n_bad"]) for r in report.summary.collect()}


H, C = "Heating_Setpoint_RL", "Cooling_Setpoint_RL"


@pytest.mark.parametrize(
    "values, heating, cooling, pair, nulls",
    [
        ([(18.5, 23.5), (19.5, 28.5), (24.5, 24.75)], 0, 0, 0, 0),
        ([(19.25, 29.5), (16.5, 22.25), (None, 24.0), (17.5, 23.0)], 0, 0, 0, 1),
        ([(12.5, 19.0), (18.75, 24.25), (26.5, 31.5), (23.0, 29.0)], 2, 2, 0, 0),
        ([(17.25, 21.5), (25.5, 24.5)], 1, 0, 1, 0),
        ([(15.0, 20.0), (25.0, 30.0)], 0, 0, 0, 0),
        ([(20.0, 20.0)], 0, 0, 1, 0),
    ],
)
def test_actions(spark, values, heating, cooling, pair, nulls):
    found = counts(validation.validate_actions(positioned(spark, [H, C], values)))
    assert found["range", H][1] == heating
    assert found["range", C][1] == cooling
    assert found["pair", f"{H},{C}"][1] == pair
    assert found["missing_values", H][1] == nulls
    assert found["expected_columns", ""] == ("ok", 0)


def test_actions_missing_column(spark):
    df = positioned(spark, [H], [(20.0,), (26.0,)])
    found = counts(validation.validate_actions(df))
    assert found["expected_columns", C] == ("missing", None)
    assert found["range", C] == ("skipped", None)
    assert found["pair", f"{H},{C}"] == ("skipped", None)
    assert found["range", H] == ("fail", 1)
    with pytest.raises(KeyError):
        validation.validate_actions(df, strict=True)


def test_sample_keeps_first_five_in_order(spark):
    df = positioned(spark, [H, C], [(40.0, 50.0)] * 9).repartition(4)
    report = validation.validate_actions(df)
    for found, n in ((report.tables["samples"], 5), (report.violations, 9), (validation.validate_actions(df, samples=2).tables["samples"], 2)):
        assert rows(found, "check", "column", "position") == sorted([("range", c, i) for c in (H, C) for i in range(n)], key=repr)
    assert report.violations.where("position = 0").first()["row_json"].startswith('{"position":0')


def test_simulated_actions_comparison(spark):
    agent = positioned(spark, [H, C], [(20.0, 25.0), (21.0, None), (22.0, 27.0)])
    same = validation.validate_simulated_actions(agent, agent).tables["comparison"]
    assert rows(same, "column", "status", "n_diff") == [(C, "identical", 0), (H, "identical", 0)]
    other = positioned(spark, [H, C], [(20.0, 25.5), (21.5, None), (22.0, 28.0)])
    diff = validation.validate_simulated_actions(other, agent).tables
    assert rows(diff["comparison"]) == [(C, "different", 0.75, 1.0, 2), (H, "different", 0.5 / 3, 0.5, 1)]
    shorter = validation.validate_simulated_actions(agent.where("position < 2"), agent).tables["comparison"]
    assert {r["status"] for r in shorter.collect()} == {"shape_mismatch"}
    assert rows(diff["constants"], "column", "n_unique") == [(C, 2), (H, 3)]
    assert rows(diff["equal_line"]) == [(20.0, 28.0)]


def rewards(spark, values):
    return positioned(spark, ["reward"], [(v,) for v in values])


@pytest.mark.parametrize(
    "values, iqr, extreme, finite, nulls",
    [
        ([-2.0, -1.25, 0.75, 1.5, 2.25, 3.0], 0, 0, 0, 0),
        ([None, -3.5, 0.25, 2.75], 0, 0, 1, 1),
        ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 21.0, -18.5], 2, 2, 0, 0),
        ([NAN, 2.5, INF, -2.5, -INF], 0, 2, 3, 1),
    ],
)
def test_rewards(spark, values, iqr, extreme, finite, nulls):
    found = counts(validation.validate_rewards(rewards(spark, values)))
    assert found["iqr", "reward"][1] == iqr
    assert found["extreme", "reward"][1] == extreme
    assert found["finite", "reward"][1] == finite
    assert found["missing_values", "reward"][1] == nulls


def test_reward_bounds(spark):
    df = rewards(spark, [-14.0, 2.0, 4.0, 6.0, 8.0])
    report = validation.validate_rewards(df)
    assert rows(report.tables["iqr_bounds"]) == [(2.0, 6.0, -4.0, 12.0)]
    assert rows(report.violations.where("check = 'iqr'"), "position") == [(0,)]


def test_constant_rewards(spark):
    report = validation.validate_rewards(rewards(spark, [0.5] * 5))
    assert rows(report.tables["constants"]) == [("reward", 1, True, "0.5")]
    bins = report.tables["histogram"].where("n > 0").collect()
    assert len(bins) == 1 and bins[0]["n"] == 5


def test_reward_runs(spark):
    report = validation.validate_rewards(rewards(spark, [0.5] * 150 + [0.7] * 150 + [0.9] * 100 + [NAN] * 150))
    assert rows(report.tables["runs"]) == [(0.5, 150, 0, 149), (0.7, 150, 150, 299)]


def test_rewards_missing_column(spark):
    df = positioned(spark, ["incorrect_column"], [(1.0,)])
    found = counts(validation.validate_rewards(df))
    assert found["expected_columns", "reward"] == ("missing", None)
    assert found["extreme", "reward"] == ("skipped", None)
    with pytest.raises(KeyError):
        validation.validate_rewards(df, strict=True)


OBS = {
    "month": ("bigint", [1, 2, 3, 4, 5]),
    "day_of_month": ("bigint", [15, 16, 17, 18, 19]),
    "hour": ("bigint", [8, 9, 10, 11, 12]),
    "outdoor_temperature": ("double", [10.5, 12.3, 15.7, 18.2, 20.1]),
    "outdoor_humidity": ("double", [45.0, 48.5, 50.2, 52.7, 55.0]),
    "wind_speed": ("double", [5.2, 4.8, 6.1, 7.3, 5.9]),
    "wind_direction": ("bigint", [120, 135, 150, 165, 180]),
    "diffuse_solar_radiation": ("bigint", [100, 120, 140, 160, 180]),
    "direct_solar_radiation": ("bigint", [250, 300, 350, 400, 450]),
    "htg_setpoint": ("double", [18.0] * 5),
    "clg_setpoint": ("double", [24.0] * 5),
    "air_temperature": ("double", [21.5, 22.0, 22.5, 23.0, 23.5]),
    "air_humidity": ("double", [35.0, 36.0, 37.0, 38.0, 39.0]),
    "people_occupant": ("bigint", [10, 15, 20, 25, 30]),
    "co2_emission": ("bigint", [500, 550, 600, 650, 700]),
    "HVAC_electricity_demand_rate": ("double", [5000.0, 5500.0, 6000.0, 6500.0, 7000.0]),
    "total_electricity_HVAC": ("bigint", [15000, 16000, 17000, 18000, 19000]),
}


def observations(spark, change=None, only=None):
    data = {k: (t, list(v)) for k, (t, v) in OBS.items() if only is None or k in only}
    for (name, i), value in (change or {}).items():
        data[name][1][i] = value
    return positioned(spark, list(data), list(zip(*[v for _, v in data.values()])), [t for t, _ in data.values()])


def failing(report):
    return {k: v[1] for k, v in counts(report).items() if v[0] == "fail"}


def test_observations_valid(spark):
    report = validation.validate_observations(observations(spark))
    assert failing(report) == {}
    assert {r["status"] for r in report.tables["ranges"].collect()} == {"ok"}
    cells = {(r["col_a"], r["col_b"]): r["label"] for r in report.tables["correlation"].collect()}
    assert cells["month", "hour"] == "1.00"
    assert cells["htg_setpoint", "month"] is None
    assert len(cells) == 17 * 17


@pytest.mark.parametrize(
    "change, expected",
    [
        (
            {("outdoor_temperature", 1): None, ("air_humidity", 3): None},
            {("missing_values", "outdoor_temperature"): 1, ("missing_values", "air_humidity"): 1},
        ),
        (
            {("month", 0): 0, ("day_of_month", 1): 32, ("hour", 2): 24},
            {("range", "month"): 1, ("range", "day_of_month"): 1, ("range", "hour"): 1},
        ),
        (
            {("outdoor_temperature", 0): -60.0, ("outdoor_humidity", 1): 110.0, ("wind_speed", 2): -5.0},
            {("range", "outdoor_temperature"): 1, ("range", "outdoor_humidity"): 1, ("range", "wind_speed"): 1},
        ),
        ({("htg_setpoint", 0): 25.0}, {("pair", "htg_setpoint,clg_setpoint"): 1}),
        (
            {("HVAC_electricity_demand_rate", 0): -1000.0, ("HVAC_electricity_demand_rate", 1): 2e6},
            {("range", "HVAC_electricity_demand_rate"): 2},
        ),
    ],
)
def test_observation_findings(spark, change, expected):
    report = validation.validate_observations(observations(spark, change))
    assert failing(report) == expected


def test_demand_below_and_above(spark):
    df = observations(spark, {("HVAC_electricity_demand_rate", 0): -1000.0, ("HVAC_electricity_demand_rate", 1): 2e6})
    found = validation.validate_observations(df).tables["ranges"]
    row = found.where("column = 'HVAC_electricity_demand_rate'").first()
    assert (row["too_low"], row["too_high"], row["min"], row["max"]) == (True, True, -1000.0, 2e6)


def test_observations_missing_columns(spark):
    kept = ["month", "day_of_month", "hour", "outdoor_temperature", "air_temperature"]
    found = counts(validation.validate_observations(observations(spark, only=kept)))
    assert sum(v == ("missing", None) for v in found.values()) == 12
    assert found["range", "outdoor_temperature"] == ("ok", 0)
    assert found["range", "wind_speed"] == ("skipped", None)


def test_schema_conformance(spark):
    df = spark.createDataFrame([(1, 2)], "a int, c int")
    assert rows(columns.schema_conformance(df, ["a", "b", "c"])) == [
        (0, "a", "present"),
        (1, "b", "missing"),
        (2, "c", "present"),
    ]


def test_nan_is_no_violation(spark):
    df = positioned(spark, ["v"], [(NAN,), (None,), (INF,), (3.0,)])
    assert rows(checks.range_violations(df, "v", 0, 10), "position") == [(2,)]
    assert rows(checks.nonfinite_rows(df, "v"), "position") == [(0,), (1,), (2,)]
