"""Assembly of the training set and the sizing tables."""

from conftest import rows

from hearthline.operators.align import assemble, assemble_by_join
from hearthline.operators.columns import select_zone_columns, training_column_names
from hearthline.plans import training


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read_training_set(spark, tmp_path):
    obs = "month,day_of_month,hour,outdoor_temperature,SPACE5-1 temp,SPACE4-1 temp,zone air\n"
    obs += "1,1,0,10.5,20,21,22\n1,1,1,11.5,20,21,22\n13,1,2,12.5,20,21,22\n1,1,24,13.5,20,21,22\n"
    paths = {
        "observations": write(tmp_path / "observations.csv", obs),
        "rewards": write(tmp_path / "rewards.csv", "reward\n-1\n-2\n-3\n"),
        "actions": write(tmp_path / "agent_actions.csv", "Heating_Setpoint_RL,Cooling_Setpoint_RL\n18,24\n19,25\n20,26\n"),
        "simulated": write(tmp_path / "simulated_actions.csv", "Heating_Setpoint_RL\n17\n17\n17\n"),
    }
    made = training.read_training_set(spark, **paths)
    assert made.data.columns == [
        "timestep",
        "date",
        "month",
        "day_of_month",
        "hour",
        "obs_outdoor_temperature",
        "action_Heating_Setpoint_RL",
        "action_Cooling_Setpoint_RL",
        "reward_reward",
        "obs_SPACE5-1 temp",
        "simulated_Heating_Setpoint_RL",
    ]
    got = rows(made.data.selectExpr("timestep", "string(date)", "obs_outdoor_temperature", "reward_reward"))
    assert got == [
        (0, "2021-01-01 00:00:00", 10.5, -1),
        (0, "2021-01-01 00:00:00", 10.5, None),
        (1, "2021-01-01 01:00:00", 11.5, -2),
        (2, None, 12.5, -3),
        (3, "2021-01-02 00:00:00", 13.5, None),
    ]
    assert rows(made.report) == [(4, 3, 1, 0, 0, True)]
    assert made.preview().count() == 5
    moved = training.read_training_set(spark, **paths, align="shift").data
    assert rows(moved, "timestep", "reward_reward") == [(0, None), (1, -1), (2, -2), (3, -3)]
    training.write_training_set(made, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).count()
    assert lines >= 6
    assert training.read_training_set(spark, observations=paths["observations"]) is None
    assert training.read_training_set(spark, rewards=str(tmp_path / "none.csv")) is None
    alone = training.read_training_set(spark, rewards=paths["rewards"])
    assert rows(alone.data, "timestep", "reward_reward") == [(0, -1), (0, None), (1, -2), (2, -3)]


def test_assemble_forms_agree(spark):
    obs = spark.range(6).selectExpr("id AS timestep", "id * 2 AS o")
    act = spark.range(4).selectExpr("id AS timestep", "id * 3 AS a")
    assert rows(assemble(obs, act), "timestep", "o", "a") == rows(assemble_by_join(obs, act), "timestep", "o", "a")
    late = act.where("timestep > 1")
    assert rows(assemble(obs, late), "timestep", "o", "a") == rows(assemble_by_join(obs, late), "timestep", "o", "a")


def test_assemble_keyed(spark):
    obs = spark.range(4).selectExpr("id % 2 AS site", "id div 2 AS timestep", "id AS o")
    act = spark.range(2).selectExpr("id % 2 AS site", "id div 2 AS timestep", "id AS a")
    got = rows(assemble(obs, act, keys=["site"]), "site", "timestep", "o", "a")
    assert got == [(0, 0, 0, 0), (0, 0, 0, None), (0, 1, 2, None), (1, 0, 1, 1), (1, 0, 1, None), (1, 1, 3, None)]


def test_column_choice():
    names = ["timestep", "x", "obs_space5-1", "SPACE1-1 t", "Zone t", "month"]
    assert training_column_names(names) == ["timestep", "month", "obs_space5-1", "x"]
    assert training_column_names(["a", "zone b", "SPACE1"]) == ["a", "zone b", "SPACE1"]


def sizing(spark, n=3, time=True):
    cols = "id AS _pos, 22.0 + id AS `SPACE5-1:Temperature [C]`, 45 + id AS `SPACE5-1:Humidity [%]`, id AS `Other Column`"
    return spark.range(n).selectExpr(*(["lpad(id + 1, 2, '0') || ':00' AS Time"] if time else []), *cols.split(", "))


def test_sizing_columns(spark):
    df = sizing(spark).drop("_pos")
    found = training.sizing_columns(df)
    assert found.columns == ["Time", "SPACE5-1:Temperature [C]", "SPACE5-1:Humidity [%]"]
    assert rows(found)[0] == ("01:00", 22, 45)
    assert training.sizing_columns(df, "SPACE3-1") is None
    assert select_zone_columns(df, "space5-1") is None
    assert len(select_zone_columns(df, "space5-1", case_sensitive=False).columns) == 3


def test_sizing_structure(spark):
    info = training.sizing_structure(sizing(spark), order="_pos").first()
    assert (info["rows"], info["columns"], info["has_time_column"], info["is_daily_data"]) == (3, 4, True, False)
    assert info["time_columns"] == ["Time"] and len(info["zone_columns"]) == 2 and len(info["sample"]) == 2
    assert training.sizing_structure(sizing(spark, 97)).first()["is_daily_data"]


def test_sizing_table(spark):
    assert training.sizing_table(sizing(spark, 3), "_pos").count() == 0
    timed = training.sizing_table(sizing(spark, 96), "_pos")
    assert timed.columns == ["Time", "size_SPACE5-1:Temperature [C]", "size_SPACE5-1:Humidity [%]"]
    derived = training.sizing_table(sizing(spark, 97, time=False), "_pos")
    got = rows(derived, "hour_of_day", "quarter_hour")
    assert len(got) == 97 and (23, 45) in got and got.count((0, 0)) == 2


def test_repeated_keys_are_refused_or_counted(spark):
    import pytest
    from hearthline.operators.align import align_series, compare_series

    many = spark.createDataFrame([(0, 1.0), (0, None), (1, 4.0)], "timestep int, a double")
    one = spark.createDataFrame([(0, 1.0), (1, 4.0)], "timestep int, a double")
    other = spark.createDataFrame([(0, 2.0)], "timestep int, b double")
    with pytest.raises(Exception, match="repeated key"):
        align_series([many, other]).count()
    with pytest.raises(Exception, match="repeated key"):
        align_series([other, many]).select("b").collect()
    assert align_series([one, other]).count() == 2
    assert compare_series(many, one, ["timestep"], ["a"]).first()["status"] == "shape_mismatch"
    with pytest.raises(Exception, match="repeat a key"):
        compare_series(many, many, ["timestep"], ["a"]).collect()
