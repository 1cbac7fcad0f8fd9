"""Weather texts and files."""

import pytest
from conftest import rows

from hearthline.operators.plotdata import series
from hearthline.plans import validation
from hearthline.presets import WEATHER_COLUMNS, WEATHER_NUMERIC_COLUMNS
from hearthline.sources import tables, weather

HEADER = ["LOCATION,Chicago,IL,USA,TMY3,725300,41.98,-87.92,-6.0,201.0"] + [f"HEADER {i}" for i in range(2, 9)]


def record(hour, **given):
    values = {"Year": 1991, "Month": 1, "Day": 1, "Hour": hour, "Minute": 0, "Dry Bulb Temperature": 5.0,
              "Relative Humidity": 50, "Wind Speed": 3.0, "Direct Normal Radiation": 100} | given
    return ",".join(str(values.get(c, 9)) for c in WEATHER_COLUMNS)


def lines(spark, records, name="a.epw"):
    return spark.createDataFrame([(name, i + 1, v) for i, v in enumerate(HEADER + records)], "file string, line_no bigint, value string")


def test_valid(spark):
    report = validation.validate_weather(lines(spark, [record(h) for h in range(1, 6)]))
    assert rows(report.tables["location"]) == [("a.epw", 8, "Chicago", "USA", "725300")]
    assert rows(report.tables["line_counts"]) == [("a.epw", 5, "unexpected")]
    assert rows(report.tables["continuity"]) == [("a.epw", 24, 5, "gap")]
    assert rows(report.tables["monthly"]) == [("a.epw", 1.0, 5.0, 5.0, 5.0)]
    assert report.violations.count() == 0
    assert {r["status"] for r in report.summary.collect()} == {"ok"}
    assert len(WEATHER_COLUMNS) == 35 and len(WEATHER_NUMERIC_COLUMNS) == 24


def test_extremes(spark):
    records = [
        record(1, **{"Dry Bulb Temperature": -80}),
        record(2, **{"Dry Bulb Temperature": 80, "Relative Humidity": -10}),
        record(3, **{"Relative Humidity": 110, "Wind Speed": -5}),
        record(4, **{"Wind Speed": 60}),
        record(5, **{"Direct Normal Radiation": 1600}),
    ]
    found = validation.validate_weather(lines(spark, records)).tables["ranges"]
    assert rows(found, "column", "too_low", "too_high") == [
        ("Direct Normal Radiation", False, True),
        ("Dry Bulb Temperature", True, True),
        ("Relative Humidity", True, True),
        ("Wind Speed", True, True),
    ]


def test_time_issues(spark):
    records = [record(1, Month=13), record(2, Day=32), record(25), record(24), record(5, Hour="x")]
    found = validation.validate_weather(lines(spark, records)).violations
    assert rows(found, "check", "row", "value") == [
        ("invalid_day", 2, "32.0"),
        ("invalid_hour", 3, "25.0"),
        ("invalid_hour", 5, None),
        ("invalid_month", 1, "13.0"),
    ]


def test_hour_24(spark):
    text = lines(spark, [record(23), record(24)])
    plain = validation.validate_weather(text).tables["series"]
    assert [str(r["date"]) for r in plain.orderBy("row").collect()] == ["1991-01-01 23:00:00", "None"]
    moved = validation.validate_weather(text, hour24="next_day").tables["series"]
    assert [str(r["date"]) for r in moved.orderBy("row").collect()] == ["1991-01-01 23:00:00", "1991-01-02 00:00:00"]
    assert series(moved, "row", ["Dry Bulb Temperature"]).count() == 2


def test_ragged_rows(spark):
    records = [record(1), record(2) + ",extra", ",".join(record(3).split(",")[:10])]
    parsed = weather.parse_weather(lines(spark, records))
    assert rows(weather.field_count_violations(parsed)) == [("a.epw", 2, 36), ("a.epw", 3, 10)]
    short = parsed.where("row = 3").first()
    assert short["Relative Humidity"] == 50.0 and short["Wind Speed"] is None


def test_files_in_many_splits(spark, tmp_path):
    """Line numbers hold when a file is cut into splits read by several tasks."""
    for name, n in (("a.epw", 400), ("b.epw", 7)):
        (tmp_path / name).write_text("\n".join(HEADER + [record(1 + i % 24, Minute=i) for i in range(n)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parsed = weather.read_weather(spark, str(tmp_path))
        assert parsed.rdd.getNumPartitions() > 5
        wrong = parsed.where("Minute <> row - 1").count()
        assert wrong == 0
        assert rows(parsed.groupBy("file").count(), "count") == [(400,), (7,)]
        text = tables.text_lines(spark, str(tmp_path))
        assert rows(text.where("line_no = 1"), "value") == [(HEADER[0],), (HEADER[0],)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_short_header(spark):
    text = spark.createDataFrame([("x", 1, "LOCATION,Nowhere")], "file string, line_no bigint, value string")
    assert rows(weather.weather_location(text)) == [("x", 1, None, None, None)]


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        weather.read_weather(spark, "/nowhere/a.epw")
