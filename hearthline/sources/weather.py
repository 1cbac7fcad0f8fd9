"""Weather files: eight header lines, then comma-separated hourly records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.numbers import to_double
from hearthline.presets import WEATHER_COLUMNS, WEATHER_HEADER_LINES, WEATHER_NUMERIC_COLUMNS
from hearthline.sources.tables import text_lines


def read_weather(spark: SparkSession, path: str | list[str], coerce: bool = True) -> DataFrame:
    return parse_weather(text_lines(spark, path), coerce=coerce)


def parse_weather(lines: DataFrame, coerce: bool = True, header: int = WEATHER_HEADER_LINES) -> DataFrame:
    """Records from ``(file, line_no, value)`` lines.

    Keeps ``file``, a 1-based ``row`` number and ``field_count``. Short rows are
    padded with NULL; fields past the last known one only show in the count.
    """
    fields = F.split(F.trim("value"), ",")
    body = lines.where(F.col("line_no") > header).select(
        "file", (F.col("line_no") - header).alias("row"), fields.alias("_f")
    )
    columns = []
    for i, name in enumerate(WEATHER_COLUMNS):
        field = F.get("_f", F.lit(i))
        if coerce and name in WEATHER_NUMERIC_COLUMNS:
            field = to_double(field)
        columns.append(field.alias(name))
    return body.select("file", "row", F.size("_f").alias("field_count"), *columns)


def field_count_violations(weather: DataFrame) -> DataFrame:
    """Records that do not have exactly the known number of fields."""
    return weather.where(F.col("field_count") != len(WEATHER_COLUMNS)).select("file", "row", "field_count")


def weather_location(lines: DataFrame, header: int = WEATHER_HEADER_LINES) -> DataFrame:
    """Header facts per file: number of header lines, city, country, station.

    City and country are reported only when the first line has at least four
    fields; the station only when it has more than five.
    """
    first = F.split(F.trim("value"), ",")
    parts = (
        lines.where(F.col("line_no") <= header)
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("header_lines"),
            F.max(F.when(F.col("line_no") == 1, first)).alias("_f"),
        )
    )
    known = F.size("_f") >= 4
    return parts.select(
        "file",
        "header_lines",
        F.when(known, F.get("_f", F.lit(1))).alias("city"),
        F.when(known, F.get("_f", F.lit(3))).alias("country"),
        F.when(known & (F.size("_f") > 5), F.get("_f", F.lit(5))).alias("station"),
    )
