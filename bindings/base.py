"""Registry of queries and their SQL, and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can say it, its counterpart."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Round the given (by default all DOUBLE) columns."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names})


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# A controller log derived from the events, one time step per event.
OBS_SQL = """obs AS (
  SELECT event_id AS timestep,
         CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day_of_month, CAST(hour(ts) AS BIGINT) AS hour,
         ts AS date,
         value % 40.0 AS outdoor_temperature,
         18.0 + (value * 7.0) % 10.0 AS air_temperature,
         18.0 + CAST(user_id % 5 AS DOUBLE) AS htg_setpoint,
         21.0 + CAST(user_id % 7 AS DOUBLE) AS clg_setpoint,
         (event_id * 7) % 23 AS people_occupant,
         value * 100.0 AS HVAC_electricity_demand_rate
  FROM events)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    v, user, eid, ts = F.col("value"), F.col("user_id"), F.col("event_id"), F.col("ts")
    return table(spark, sf, "events").select(
        eid.alias("timestep"),
        F.month(ts).cast("bigint").alias("month"),
        F.dayofmonth(ts).cast("bigint").alias("day_of_month"),
        F.hour(ts).cast("bigint").alias("hour"),
        ts.alias("date"),
        (v % 40.0).alias("outdoor_temperature"),
        (18.0 + (v * 7.0) % 10.0).alias("air_temperature"),
        (18.0 + (user % 5).cast("double")).alias("htg_setpoint"),
        (21.0 + (user % 7).cast("double")).alias("clg_setpoint"),
        ((eid * 7) % 23).alias("people_occupant"),
        (v * 100.0).alias("HVAC_electricity_demand_rate"),
    )


# Setpoints, with gaps and infinities, for the checks of single columns.
SETPOINTS_SQL = """setpoints AS (
  SELECT event_id AS position,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('NaN' AS DOUBLE)
              WHEN event_id % 23 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value / 4.0 END AS heating,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE 10.0 + (value * 3.0) % 25.0 END AS cooling
  FROM events),
clean AS (SELECT position, CASE WHEN isnan(heating) THEN NULL ELSE heating END AS heating, cooling FROM setpoints)"""


def setpoints(spark: SparkSession, sf: str) -> DataFrame:
    eid, v = F.col("event_id"), F.col("value")
    heating = (
        F.when(eid % 17 == 0, None)
        .when(eid % 19 == 0, float("nan"))
        .when(eid % 23 == 0, float("inf"))
        .otherwise(v / 4.0)
    )
    cooling = F.when(eid % 29 != 0, 10.0 + (v * 3.0) % 25.0)
    return table(spark, sf, "events").select(
        eid.alias("position"), heating.alias("heating"), cooling.alias("cooling")
    )
