"""Sources and sinks, over files and texts that Spark derives from the tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings.base import query, rounded, table
from hearthline.functions import numbers
from hearthline.operators import checks
from hearthline.plans import training, validation
from hearthline.presets import WEATHER_COLUMNS, WEATHER_PHYSICAL_RANGES
from hearthline.session import scratch_path
from hearthline.sources import buildings, tables, weather

# --- tables -----------------------------------------------------------------

READINGS_SQL = """r AS (SELECT event_id, user_id, event_type AS "kind: [C]", CASE WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 13 = 0 THEN 'abc'
 WHEN event_id % 17 = 0 THEN ' 5 ' ELSE CAST(value AS VARCHAR) END AS reading FROM events),
s AS (SELECT event_id, user_id, "kind: [C]", CASE WHEN isnan(TRY_CAST(trim(reading) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(reading) AS DOUBLE) END AS reading FROM r)"""
READINGS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("kind: [C]", T.StringType()),
        T.StructField("reading", T.DoubleType()),
    ]
)


def written_readings(spark, sf, fmt="csv"):
    eid = F.col("event_id")
    text = (
        F.when(eid % 11 == 0, "NaN")
        .when(eid % 13 == 0, "abc")
        .when(eid % 17 == 0, " 5 ")
        .otherwise(F.col("value").cast("string"))
    )
    path = scratch_path(spark, "readings")
    df = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("kind: [C]"), text.alias("reading"))
    tables.write_table(df, path, fmt)
    return path


@query("S1_read_table", f"WITH {READINGS_SQL} SELECT * FROM s")
def read_table(spark, sf):
    return tables.read_table(spark, written_readings(spark, sf), READINGS)


@query(
    "S1_read_table_inferred",
    f"""WITH {READINGS_SQL} SELECT event_id, user_id, "kind: [C]", 'bigint,bigint,string,string' AS kinds, reading = 'abc' AS is_word,
 CASE WHEN reading <> 'NaN' THEN TRY_CAST(trim(reading) AS DOUBLE) END AS number FROM (SELECT event_id, user_id, "kind: [C]", CASE WHEN reading <> 'NaN' THEN reading END AS reading FROM r)""",
)
def read_table_inferred(spark, sf):
    """Types are inferred; the mixed column stays text, without missing values."""
    df = tables.read_table(spark, written_readings(spark, sf))
    kinds = ",".join(kind for _, kind in df.dtypes)
    number = numbers.to_double(F.col("reading"))
    return df.select("event_id", "user_id", "`kind: [C]`", F.lit(kinds).alias("kinds"), (F.col("reading") == "abc").alias("is_word"), number.alias("number"))


@query("S1_read_table_positions", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events")
def read_table_positions(spark, sf):
    """Row numbers over several files written in the order of the events."""
    path = scratch_path(spark, "ordered")
    events = table(spark, sf, "events").select("event_id", "value")
    tables.write_table(events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path, "csv")
    return tables.read_table(spark, path, T.StructType([T.StructField("event_id", T.LongType())]), position="p").select("event_id", "p")


def written_records(spark, sf):
    """CSV files of events, each with its header, some records with a field too many or too few."""
    eid = F.col("event_id")
    fields = F.concat_ws(",", "event_id", "user_id", "event_type")
    line = F.when(eid % 9 == 0, F.concat(fields, F.lit(",more"))).when(eid % 10 == 0, F.col("event_id").cast("string")).otherwise(fields)
    path = scratch_path(spark, "records")
    events = table(spark, sf, "events").select(line.alias("value"), eid, (eid % 8).alias("part"))
    heads = events.select("part").distinct().selectExpr("'id,user,kind' AS value", "-1L AS event_id", "part")
    files = heads.union(events).repartition(8, "part").sortWithinPartitions("part", "event_id")
    files.select("value", "part").write.partitionBy("part").text(path)
    return f"{path}/part=*"


@query(
    "S1_read_table_rescued",
    """SELECT CASE WHEN event_id % 9 = 0 OR event_id % 10 <> 0 THEN user_id END AS "user", event_id AS id,
 CASE WHEN event_id % 9 = 0 THEN concat_ws(',', event_id, user_id, event_type, 'more') WHEN event_id % 10 = 0 THEN CAST(event_id AS VARCHAR) END AS whole
FROM events""",
)
def read_table_rescued(spark, sf):
    """Typed columns, and the whole text of records that do not fit the header."""
    kinds = T.StructType([T.StructField(n, k) for n, k in (("id", T.LongType()), ("user", T.LongType()), ("kind", T.StringType()))])
    return tables.read_table(spark, written_records(spark, sf), kinds, rescued="whole").select("id", "user", "whole")


@query(
    "P2_header_conformance",
    """SELECT t.* FROM (VALUES ('whole', 'event_id', 'present', 1), ('whole', 'user_id', 'present', 2), ('whole', 'value', 'present', 3),
 ('turned', 'event_id', 'present', 2), ('turned', 'user_id', 'present', 1), ('turned', 'value', 'missing', NULL)) AS t(kind, "column", status, place)
WHERE EXISTS (SELECT 1 FROM events)""",
)
def header_conformance(spark, sf):
    """Files of which one kind lacks a column and has the others in another order."""
    path = scratch_path(spark, "headers")
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    tables.write_table(events, f"{path}/whole", "csv")
    tables.write_table(events.select("user_id", "event_id"), f"{path}/turned", "csv")
    found = tables.header_conformance(spark, [f"{path}/whole", f"{path}/turned"], events.columns)
    kind = F.element_at(F.split("file", "/"), -2).alias("kind")
    return found.select(kind, "column", "status", "place").distinct()


@query(
    "S9_csv_load_report",
    """SELECT count(*) AS n_rows, count(*) FILTER (event_id % 9 = 0 OR event_id % 10 = 0) AS n_bad, 'malformed' AS status FROM events GROUP BY event_id % 8""",
)
def csv_load_report(spark, sf):
    return tables.csv_load_report(spark, written_records(spark, sf)).drop("source")


@query(
    "S9_malformed_records",
    """SELECT CASE WHEN event_id % 9 = 0 THEN concat_ws(',', event_id, user_id, event_type, 'more') ELSE CAST(event_id AS VARCHAR) END AS broken
FROM events WHERE event_id % 9 = 0 OR event_id % 10 = 0""",
)
def malformed_records(spark, sf):
    return tables.malformed_records(spark, written_records(spark, sf)).select("broken")


@query(
    "S2_read_prefixed",
    f'WITH {READINGS_SQL} SELECT event_id AS obs_event_id, user_id AS obs_user_id, "kind: [C]" AS "obs_kind: [C]", reading AS obs_reading FROM s',
)
def read_prefixed(spark, sf):
    return tables.read_prefixed(spark, written_readings(spark, sf), "obs", schema=READINGS)


def _round_trip(spark, df, fmt, schema):
    path = scratch_path(spark, f"sink-{fmt}")
    tables.write_table(df, path, fmt)
    return tables.read_table(spark, path, schema, fmt)


ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


@query("S6_csv_sink", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_sink(spark, sf):
    return _round_trip(spark, table(spark, sf, "orders").select(*ORDERS.names), "csv", ORDERS)


@query("S7_json_sink", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def json_sink(spark, sf):
    return _round_trip(spark, table(spark, sf, "orders").select(*ORDERS.names), "json", ORDERS)


SIZING_SQL = """p AS (SELECT p_partkey % 97 AS slot, max(p_retailprice) AS load FROM part GROUP BY 1)"""


@query(
    "S8_sizing_sink",
    f"""WITH {SIZING_SQL} SELECT CAST((slot // 4) % 24 AS INTEGER) AS hour_of_day, CAST(slot % 4 * 15 AS INTEGER) AS quarter_hour,
 load AS "size_SPACE5-1:Load [W]" FROM p""",
)
def sizing_sink(spark, sf):
    part = table(spark, sf, "part").groupBy((F.col("p_partkey") % 97).alias("slot"))
    day = part.agg(F.max("p_retailprice").alias("SPACE5-1:Load [W]"), F.max("p_size").alias("SPACE1-1:Load [W]"))
    side = training.sizing_table(day, order="slot")
    schema = T.StructType(
        [
            T.StructField("hour_of_day", T.IntegerType()),
            T.StructField("quarter_hour", T.IntegerType()),
            T.StructField("size_SPACE5-1:Load [W]", T.DoubleType()),
        ]
    )
    return _round_trip(spark, side, "csv", schema)


# --- building texts ---------------------------------------------------------


def documents(spark, sf):
    """One building model per order; every seventh text is cut off."""
    zone = F.struct(F.col("o_totalprice").alias("volume"), F.col("o_orderstatus").alias("name"))
    one = F.create_map(F.concat(F.lit("Z"), F.col("o_custkey")), zone, F.lit("A0"), zone)
    people = F.create_map(F.lit("P"), F.struct(F.col("o_totalprice").alias("volume"), F.col("o_orderpriority").alias("name")))
    text = F.to_json(F.create_map(F.lit("Zone"), one, F.lit("People"), people))
    cut = F.when(F.col("o_orderkey") % 7 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("building_id"), cut.alias("text"), "o_orderstatus")


@query(
    "S5_building_objects",
    """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey AS building_id, 'Zone' AS object_type, 0 AS type_pos, 0 AS obj_pos, 'Z' || o_custkey AS object_name, o_orderstatus AS name, o_totalprice AS volume FROM o
UNION ALL SELECT o_orderkey, 'Zone', 0, 1, 'A0', o_orderstatus, o_totalprice FROM o
UNION ALL SELECT o_orderkey, 'People', 1, 0, 'P', o_orderpriority, o_totalprice FROM o""",
)
def building_objects(spark, sf):
    objs = buildings.parse_building_objects(documents(spark, sf))
    return objs.select(
        "building_id",
        "object_type",
        "type_pos",
        "obj_pos",
        "object_name",
        F.try_variant_get("props", "$.name", "string").alias("name"),
        F.try_variant_get("props", "$.volume", "double").alias("volume"),
    )


@query(
    "S9_load_report",
    """SELECT o_orderstatus AS source, count(*) AS n_rows, count(*) FILTER (o_orderkey % 7 = 0) AS n_bad,
 CASE WHEN count(*) FILTER (o_orderkey % 7 = 0) = 0 THEN 'ok' ELSE 'malformed' END AS status FROM orders GROUP BY 1""",
)
def load_report(spark, sf):
    docs = documents(spark, sf)
    broken = docs.select("o_orderstatus", F.from_json("text", buildings.SHAPE).isNull().alias("broken"))
    return tables.load_report(broken, "o_orderstatus", "broken")


# --- weather texts ----------------------------------------------------------

# The events of one type as one weather file: eight header lines, then a record
# per event. Some records carry impossible times, text for numbers or too few
# or too many fields.
STATION_SQL = """w AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row, event_id,
 CAST(year(ts) AS DOUBLE) AS y, CASE WHEN event_id % 41 = 0 THEN 13.0 ELSE CAST(month(ts) AS DOUBLE) END AS m, CAST(day(ts) AS DOUBLE) AS d,
 CAST(hour(ts) + 1 AS DOUBLE) AS h, CASE WHEN event_id % 37 = 0 THEN NULL ELSE round(value, 2) END AS dry,
 CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(user_id % 110 AS DOUBLE) END AS rh,
 CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(user_id % 60 AS DOUBLE) END AS wind FROM events)"""


def weather_lines(spark, sf):
    from hearthline.operators.position import with_position

    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "user_id", "value")
    numbered = with_position(events, ["event_id"], keys=["event_type"], name="row", start=1)
    eid, ts = F.col("event_id"), F.col("ts")
    given = {
        "Year": F.year(ts).cast("string"),
        "Month": F.when(eid % 41 == 0, F.lit("13")).otherwise(F.month(ts).cast("string")),
        "Day": F.dayofmonth(ts).cast("string"),
        "Hour": (F.hour(ts) + 1).cast("string"),
        "Minute": F.lit("0"),
        "Dry Bulb Temperature": F.when(eid % 37 == 0, F.lit("n.a.")).otherwise(F.round("value", 2).cast("string")),
        "Relative Humidity": (F.col("user_id") % 110).cast("string"),
        "Wind Speed": (F.col("user_id") % 60).cast("string"),
    }
    fields = [given.get(c, F.lit("1")) for c in WEATHER_COLUMNS]
    whole = F.array(*fields)
    ragged = (
        F.when(eid % 43 == 0, F.slice(whole, 1, 8)).when(eid % 47 == 0, F.array_append(whole, F.lit("extra"))).otherwise(whole)
    )
    body = numbered.select(
        F.col("event_type").alias("file"), (F.col("row") + 8).alias("line_no"), F.array_join(ragged, ",").alias("value")
    )
    firsts = numbered.where("row = 1").select(
        F.col("event_type").alias("file"),
        F.posexplode(
            F.array(
                F.concat_ws(",", F.lit("LOCATION"), F.concat(F.col("event_type"), F.lit("ville")), F.lit("XX"), F.lit("Land"), F.lit("SRC"), F.lit("725300")),
                *[F.lit(f"HEADER {i}") for i in range(2, 9)],
            )
        ).alias("pos", "value"),
    )
    return body.unionByName(firsts.select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "value"))


@query(
    "S3_weather_records",
    f"""WITH {STATION_SQL} SELECT file, row, CAST(CASE WHEN event_id % 43 = 0 THEN 8 WHEN event_id % 47 = 0 THEN 36 ELSE 35 END AS INTEGER) AS field_count,
 y AS "Year", m AS "Month", d AS "Day", h AS "Hour", dry AS "Dry Bulb Temperature", rh AS "Relative Humidity", wind AS "Wind Speed" FROM w""",
)
def weather_records(spark, sf):
    return weather.parse_weather(weather_lines(spark, sf)).select(
        "file", "row", "field_count", "Year", "Month", "Day", "Hour", "Dry Bulb Temperature", "Relative Humidity", "Wind Speed"
    )


@query(
    "S3_field_count_violations",
    f"""WITH {STATION_SQL} SELECT file, row, CAST(CASE WHEN event_id % 43 = 0 THEN 8 ELSE 36 END AS INTEGER) AS field_count FROM w
WHERE event_id % 43 = 0 OR event_id % 47 = 0""",
)
def field_count_violations(spark, sf):
    return weather.field_count_violations(weather.parse_weather(weather_lines(spark, sf)))


@query(
    "S4_weather_location",
    "SELECT event_type AS file, 8 AS header_lines, event_type || 'ville' AS city, 'Land' AS country, '725300' AS station FROM events GROUP BY 1",
)
def weather_location(spark, sf):
    return weather.weather_location(weather_lines(spark, sf))


def _weather_range(column, field, lo, hi):
    return f"""SELECT file, '{column}' AS "column", min({field}) AS min, max({field}) AS max, coalesce(min({field}) < {lo}, false) AS too_low,
 coalesce(max({field}) > {hi}, false) AS too_high, CASE WHEN min({field}) < {lo} OR max({field}) > {hi} THEN 'out_of_range' ELSE 'ok' END AS status FROM w GROUP BY 1"""


@query(
    "P15_weather_ranges",
    f"WITH {STATION_SQL}\n"
    + "\nUNION ALL ".join(
        [
            _weather_range("Dry Bulb Temperature", "dry", -70, 70),
            _weather_range("Relative Humidity", "rh", 0, 100),
            _weather_range("Wind Speed", "wind", 0, 50),
            _weather_range("Direct Normal Radiation", "CASE WHEN event_id % 43 <> 0 THEN 1.0::DOUBLE END", 0, 1500),
        ]
    ),
)
def weather_ranges(spark, sf):
    records = weather.parse_weather(weather_lines(spark, sf))
    return checks.column_range_check(records, WEATHER_PHYSICAL_RANGES, keys=["file"])


@query(
    "C5_weather_time_issues",
    f"""WITH {STATION_SQL} SELECT 'invalid_month' AS "check", file, row, 'Month' AS "column", '13.0' AS value FROM w WHERE event_id % 41 = 0""",
)
def weather_time_issues(spark, sf):
    return validation.validate_weather(weather_lines(spark, sf)).violations


@query(
    "C5_weather_monthly",
    f"""WITH {STATION_SQL} SELECT file, m AS "Month", round(avg(dry), 6) AS avg, min(dry) AS min, max(dry) AS max FROM w GROUP BY 1, 2""",
)
def weather_monthly(spark, sf):
    return rounded(validation.validate_weather(weather_lines(spark, sf)).tables["monthly"], 6, "avg")


@query(
    "C5_weather_continuity",
    f"""WITH {STATION_SQL} SELECT file, 24 * count(DISTINCT (y, m, d)) AS expected_rows, count(*) AS actual_rows,
 CASE WHEN 24 * count(DISTINCT (y, m, d)) = count(*) THEN 'ok' ELSE 'gap' END AS status FROM w GROUP BY 1""",
)
def weather_continuity(spark, sf):
    return validation.validate_weather(weather_lines(spark, sf)).tables["continuity"]


@query(
    "C5_validate_weather",
    f"""WITH {STATION_SQL}
SELECT file, 'invalid_month' AS "check", 'Month' AS "column", count(*) FILTER (event_id % 41 = 0) AS n_bad FROM w GROUP BY 1
UNION ALL SELECT file, 'range', 'Dry Bulb Temperature', count(*) FILTER (dry < -70 OR dry > 70) FROM w GROUP BY 1
UNION ALL SELECT file, 'range', 'Relative Humidity', count(*) FILTER (rh > 100) FROM w GROUP BY 1
UNION ALL SELECT file, 'range', 'Wind Speed', count(*) FILTER (wind > 50) FROM w GROUP BY 1
UNION ALL SELECT file, 'missing_values', 'Dry Bulb Temperature', count(*) FILTER (dry IS NULL) FROM w GROUP BY 1
UNION ALL SELECT file, 'missing_values', 'Wind Speed', count(*) FILTER (wind IS NULL) FROM w GROUP BY 1""",
)
def validate_weather(spark, sf):
    summary = validation.validate_weather(weather_lines(spark, sf)).summary.select("file", "check", "column", "n_bad")
    wanted = [
        ("invalid_month", "Month"),
        ("range", "Dry Bulb Temperature"),
        ("range", "Relative Humidity"),
        ("range", "Wind Speed"),
        ("missing_values", "Dry Bulb Temperature"),
        ("missing_values", "Wind Speed"),
    ]
    return summary.where(F.struct("check", "column").isin([F.struct(F.lit(a), F.lit(b)) for a, b in wanted]))
