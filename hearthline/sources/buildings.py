"""Building models: JSON of object type, object name and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.sources.tables import write_table

OBJECT_COLUMNS = ("building_id", "type_pos", "object_type", "obj_pos", "object_name", "props")
SHAPE = "map<string,map<string,variant>>"


def read_building_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file, as ``(building_id, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("building_id"), F.col("value").alias("text")
    )


def _last_wins(m: Column) -> Column:
    """Map entries in file order; of several equal keys the last value stays.

    The slower form is only evaluated for maps that do repeat a key.
    """
    keys, values = F.map_keys(m), F.map_values(m)
    distinct = F.array_distinct(keys)
    last = F.transform(
        distinct,
        lambda k: F.struct(
            k.alias("key"), F.element_at(values, -F.array_position(F.reverse(keys), k).cast("int")).alias("value")
        ),
    )
    return F.when(F.size(distinct) == F.size(keys), F.map_entries(m)).otherwise(last)


def parse_building_objects(texts: DataFrame) -> DataFrame:
    """The object table of ``(building_id, text)`` documents.

    Nested maps keep the order of the file; only the leaf properties are
    VARIANT. A type without objects keeps one row without an object name, and a
    building without types one row without a type. A text that is no such document yields no rows here and is counted by
    ``malformed_buildings``.
    """
    parsed = texts.select("building_id", F.from_json("text", SHAPE).alias("_m")).where(F.col("_m").isNotNull())
    types = parsed.select("building_id", F.posexplode_outer(_last_wins(F.col("_m"))).alias("type_pos", "_t"))
    return types.select(
        "building_id",
        "type_pos",
        F.col("_t.key").alias("object_type"),
        F.posexplode_outer(_last_wins(F.col("_t.value"))).alias("obj_pos", "_o"),
    ).select("building_id", "type_pos", "object_type", "obj_pos", F.col("_o.key").alias("object_name"), F.col("_o.value").alias("props"))


def read_building_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_building_objects(read_building_texts(spark, path))


def malformed_buildings(texts: DataFrame) -> DataFrame:
    """``(building_id, broken)`` per document."""
    return texts.select("building_id", F.from_json("text", SHAPE).isNull().alias("broken"))


def write_building_objects(objects: DataFrame, path: str) -> None:
    """Store the object table by type, so later reads touch only their types."""
    write_table(objects, path, "parquet", partition_by=("object_type",))
