"""Validation of building models and extraction of zone features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.operators import objects as ob
from hearthline.plans.validation import CheckReport, Tables
from hearthline.sources.buildings import malformed_buildings, parse_building_objects, read_building_texts
from hearthline.sources.tables import load_report


def validate_buildings(objs: DataFrame) -> CheckReport:
    """Presence checks per building; the rest as tables.

    ``objs`` is scanned by every table, so hand in a stored object table rather
    than the parse of the texts.
    """
    return CheckReport(
        ob.presence_checks(objs),
        ob.required_objects(objs),
        Tables(
            summary=lambda: ob.building_summary(objs),
            object_counts=lambda: ob.object_counts(objs),
            category_counts=lambda: ob.category_counts(objs),
            zones=lambda: ob.zones(objs).select("building_id", "zone", "display_name"),
            adjacency=lambda: ob.named_adjacency(objs),
            connections=lambda: ob.zone_connections(objs),
        ),
    )


def read_buildings(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The object table of building files, and which files could not be read."""
    texts = read_building_texts(spark, path)
    return parse_building_objects(texts), load_report(malformed_buildings(texts), "building_id", "broken")


def extract_zone_features(objs: DataFrame, zone: str | None = None, **options) -> DataFrame:
    return ob.zone_features(objs, zone, **options)
