"""Choosing, naming and placing columns. All of these only edit the plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import is_numeric, ref, to_double
from hearthline.presets import SIZING_ZONE, TIME_COLUMNS, TRAINING_GENERAL_COLUMNS, TRAINING_OTHER_ZONES


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[ref(n) for n in names])


def zone_column_names(names: Iterable[str], zone: str, case_sensitive: bool = True) -> list[str]:
    if case_sensitive:
        return [n for n in names if zone in n]
    return [n for n in names if zone.lower() in n.lower()]


def select_zone_columns(
    df: DataFrame, zone: str = SIZING_ZONE, time_cols: tuple[str, ...] = ("Time",), case_sensitive: bool = True
) -> DataFrame | None:
    """Time columns, then the columns that name the zone; None without any."""
    found = zone_column_names(df.columns, zone, case_sensitive)
    if not found:
        return None
    return pick(df, [c for c in df.columns if c in time_cols and c not in found] + found)


def missing_columns(df: DataFrame, expected: Iterable[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def schema_conformance(df: DataFrame, expected: Iterable[str]) -> DataFrame:
    """One row per expected column, in order, with ``present`` or ``missing``."""
    rows = [(i, c, "present" if c in df.columns else "missing") for i, c in enumerate(expected)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, status string")


def training_column_names(
    names: list[str],
    zone: str = SIZING_ZONE,
    general: tuple[str, ...] = TRAINING_GENERAL_COLUMNS,
    other_zones: tuple[str, ...] = TRAINING_OTHER_ZONES,
) -> list[str]:
    """General columns, the zone's columns, then those that name no other zone.

    When no column names the zone there is nothing to narrow down, so all stay.
    """
    zone_cols = zone_column_names(names, zone, case_sensitive=False)
    if not zone_cols:
        return list(names)
    first = [c for c in general if c in names]
    rest = [
        c
        for c in names
        if c not in first and not any(z in c for z in other_zones) and "zone" not in c.lower() and c not in zone_cols
    ]
    return first + [c for c in zone_cols if c not in first] + rest


def select_training_columns(df: DataFrame, zone: str = SIZING_ZONE, **options) -> DataFrame:
    return pick(df, training_column_names(df.columns, zone, **options))


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...] = TIME_COLUMNS) -> DataFrame:
    """Put ``prefix_`` before every name except the kept ones, any case."""
    kept = {k.lower() for k in keep}
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c.lower() not in kept})


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text columns to DOUBLE; unreadable text becomes NULL. Absent ones are skipped."""
    wanted = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_double(ref(c).cast("string")) for c in wanted})


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def move_column(df: DataFrame, name: str, position: int) -> DataFrame:
    """The frame with ``name`` at the 0-based ``position``, once."""
    others = [c for c in df.columns if c != name]
    return pick(df, others[:position] + [name] + others[position:])


def drop_colliding(df: DataFrame, taken: Iterable[str], keys: Iterable[str], suffix: str) -> DataFrame:
    """Rename the non-key columns that another frame already has."""
    clash = set(taken) - set(keys)
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c in clash})


def leading_row(df: DataFrame, key: str, value: int = 0) -> DataFrame:
    """Put one row before the others whose only value is the key's.

    The keys of the other rows stay as they are, so the value may occur twice.
    """
    first = df.sparkSession.range(1).select(F.lit(value).cast(df.schema[key].dataType).alias(key))
    return first.unionByName(df, allowMissingColumns=True)
