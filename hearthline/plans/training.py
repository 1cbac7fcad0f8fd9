"""Assembly of the training set, and the zone-sizing side table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.numbers import ref
from hearthline.functions.times import date_from_parts, hour_of_position, quarter_of_position
from hearthline.operators.align import align_series, alignment_report, assemble
from hearthline.operators.columns import (
    move_column,
    numeric_columns,
    pick,
    prefix_columns,
    select_training_columns,
    select_zone_columns,
    zone_column_names,
)
from hearthline.operators.plotdata import series_preview
from hearthline.presets import (
    PREVIEW_ROWS,
    SIZING_ROW_COUNTS,
    SIZING_TIME_COLUMNS,
    SIZING_ZONE,
    TRAINING_GENERAL_COLUMNS,
    TRAINING_YEAR,
)
from hearthline.sources.tables import read_prefixed, read_table, write_table

POSITION = "timestep"


@dataclass
class TrainingSet:
    data: DataFrame
    report: DataFrame | None
    sizing: DataFrame | None = None

    def preview(self, cols: Sequence[str] = ("obs_outdoor_temperature", "reward_reward")) -> DataFrame | None:
        """First rows of the plotted columns, when they exist."""
        if not all(c in self.data.columns for c in cols):
            return None
        return series_preview(self.data, POSITION, cols, PREVIEW_ROWS)


def add_date(df: DataFrame, year: int = TRAINING_YEAR, name: str = "date") -> DataFrame:
    """Date from month, day_of_month and hour, put in second place."""
    if not all(c in df.columns for c in ("month", "day_of_month", "hour")):
        return df
    dated = df.withColumn(name, date_from_parts(ref("month"), ref("day_of_month"), ref("hour"), year))
    return move_column(dated, name, 1)


def combine(
    observations: DataFrame | None,
    rewards: DataFrame | None = None,
    actions: DataFrame | None = None,
    simulated: DataFrame | None = None,
    keys: Sequence[str] = (),
    align: str = "reference",
    zone: str = SIZING_ZONE,
    year: int = TRAINING_YEAR,
) -> DataFrame | None:
    """The training set from positioned, prefixed series; None without actions.

    Every input has the column ``timestep`` (and the ``keys``), once per row.
    Time columns of the action series would clash with the observations' and
    get the series' name.
    """
    acting = {"reward": rewards, "action": actions, "simulated": simulated}
    by = [*keys, POSITION]
    taken = set(observations.columns) if observations is not None else set()
    parts = []
    for name, df in acting.items():
        if df is not None:
            df = df.withColumnsRenamed({c: f"{c}_{name}" for c in df.columns if c in taken and c not in by})
            taken |= set(df.columns)
        parts.append(df)
    combined = assemble(observations, parts, POSITION, keys, align)
    if combined is None:
        return None
    chosen = select_training_columns(combined, zone, general=(*keys, *TRAINING_GENERAL_COLUMNS))
    return add_date(chosen, year)


def read_training_set(
    spark: SparkSession,
    observations: str | None = None,
    rewards: str | None = None,
    actions: str | None = None,
    simulated: str | None = None,
    sizing: str | None = None,
    schemas: dict | None = None,
    fmt: str = "csv",
    **options,
) -> TrainingSet | None:
    """Read the files, number their rows and combine them."""
    schemas = schemas or {}

    def load(path: str | None, prefix: str) -> DataFrame | None:
        if path is None:
            return None
        return read_prefixed(spark, path, prefix, schema=schemas.get(prefix), fmt=fmt, position=POSITION)

    obs = load(observations, "obs")
    acting = [load(rewards, "reward"), load(actions, "action"), load(simulated, "simulated")]
    data = combine(obs, *acting, **options)
    if data is None:
        return None
    report = None
    if obs is not None:
        moves = align_series(acting, [POSITION])
        # One more row: the empty one for the moment before the first action.
        report = alignment_report(obs, moves, [POSITION]).withColumn(
            "same_length", F.col("n_left") == F.col("n_right") + 1
        )
    side = None
    if sizing is not None:
        side = sizing_table(read_table(spark, sizing, schemas.get("size"), fmt, position="_pos"), "_pos")
    return TrainingSet(data, report, side)


def write_training_set(
    result: TrainingSet, path: str, sizing_path: str | None = None, fmt: str = "csv", order_by_key: bool = True
) -> None:
    """Write the set, in key order unless told otherwise, and its side table."""
    write_table(result.data.orderBy(ref(POSITION)) if order_by_key else result.data, path, fmt)
    if result.sizing is not None and sizing_path is not None:
        write_table(result.sizing, sizing_path, fmt)


def sizing_columns(df: DataFrame, zone: str = SIZING_ZONE) -> DataFrame | None:
    """Time and zone columns of a sizing table; None when no column names the zone."""
    return select_zone_columns(df, zone, ("Time",))


def sizing_structure(df: DataFrame, zone: str = SIZING_ZONE, order: str | None = None) -> DataFrame:
    """One row about a sizing table: size, time, zone and numeric columns, sample.

    ``order`` names the row-number column, which is not counted as a column.
    """
    cols = [c for c in df.columns if c != order]
    times = [c for c in cols if c.lower() in SIZING_TIME_COLUMNS]
    text = F.array().cast("array<string>")

    def listed(names: list[str]):
        return F.array(*[F.lit(n) for n in names]) if names else text

    body = F.to_json(F.struct(*[ref(c) for c in cols]))
    if order is None:
        sample = text
    else:
        head = df.orderBy(ref(order)).limit(2).agg(F.collect_list(F.struct(ref(order).alias("o"), body.alias("b"))).alias("s"))
        sample = head.select(F.transform(F.array_sort("s"), lambda s: s["b"])).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(cols)).alias("columns"),
        F.lit(bool(times)).alias("has_time_column"),
        listed(times).alias("time_columns"),
        listed(zone_column_names(cols, zone)).alias("zone_columns"),
        listed([c for c in numeric_columns(df) if c != order]).alias("numeric_columns"),
        F.col("rows").isin(*SIZING_ROW_COUNTS).alias("is_daily_data"),
        sample.alias("sample"),
    )


def sizing_table(df: DataFrame, order: str, zone: str = SIZING_ZONE, prefix: str = "size") -> DataFrame | None:
    """The sizing side table: time columns (or derived ones) and zone columns.

    Empty unless the table holds one day of quarter hours. The length is tested
    inside the plan, so nothing is counted ahead of time.
    """
    cols = [c for c in df.columns if c != order]
    in_zone = zone_column_names(cols, zone)
    if not in_zone:
        return None
    times = [c for c in cols if c.lower() in SIZING_TIME_COLUMNS]
    daily = df.agg(F.count(F.lit(1)).isin(*SIZING_ROW_COUNTS)).scalar()
    renamed = prefix_columns(df.where(daily), prefix, (*SIZING_TIME_COLUMNS, order))
    zone_cols = [f"{prefix}_{c}" for c in in_zone]
    if times:
        return pick(renamed, times + zone_cols)
    return renamed.select(
        hour_of_position(ref(order)).alias("hour_of_day"),
        quarter_of_position(ref(order)).alias("quarter_hour"),
        *[ref(c) for c in zone_cols],
    )
