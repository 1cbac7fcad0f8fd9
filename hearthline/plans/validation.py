"""Validation reports of action, reward, observation and weather tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import clean, ref
from hearthline.functions.times import weather_time
from hearthline.operators.align import compare_series
from hearthline.operators.checks import (
    SUMMARY,
    Rule,
    column_range_check,
    evaluate,
    finite_rule,
    pair_rule,
    present_rule,
    range_rule,
    row_count_check,
    time_field_violations,
    valid_range_rule,
    violations,
)
from hearthline.operators.columns import missing_columns, numeric_columns
from hearthline.operators.plotdata import common_range, correlation_cells, point_pairs, series
from hearthline.operators.position import value_runs
from hearthline.operators.stats import (
    constant_columns,
    continuity_check,
    grouped_stats,
    histogram,
    iqr_bounds,
    profile_numeric,
    profile_text,
    shape,
)
from hearthline.presets import (
    ACTION_COLUMNS,
    ACTION_RANGES,
    HISTOGRAM_BINS,
    OBSERVATION_COLUMNS,
    OBSERVATION_PHYSICAL_RANGES,
    OBSERVATION_PLOT_COLUMNS,
    OBSERVATION_SETPOINTS,
    OBSERVATION_TIME_RANGES,
    REWARD_COLUMNS,
    REWARD_EXTREMES,
    REWARD_IQR_FACTOR,
    REWARD_RUN_MIN_LENGTH,
    WEATHER_NUMERIC_COLUMNS,
    WEATHER_PHYSICAL_RANGES,
    WEATHER_PLOT_COLUMNS,
    WEATHER_ROW_COUNTS,
    WEATHER_TIME_RANGES,
)
from hearthline.sources.weather import field_count_violations, parse_weather, weather_location

SAMPLE_ROWS = 5


class Tables(Mapping):
    """Named frames, each planned when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def add(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers |= makers

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class CheckReport:
    """What a validation found.

    ``violations`` lists every offending row; ``tables`` holds profiles, plot data
    and, as ``samples``, the first few violations per check.
    """

    summary: DataFrame
    violations: DataFrame
    tables: Tables = field(default_factory=Tables)


def _head_rows(df: DataFrame, expected: Sequence[str], data_cols: Sequence[str], strict: bool) -> DataFrame:
    absent = missing_columns(df, expected)
    if absent and strict:
        raise KeyError(f"missing columns: {absent}")
    rows = [("expected_columns", c, "missing", None, None, None, "") for c in absent] or [
        ("expected_columns", "", "ok", 0, None, None, "")
    ]
    rows.append(("columns", "", "info", None, None, None, str(len(data_cols))))
    return df.sparkSession.createDataFrame(rows, SUMMARY)


def _report(
    df: DataFrame,
    expected: Sequence[str],
    rules: Sequence[Rule],
    position: str,
    strict: bool,
    listed: Sequence[Rule] | None = None,
    samples: int = SAMPLE_ROWS,
) -> CheckReport:
    data_cols = [c for c in df.columns if c != position]
    nulls = [present_rule(c) for c in data_cols]
    summary = _head_rows(df, expected, data_cols, strict).unionByName(evaluate(df, [*nulls, *rules]))
    shown = list(listed if listed is not None else rules)
    return CheckReport(
        summary,
        violations(df, shown, [position]),
        Tables(shape=lambda: shape(df.drop(position)), samples=lambda: violations(df, shown, [position], samples)),
    )


def _action_rules() -> list[Rule]:
    ranges = [range_rule(c, lo, hi) for c, (lo, hi) in ACTION_RANGES.items()]
    return [*ranges, pair_rule(*ACTION_COLUMNS)]


def validate_actions(
    df: DataFrame, position: str = "position", strict: bool = False, samples: int = SAMPLE_ROWS
) -> CheckReport:
    """Setpoint ranges and heating below cooling."""
    report = _report(df, ACTION_COLUMNS, _action_rules(), position, strict, samples=samples)
    report.tables.add(profile=lambda: profile_numeric(df, [c for c in numeric_columns(df) if c != position]))
    return report


def validate_simulated_actions(
    df: DataFrame, agent: DataFrame | None = None, position: str = "position", strict: bool = False
) -> CheckReport:
    """As ``validate_actions``, plus constant columns, plots and the agent's actions."""
    report = validate_actions(df, position, strict)
    cols = [c for c in df.columns if c != position]
    report.tables.add(constants=lambda: constant_columns(df, cols))
    if all(c in df.columns for c in ACTION_COLUMNS):
        report.tables.add(
            series=lambda: series(df, position, ACTION_COLUMNS),
            points=lambda: point_pairs(df, *ACTION_COLUMNS),
            equal_line=lambda: common_range(df, *ACTION_COLUMNS),
        )
        if agent is not None:
            report.tables.add(comparison=lambda: compare_series(agent, df, [position], ACTION_COLUMNS))
    return report


def iqr_rule(df: DataFrame, col: str, k: float = REWARD_IQR_FACTOR) -> Rule:
    """Outside the interquartile limits, which the plan computes as a subquery."""
    limits = iqr_bounds(df, col, k).select(F.struct("lower", "upper")).scalar()

    def violates(d: DataFrame):
        v = clean(d, col)
        return F.coalesce((v < limits["lower"]) | (v > limits["upper"]), F.lit(False))

    return Rule("iqr", (col,), violates, f"{k} x IQR")


def validate_rewards(
    df: DataFrame, position: str = "position", col: str = "reward", strict: bool = False, samples: int = SAMPLE_ROWS
) -> CheckReport:
    """Outliers, extremes, non-finite values, constant and long equal stretches."""
    rules = [range_rule(col, *REWARD_EXTREMES, check="extreme"), finite_rule(col)]
    if col in df.columns:
        rules.append(iqr_rule(df, col))
    report = _report(df, (col,) if col != "reward" else REWARD_COLUMNS, rules, position, strict, samples=samples)
    if col in df.columns:
        report.tables.add(
            profile=lambda: profile_numeric(df, [c for c in numeric_columns(df) if c != position]),
            iqr_bounds=lambda: iqr_bounds(df, col, REWARD_IQR_FACTOR),
            constants=lambda: constant_columns(df, [col]),
            runs=lambda: value_runs(df.withColumn(col, clean(df, col)), col, position, min_len=REWARD_RUN_MIN_LENGTH),
            histogram=lambda: histogram(df, col, HISTOGRAM_BINS),
            series=lambda: series(df, position, [col]),
        )
    return report


def validate_observations(
    df: DataFrame, position: str = "position", strict: bool = False, samples: int = SAMPLE_ROWS
) -> CheckReport:
    """Time fields, physical ranges, setpoint order, demand; plots and correlation."""
    ranges = {**OBSERVATION_TIME_RANGES, **OBSERVATION_PHYSICAL_RANGES}
    rules = [range_rule(c, lo, hi) for c, (lo, hi) in ranges.items()]
    rules.append(pair_rule(*OBSERVATION_SETPOINTS))
    report = _report(df, OBSERVATION_COLUMNS, rules, position, strict, samples=samples)
    numbers = [c for c in numeric_columns(df) if c != position]
    texts = [c for c in df.columns if c not in numbers and c != position]
    report.tables.add(ranges=lambda: column_range_check(df, ranges))
    if numbers:
        report.tables.add(profile=lambda: profile_numeric(df, numbers))
    if texts:
        report.tables.add(text_profile=lambda: profile_text(df, texts))
    plotted = [c for c in OBSERVATION_PLOT_COLUMNS if c in df.columns]
    if plotted:
        report.tables.add(series=lambda: series(df, position, plotted))
        if len(numbers) > 1:
            report.tables.add(correlation=lambda: correlation_cells(df, numbers))
    return report


def validate_weather(lines: DataFrame, hour24: str = "null") -> CheckReport:
    """Weather files given as ``(file, line_no, value)``; every check is per file."""
    weather = parse_weather(lines)
    time_rules = [valid_range_rule(c, lo, hi, f"invalid_{c.lower()}") for c, (lo, hi) in WEATHER_TIME_RANGES.items()]
    value_rules = [range_rule(c, lo, hi) for c, (lo, hi) in WEATHER_PHYSICAL_RANGES.items()]
    nulls = [present_rule(c) for c in WEATHER_NUMERIC_COLUMNS]

    def dated() -> DataFrame:
        time = weather_time(*[ref(c) for c in ("Year", "Month", "Day", "Hour")], hour24=hour24)
        return weather.select("file", "row", time.alias("date"), *[ref(c) for c in WEATHER_PLOT_COLUMNS])

    return CheckReport(
        evaluate(weather, [*nulls, *time_rules, *value_rules], keys=["file"]),
        time_field_violations(weather, WEATHER_TIME_RANGES, ["file", "row"]),
        Tables(
            location=lambda: weather_location(lines),
            line_counts=lambda: row_count_check(weather, WEATHER_ROW_COUNTS, by=["file"]),
            field_counts=lambda: field_count_violations(weather),
            ranges=lambda: column_range_check(weather, WEATHER_PHYSICAL_RANGES, keys=["file"]),
            monthly=lambda: grouped_stats(weather, ["file", "Month"], "Dry Bulb Temperature"),
            continuity=lambda: continuity_check(weather, ["Year", "Month", "Day"], keys=["file"]),
            series=dated,
        ),
    )
