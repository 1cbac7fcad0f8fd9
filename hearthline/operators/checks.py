"""Validity rules: counted in one pass, listed row by row on demand."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.numbers import clean, ref

SUMMARY = "check string, column string, status string, n_bad bigint, min double, max double, detail string"


@dataclass(frozen=True)
class Rule:
    """A named condition on a row; ``violates`` is true for offending rows."""

    check: str
    columns: tuple[str, ...]
    violates: Callable[[DataFrame], Column]
    detail: str = ""

    def applies(self, df: DataFrame) -> bool:
        return all(c in df.columns for c in self.columns)


def outside(value: Column, lo: float | None, hi: float | None) -> Column:
    """Below ``lo`` or above ``hi``; a missing value is neither."""
    below = F.lit(False) if lo is None else value < F.lit(lo)
    above = F.lit(False) if hi is None else value > F.lit(hi)
    return F.coalesce(below | above, F.lit(False))


def range_rule(col: str, lo: float | None, hi: float | None, check: str = "range") -> Rule:
    text = f"[{'' if lo is None else lo}, {'' if hi is None else hi}]"
    return Rule(check, (col,), lambda df: outside(clean(df, col), lo, hi), text)


def valid_range_rule(col: str, lo: float, hi: float, check: str) -> Rule:
    """Like ``range_rule``, but a missing value is an offence as well."""
    return Rule(
        check, (col,), lambda df: ~F.coalesce(clean(df, col).between(lo, hi), F.lit(False)), f"[{lo}, {hi}]"
    )


def pair_rule(low: str, high: str, check: str = "pair") -> Rule:
    return Rule(
        check,
        (low, high),
        lambda df: F.coalesce(clean(df, low) >= clean(df, high), F.lit(False)),
        f"{low} >= {high}",
    )


def nonfinite(c: Column) -> Column:
    """NULL, NaN or infinite."""
    v = c.cast("double")
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def finite_rule(col: str, check: str = "finite") -> Rule:
    return Rule(check, (col,), lambda df: nonfinite(ref(col)), "")


def present_rule(col: str, check: str = "missing_values") -> Rule:
    return Rule(check, (col,), lambda df: clean(df, col).isNull(), "")


def evaluate(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """One summary row per rule (and key): status, offending rows, min, max.

    All rules share a single aggregate. A rule whose columns are absent is
    reported as ``skipped``.
    """
    by = [ref(k) for k in keys]
    active = [r for r in rules if r.applies(df)]
    idle = [r for r in rules if not r.applies(df)]
    names = [k for k in keys]
    parts = []
    if active:
        measured = sorted({r.columns[0] for r in active})
        place = {c: i for i, c in enumerate(measured)}
        aggs = [F.count_if(r.violates(df)).alias(f"n{i}") for i, r in enumerate(active)]
        for c, i in place.items():
            number = clean(df, c).try_cast("double") if _castable(df, c) else F.lit(None).cast("double")
            aggs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}")]
        cells = [
            F.struct(
                F.lit(r.check).alias("check"),
                F.lit(",".join(r.columns)).alias("column"),
                F.when(F.col(f"n{i}") > 0, "fail").otherwise("ok").alias("status"),
                F.col(f"n{i}").alias("n_bad"),
                F.col(f"lo{place[r.columns[0]]}").alias("min"),
                F.col(f"hi{place[r.columns[0]]}").alias("max"),
                F.lit(r.detail).alias("detail"),
            )
            for i, r in enumerate(active)
        ]
        wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        parts.append(wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*"))
    if idle:
        rows = [(r.check, ",".join(r.columns), "skipped", None, None, None, r.detail) for r in idle]
        parts.append(df.sparkSession.createDataFrame(rows, SUMMARY))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=bool(names))
    return out


def _castable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() not in ("timestamp_ntz", "timestamp", "date", "boolean", "binary")


def violations(
    df: DataFrame, rules: Sequence[Rule], position: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Offending rows as check, position columns, column, value, row_json.

    Without ``limit`` every offence is listed and nothing is exchanged. With
    it, the first rows per check and column in position order are kept; each
    task passes on at most that many.
    """
    found = []
    for r in rules:
        if r.applies(df):
            found.append(
                F.when(
                    r.violates(df),
                    F.struct(
                        F.lit(r.check).alias("check"),
                        F.lit(",".join(r.columns)).alias("column"),
                        ref(r.columns[0]).cast("string").alias("value"),
                    ),
                )
            )
    place = [ref(p) for p in position]
    if not found:
        return df.select(
            F.lit("").alias("check"), *place, F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("row_json")
        ).where(F.lit(False))
    row = F.to_json(F.struct(*[ref(c) for c in df.columns]))
    listed = df.select(*place, row.alias("row_json"), F.explode(F.array_compact(F.array(*found))).alias("_v")).select(
        "_v.check", *place, "_v.column", "_v.value", "row_json"
    )
    return listed if limit is None else first_per(listed, ["check", "column"], position, limit)


def first_per(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per group; tasks cut to ``n`` before the exchange."""
    w = Window.partitionBy(*[ref(g) for g in groups]).orderBy(*[ref(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[ref(o) for o in order]).limit(n)


def range_violations(df: DataFrame, col: str, lo: float | None, hi: float | None) -> DataFrame:
    return df.where(outside(clean(df, col), lo, hi))


def pair_violations(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.where(clean(df, low) >= clean(df, high))


def nonfinite_rows(df: DataFrame, col: str) -> DataFrame:
    return df.where(nonfinite(ref(col)))


def time_field_violations(
    df: DataFrame, ranges: dict[str, tuple[float, float]], position: Sequence[str]
) -> DataFrame:
    """One row per invalid time field; a missing field is invalid."""
    rules = [valid_range_rule(c, lo, hi, f"invalid_{c.lower()}") for c, (lo, hi) in ranges.items()]
    return violations(df, rules, position).drop("row_json")


def column_range_check(
    df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], keys: Sequence[str] = ()
) -> DataFrame:
    """Minimum and maximum per column against its limits, in one pass.

    Columns the frame does not have are left out.
    """
    by = [ref(k) for k in keys]
    known = {c: r for c, r in ranges.items() if c in df.columns}
    aggs = []
    for i, c in enumerate(known):
        v = clean(df, c).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    cells = []
    for i, (c, (lo, hi)) in enumerate(known.items()):
        low = F.lit(False) if lo is None else F.coalesce(F.col(f"lo{i}") < float(lo), F.lit(False))
        high = F.lit(False) if hi is None else F.coalesce(F.col(f"hi{i}") > float(hi), F.lit(False))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                low.alias("too_low"),
                high.alias("too_high"),
                F.when(low | high, "out_of_range").otherwise("ok").alias("status"),
            )
        )
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def row_count_check(df: DataFrame, allowed: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Rows per group and whether that number is one of the allowed ones."""
    counts = df.groupBy(*[ref(c) for c in by]).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("status", F.when(F.col("n_rows").isin(*allowed), "ok").otherwise("unexpected"))
