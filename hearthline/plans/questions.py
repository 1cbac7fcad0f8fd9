"""Analytical questions over the training set.

Each takes a frame with one row per time step. ``Names`` says which columns
play which part; ``keys`` separate several series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import ref
from hearthline.operators.columns import zone_column_names
from hearthline.operators.position import with_neighbours


@dataclass(frozen=True)
class Names:
    position: str = "timestep"
    date: str = "date"
    month: str = "month"
    day: str = "day_of_month"
    hour: str = "hour"
    outdoor: str = "obs_outdoor_temperature"
    indoor: str = "obs_air_temperature"
    heating: str = "obs_htg_setpoint"
    cooling: str = "obs_clg_setpoint"
    occupants: str = "obs_people_occupant"
    demand: str = "obs_HVAC_electricity_demand_rate"
    keys: tuple[str, ...] = ()


# What the questions call summer, comfort, afternoon and night.
SUMMER = (6, 7, 8)
COMFORT = (20.0, 25.0)
WIDER_COMFORT = (19.0, 26.0)
AFTERNOON = (12, 18)
LATE_AFTERNOON = (15, 18)
NIGHT = (22, 6)
HOT_OUTDOOR = 30.0


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def outside_band(c: Column, band: tuple[float, float] = COMFORT) -> Column:
    return (c < band[0]) | (c > band[1])


def demand_by_outdoor(df: DataFrame, n: Names = Names(), months: Sequence[int] = SUMMER, width: int = 5) -> DataFrame:
    """Mean demand per outdoor temperature bin in the given months."""
    return (
        df.where(ref(n.month).isin(*months) & ref(n.outdoor).isNotNull())
        .groupBy((F.floor(ref(n.outdoor) / width) * width).alias("outdoor_from"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(ref(n.demand)).alias("avg_demand"))
    )


def demand_outdoor_fit(df: DataFrame, n: Names = Names(), months: Sequence[int] = SUMMER) -> DataFrame:
    """Correlation and slope of demand over outdoor temperature; NULL if flat."""
    sums = df.where(ref(n.month).isin(*months)).agg(
        F.regr_count(ref(n.demand), ref(n.outdoor)).alias("n"),
        F.regr_sxy(ref(n.demand), ref(n.outdoor)).alias("sxy"),
        F.regr_sxx(ref(n.demand), ref(n.outdoor)).alias("sxx"),
        F.regr_syy(ref(n.demand), ref(n.outdoor)).alias("syy"),
    )
    return sums.select(
        "n",
        F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")).alias("r"),
        F.try_divide(F.col("sxy"), F.col("sxx")).alias("slope"),
    )


def efficiency_by_band(
    df: DataFrame, n: Names = Names(), bands: Sequence[tuple[float, float]] = ((25.0, 30.0), (30.0, 35.0))
) -> DataFrame:
    """Demand per degree between outdoors and indoors, per outdoor band."""
    band = F.lit(None).cast("string")
    for lo, hi in reversed(bands):
        band = F.when((ref(n.outdoor) >= lo) & (ref(n.outdoor) < hi), F.lit(f"{lo:g}-{hi:g}")).otherwise(band)
    return (
        df.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(ref(n.demand)).alias("avg_demand"),
            _ratio(F.sum(ref(n.demand)), F.sum(ref(n.outdoor) - ref(n.indoor))).alias("demand_per_degree"),
        )
    )


def _with_outdoor_change(df: DataFrame, n: Names) -> DataFrame:
    return with_neighbours(
        df, n.position, {"outdoor_change": lambda w: ref(n.outdoor) - F.lag(ref(n.outdoor)).over(w)}, n.keys, before=1
    )


def violations_by_change(df: DataFrame, n: Names = Names(), rapid: float = 2.0) -> DataFrame:
    """Comfort violation rate after rapid and after slow outdoor changes."""
    return (
        _with_outdoor_change(df, n)
        .where(F.col("outdoor_change").isNotNull())
        .groupBy((F.abs("outdoor_change") >= rapid).alias("is_rapid"))
        .agg(F.count(F.lit(1)).alias("n"), _rate(outside_band(ref(n.indoor))).alias("violation_rate"))
    )


def violations_on_day(df: DataFrame, month: int, day: int, n: Names = Names()) -> DataFrame:
    """Hour by hour on one day: violations and the conditions around them."""
    at = (ref(n.month) == month) & (ref(n.day) == day)
    return (
        df.where(at)
        .groupBy(ref(n.hour).alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(outside_band(ref(n.indoor))).alias("n_violations"),
            F.avg(ref(n.outdoor)).alias("avg_outdoor"),
            F.avg(ref(n.occupants)).alias("avg_occupants"),
            F.avg(ref(n.cooling)).alias("avg_cooling"),
        )
    )


def violations_by_band(
    df: DataFrame, n: Names = Names(), bands: Sequence[tuple[float, float]] = (COMFORT, WIDER_COMFORT)
) -> DataFrame:
    """Share of time steps outside each comfort band."""
    cells = [
        F.struct(F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), _rate(outside_band(ref(n.indoor), (lo, hi))).alias("violation_rate")).alias(
            f"b{i}"
        )
        for i, (lo, hi) in enumerate(bands)
    ]
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"b{i}") for i in range(len(bands))])).alias("_b")).select("_b.*")


def occupied_spikes(df: DataFrame, n: Names = Names(), spike: float = 1000.0) -> DataFrame:
    """Steps where people arrive and demand jumps by the next step."""
    return with_neighbours(
        df,
        n.position,
        {
            "occupants_before": lambda w: F.lag(ref(n.occupants)).over(w),
            "demand_after": lambda w: F.lead(ref(n.demand)).over(w),
        },
        n.keys,
        before=1,
        after=1,
    ).where(
        (F.col("occupants_before") == 0) & (ref(n.occupants) > 0) & (F.col("demand_after") - ref(n.demand) >= spike)
    ).select(*[ref(k) for k in n.keys], ref(n.position), ref(n.demand).alias("demand"), "demand_after")


def excess_demand(df: DataFrame, n: Names = Names(), width: int = 5, z: float = 3.0) -> DataFrame:
    """Steps whose demand is ``z`` deviations above that of like hours and weather."""
    cell = [ref(n.hour).alias("_hour"), F.floor(ref(n.outdoor) / width).alias("_bin")]
    rows = df.select(*[ref(k) for k in n.keys], ref(n.position), *cell, ref(n.demand).alias("demand"))
    usual = rows.groupBy("_hour", "_bin").agg(
        F.avg("demand").alias("mean"), F.try_divide(F.stddev_pop("demand"), F.lit(1.0)).alias("deviation")
    )
    score = F.try_divide(F.col("demand") - F.col("mean"), F.col("deviation"))
    return (
        rows.join(usual, ["_hour", "_bin"])
        .withColumn("z_score", score)
        .where(F.col("z_score") > z)
        .select(*[ref(k) for k in n.keys], ref(n.position), "demand", "z_score")
    )


def hunting(df: DataFrame, n: Names = Names(), col: str | None = None, within: int = 12, at_least: int = 6) -> DataFrame:
    """Steps that close a stretch with many changes of direction."""
    x = ref(col or n.demand)
    found = with_neighbours(
        df,
        n.position,
        {
            "_step": lambda w: F.signum(x - F.lag(x).over(w)),
            "_turn": lambda w: F.coalesce((F.col("_step") * F.lag("_step").over(w) < 0).cast("int"), F.lit(0)),
            "n_turns": lambda w: F.sum("_turn").over(w.rowsBetween(-(within - 1), 0)),
        },
        n.keys,
        before=within + 2,
    )
    return found.where(F.col("n_turns") >= at_least).select(*[ref(k) for k in n.keys], ref(n.position), "n_turns")


def afternoon_overshoot(
    df: DataFrame, n: Names = Names(), hours: tuple[int, int] = AFTERNOON, margin: float = 0.0
) -> DataFrame:
    """Per afternoon hour: how often it is warmer indoors than the cooling setpoint."""
    over = ref(n.indoor) > ref(n.cooling) + margin
    return (
        df.where(ref(n.hour).between(*hours))
        .groupBy(ref(n.hour).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("n_over"), _rate(over).alias("over_rate"))
    )


def sizing_peaks(sizing: DataFrame, zone: str, time: str = "Time") -> DataFrame:
    """Largest value of each of the zone's sizing columns and when it occurs.

    The earliest of several equal peaks is reported.
    """
    cols = zone_column_names(sizing.columns, zone)
    cells = [F.struct(F.lit(c).alias("column"), ref(c).cast("double").alias("v"), ref(time).alias("t")) for c in cols]
    return (
        sizing.select(F.explode(F.array(*cells)).alias("_c"))
        .select("_c.*")
        .where(F.col("v").isNotNull())
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("v")).alias("neg"), F.col("t"))).alias("_m"))
        .select("column", (-F.col("_m.neg")).alias("peak"), F.col("_m.t").alias("peak_time"))
    )


def setpoint_response(df: DataFrame, n: Names = Names(), drop: float = 2.0, steps: int = 4) -> DataFrame:
    """Mean indoor change 1..k steps after the cooling setpoint falls while occupied."""
    ahead = {
        f"_a{k}": (lambda w, k=k: F.lead(ref(n.indoor), k).over(w) - ref(n.indoor)) for k in range(1, steps + 1)
    }
    events = with_neighbours(
        df,
        n.position,
        {"_change": lambda w: ref(n.cooling) - F.lag(ref(n.cooling)).over(w), **ahead},
        n.keys,
        before=1,
        after=steps,
    ).where((F.col("_change") <= -drop) & (ref(n.occupants) > 0))
    cells = [F.struct(F.lit(k).alias("step"), F.col(f"_a{k}").alias("v")) for k in range(1, steps + 1)]
    return (
        events.select(F.explode(F.array(*cells)).alias("_c"))
        .select("_c.*")
        .where(F.col("v").isNotNull())
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("avg_change"))
    )


def indoor_stability(df: DataFrame, n: Names = Names(), rapid: float = 2.0) -> DataFrame:
    """Mean absolute indoor change while it changes rapidly or slowly outdoors."""
    both = with_neighbours(
        df,
        n.position,
        {
            "_out": lambda w: F.abs(ref(n.outdoor) - F.lag(ref(n.outdoor)).over(w)),
            "_in": lambda w: F.abs(ref(n.indoor) - F.lag(ref(n.indoor)).over(w)),
        },
        n.keys,
        before=1,
    )
    return (
        both.where(F.col("_out").isNotNull() & F.col("_in").isNotNull())
        .groupBy((F.col("_out") >= rapid).alias("is_rapid"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_in").alias("avg_indoor_change"))
    )


def _is_weekend(n: Names) -> Column:
    return F.dayofweek(ref(n.date)).isin(1, 7)


def hourly_profile(df: DataFrame, n: Names = Names(), months: Sequence[int] = SUMMER) -> DataFrame:
    """Typical weekday of the given months, hour by hour."""
    return (
        df.where(ref(n.month).isin(*months) & ~_is_weekend(n))
        .groupBy(ref(n.hour).alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(ref(n.indoor)).alias("avg_indoor"),
            F.avg(ref(n.heating)).alias("avg_heating"),
            F.avg(ref(n.cooling)).alias("avg_cooling"),
            F.avg(ref(n.demand)).alias("avg_demand"),
        )
    )


def weekday_weekend(df: DataFrame, n: Names = Names()) -> DataFrame:
    return (
        df.where(ref(n.date).isNotNull())
        .groupBy(_is_weekend(n).alias("is_weekend"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(ref(n.indoor)).alias("avg_indoor"),
            F.stddev_pop(ref(n.indoor)).alias("std_indoor"),
            F.avg(ref(n.demand)).alias("avg_demand"),
        )
    )


def demand_by_occupancy(df: DataFrame, n: Names = Names(), width: int = 5) -> DataFrame:
    return (
        df.where(ref(n.occupants).isNotNull())
        .groupBy((F.floor(ref(n.occupants) / width) * width).alias("occupants_from"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(ref(n.demand)).alias("avg_demand"))
    )


def state_at(df: DataFrame, step: int, n: Names = Names()) -> DataFrame:
    """Everything known at one time step."""
    return df.where(ref(n.position) == step)


def _at_night(n: Names) -> Column:
    return (ref(n.hour) >= NIGHT[0]) | (ref(n.hour) < NIGHT[1])


def deadband_by_time(df: DataFrame, n: Names = Names()) -> DataFrame:
    """Mean distance of the setpoints by night and by day."""
    return (
        df.where(ref(n.hour).isNotNull())
        .groupBy(_at_night(n).alias("is_night"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(ref(n.cooling) - ref(n.heating)).alias("avg_deadband"))
    )


def policy_by_situation(df: DataFrame, n: Names = Names(), few: int = 5, many: int = 15) -> DataFrame:
    """Setpoints and temperature floor in the situations the questions name."""
    situations = {
        "late_afternoon_occupied": ref(n.hour).between(*LATE_AFTERNOON) & (ref(n.occupants) > 0),
        "afternoon_crowded": ref(n.hour).between(*AFTERNOON) & (ref(n.occupants) >= many),
        "hot_outdoors": ref(n.outdoor) > HOT_OUTDOOR,
        "low_occupancy": ref(n.occupants) < few,
    }
    cells = []
    for name, when in situations.items():
        cells.append(
            F.struct(
                F.lit(name).alias("situation"),
                F.count_if(when).alias("n"),
                F.avg(F.when(when, ref(n.heating))).alias("avg_heating"),
                F.avg(F.when(when, ref(n.cooling))).alias("avg_cooling"),
                F.min(F.when(when, ref(n.indoor))).alias("min_indoor"),
            ).alias(name)
        )
    return df.agg(*cells).select(F.explode(F.array(*[F.col(s) for s in situations])).alias("_s")).select("_s.*")


#: Step, cooling and heating setpoint, outdoor and indoor temperature, occupants.
PROMPT = "Step %d: setpoints %.1f (cooling) and %.1f (heating); outside %.1f, inside %.1f degrees; people present: %d."


def state_prompts(df: DataFrame, n: Names = Names(), template: str = PROMPT) -> DataFrame:
    """One line of text per time step, ready for ``write_table(..., "json")``.

    ``template`` is a format of six places, see ``PROMPT``.
    """
    text = F.format_string(
        template,
        ref(n.position).cast("bigint"),
        ref(n.cooling).cast("double"),
        ref(n.heating).cast("double"),
        ref(n.outdoor).cast("double"),
        ref(n.indoor).cast("double"),
        ref(n.occupants).cast("bigint"),
    )
    complete = [ref(c).isNotNull() for c in (n.cooling, n.heating, n.outdoor, n.indoor, n.occupants)]
    kept = df
    for c in complete:
        kept = kept.where(c)
    return kept.select(*[ref(k) for k in n.keys], ref(n.position), text.alias("prompt"))
