"""Date and clock expressions built from separate fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions.numbers import whole


def date_from_parts(month: Column, day: Column, hour: Column, year: int) -> Column:
    """Fixed year + month + day, plus ``hour`` hours; a bad or fractional field gives NULL."""
    start = F.try_make_timestamp_ntz(
        F.lit(year), whole(month), whole(day), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
    )
    return start + F.make_dt_interval(hours=whole(hour))


def weather_time(year: Column, month: Column, day: Column, hour: Column, hour24: str = "null") -> Column:
    """Hourly time stamp of a weather record.

    Hours run 1..24. ``hour24="null"`` leaves hour 24 without a date, the usual
    outcome of 0..23 parsing; ``"next_day"`` turns it into the next midnight.
    """
    zero, no_seconds = F.lit(0), F.lit(0).cast("decimal(16,6)")
    parts = [whole(c) for c in (year, month, day)]
    midnight = F.try_make_timestamp_ntz(*parts, zero, zero, no_seconds)
    last = 24 if hour24 == "next_day" else 23
    clock = whole(hour)
    return F.when(clock.between(0, last), midnight + F.make_dt_interval(hours=clock))


def hour_of_position(position: Column) -> Column:
    """Hour of the day of a quarter-hourly record, from its 0-based position."""
    return (F.floor(position / 4) % 24).cast("int")


def quarter_of_position(position: Column) -> Column:
    return (position % 4 * 15).cast("int")


def joined(*parts: Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, *parts)
