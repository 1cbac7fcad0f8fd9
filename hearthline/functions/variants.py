"""Access to the semi-structured properties of building objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.presets import SCHEDULE_STRIDE, SCHEDULE_TIME_MARK


def prop(props: Column, key: str, kind: str = "string", default=None) -> Column:
    """One property as ``kind``; absent or unreadable gives ``default``."""
    value = F.try_variant_get(props, f"$.{key}", kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def has_prop(props: Column, key: str) -> Column:
    """Whether the key is there at all, JSON null included."""
    return F.try_variant_get(props, f"$.{key}", "variant").isNotNull()


def first_prop(props: Column, keys: list[str]) -> Column:
    """The value of the first key that is present, even when it is null."""
    chain = F.when(has_prop(props, keys[0]), prop(props, keys[0]))
    for key in keys[1:]:
        chain = chain.when(has_prop(props, key), prop(props, key))
    return chain


def items(props: Column, key: str) -> Column:
    """A list property as ``array<variant>``; an absent list is empty."""
    return F.coalesce(F.try_variant_get(props, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def schedule_points(props: Column, keep_zero: bool = False) -> Column:
    """``array<struct<time, value>>`` of a compact schedule.

    Fields come in groups of four; the third holds ``Until: <time>`` and the
    fourth the value. Incomplete groups, times that are not text and values
    that are not numbers are left out, and so is the number 0 (as opposed to
    the text ``"0"``) unless ``keep_zero`` is set.
    """
    fields = items(props, "data")
    last_start = F.size(fields) - SCHEDULE_STRIDE
    starts = F.when(last_start >= 0, F.sequence(F.lit(0), last_start, F.lit(SCHEDULE_STRIDE))).otherwise(
        F.array().cast("array<int>")
    )

    def kind(v: Column) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, "$.field", "variant"))

    def point(i: Column) -> Column:
        time, value = F.get(fields, i + 2), F.get(fields, i + 3)
        return F.struct(
            F.try_variant_get(time, "$.field", "string").alias("time"),
            kind(time).alias("time_kind"),
            F.try_variant_get(value, "$.field", "string").alias("text"),
            kind(value).alias("value_kind"),
        )

    def usable(p: Column) -> Column:
        number = F.trim(p["text"]).try_cast("double")
        kept = number.isNotNull()
        if not keep_zero:
            kept = kept & ((p["value_kind"] == "STRING") | (number != 0.0))
        return (p["time_kind"] == "STRING") & p["time"].startswith(SCHEDULE_TIME_MARK) & kept

    return F.transform(
        F.filter(F.transform(starts, point), usable),
        lambda p: F.struct(
            F.trim(F.replace(p["time"], F.lit(SCHEDULE_TIME_MARK), F.lit(""))).alias("time"),
            F.trim(p["text"]).try_cast("double").alias("value"),
        ),
    )
