"""Positions, neighbours and runs in ordered series of any length.

A series may be as long as the table, so nothing here sorts a whole series in one
task. Rows go through Spark's own range exchange on keys and order, and are stored once
with the number of their partition and their place in it. A stored row can be read
again any number of times, on any executor, without its partition changing. What crosses
partitions is folded along their order from a few numbers per partition: its count for
positions, whether its first run goes on from an earlier one for runs. Rows next to a
border are repeated for neighbours.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from hearthline.functions.numbers import PACKED, clean, packed, ref, unpacked
from hearthline.session import stored

PART = "_hl_part"
CHUNK = "_hl_chunk"
_PLACE = "_hl_place"
_ROW = "_hl_row"
FEW_SERIES = 100_000


def in_order(df: DataFrame, order_by: Sequence[str], parts: int | None = None) -> DataFrame:
    """A stored copy in range partitions of ``order_by``, with partition and place in it.

    NULL comes first and NaN last, as in a sort; only rows that are equal in all of
    ``order_by`` are never parted. ``parts`` is the number of partitions, by default
    that of the session's shuffles.
    """
    order = [ref(c) for c in order_by]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn(_PLACE, F.monotonically_increasing_id())
    within = F.lit(2**33 - 1)
    kept = placed.withColumns({PART: F.shiftright(_PLACE, 33), _PLACE: F.col(_PLACE).bitwiseAND(within)})
    return stored(kept, "in-order")


def _by_part(values: dict[int, int | bool]) -> Column:
    """The value of a row's partition, from one array that the plan holds as a constant."""
    listed = [values.get(i) for i in range(max(values, default=-1) + 1)]
    kind = "array<boolean>" if any(isinstance(v, bool) for v in listed) else "array<bigint>"
    return F.get(F.from_json(F.lit(json.dumps(listed)), kind), F.col(PART).cast("int"))


def _counts(copy: DataFrame) -> dict[int, int]:
    """Rows per partition, in order: one number each, as for numbering any Spark partitions."""
    return {r[PART]: r["count"] for r in copy.groupBy(PART).count().orderBy(PART).collect()}


def _indexed(copy: DataFrame) -> DataFrame:
    """The copy with the row's index in the whole order. Nothing is exchanged."""
    counts = _counts(copy)
    before = dict(zip(counts, accumulate(counts.values(), initial=0)))
    return copy.withColumn(_ROW, _by_part(before) + F.col(_PLACE))


def _sent_if_few(begins: DataFrame) -> DataFrame:
    """One stored row per series, sent to all tasks if there are at most ``FEW_SERIES``.

    An exchange by series would put each of a few long ones into one task. Where there are more,
    the join exchanges both sides.
    """
    return F.broadcast(begins) if begins.limit(FEW_SERIES + 1).count() <= FEW_SERIES else begins


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "timestep",
    start: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Number the rows of each series 0, 1, 2, ... in the given order.

    One range exchange of the rows, on the keys and the order. A row's index is its
    place plus the rows of earlier partitions; a series begins at the least index of
    its rows. ``order_by`` should identify a row within its series, or equal rows are
    numbered in no particular order. The ordered copy is stored when this is called.
    """
    rows = _indexed(in_order(packed(df, keys), [*keys, *order_by], parts))
    position = F.col(_ROW)
    if keys:
        rows = rows.join(_sent_if_few(stored(rows.groupBy(PACKED).agg(F.min(_ROW).alias("_begins")), "begins")), PACKED)
        position = position - F.col("_begins")
    return rows.select(*[ref(c) for c in df.columns], (position + start).alias(name))


def with_neighbours(
    df: DataFrame,
    position: str,
    values: dict[str, Callable[[WindowSpec], Column]],
    keys: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    bits: int = 16,
    parts: int | None = None,
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` on.

    Rows are neighbours in the order of ``position``, which need not be without
    gaps; rows that have none come first. ``values`` maps a new column to a function of the window, for example
    ``{"d": lambda w: F.lag("x").over(w)}``; a later one may use an earlier one,
    and the reach is that of all of them together. Chunks of ``2 ** bits`` rows follow
    each other in the order of all rows, whatever their series; only the rows within
    reach of a chunk border are sent twice, so long series stay split.
    """
    width = 2**bits
    if max(before, after) >= width:
        raise ValueError("the reach must be smaller than a chunk")
    spread = _indexed(in_order(df, [*keys, position], parts))
    p = F.col(_ROW)
    home = F.shiftright(p, bits)
    offset = p - F.shiftleft(home, bits)
    targets = [home]
    if before:
        targets.append(F.when(offset >= width - before, home + 1))
    if after:
        targets.append(F.when(offset < after, home - 1))
    spread = spread.withColumn(CHUNK, F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*[ref(k) for k in keys], CHUNK).orderBy(p)
    for name, make in values.items():
        spread = spread.withColumn(name, make(w))
    return spread.where(F.col(CHUNK) == home).drop(CHUNK, _ROW, PART, _PLACE)


def value_runs(
    df: DataFrame,
    col: Column | str,
    order_by: str,
    keys: Sequence[str] = (),
    min_len: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """Runs of equal consecutive values: keys, value, length, start, end.

    A missing value (NULL or NaN) equals nothing, so it is a run of its own.
    Runs are closed inside range partitions; only a partition's first run can go on
    from an earlier one. Which partition a run began in is a fold along the
    partitions: the latest one that is not wholly inside that run. The ordered copy
    is stored, and the fold runs, when this is called.
    """
    value = clean(df, col) if isinstance(col, str) else col
    valued = df.withColumn("_hl_value", value)
    rows = packed(valued, keys).select(PACKED, clean(valued, "_hl_value").alias("value"), ref(order_by).alias("start"))
    copy = in_order(rows, [PACKED, "start"], parts)
    inside = Window.partitionBy(PART).orderBy(_PLACE)

    def same(neighbour: Callable) -> Column:
        equal = (F.col("value") == neighbour("value").over(inside)) & (F.col(PACKED) == neighbour(PACKED).over(inside))
        return F.coalesce(equal, F.lit(False))

    marked = copy.withColumns({"_begins": ~same(F.lag), "_ends": ~same(F.lead)}).where("_begins OR _ends")
    last = F.struct(F.col(_PLACE).alias("place"), F.col("start").alias("start"))
    marked = marked.withColumn("_last", F.when(F.col("_ends"), last).otherwise(F.lead(last).over(inside))).where("_begins")
    length = (F.col("_last.place") - F.col(_PLACE) + 1).alias("length")
    pieces = stored(marked.select(PART, _PLACE, PACKED, "value", length, "start", F.col("_last.start").alias("end")), "runs")

    edge = F.struct(PACKED, "value")
    ends = pieces.groupBy(PART).agg(
        F.count(F.lit(1)).alias("runs"),
        F.min_by(edge, _PLACE).alias("_first"),
        F.max_by(edge, _PLACE).alias("_last"),
        F.max(_PLACE).alias("place"),
    )
    filled = list(_counts(pieces))
    was = ends.select(F.col(PART).alias("_earlier"), F.col("_last").alias("_was"))
    met = ends.withColumn("_earlier", _by_part(dict(zip(filled[1:], filled)))).join(was, "_earlier", "left")
    goes_on = (F.col("_first.value") == F.col("_was.value")) & (F.col(f"_first.{PACKED}") == F.col(f"_was.{PACKED}"))
    met = met.select(PART, F.coalesce(goes_on, F.lit(False)).alias("on"), "runs", "place")
    summary = {r[PART]: r for r in met.orderBy(PART).collect()}
    # The partition in which a run going into the next one began.
    began = accumulate(summary, lambda last, part: last if summary[part]["on"] and summary[part]["runs"] == 1 else part)
    began_before = dict(zip(list(summary)[1:], began))

    # The run that an earlier partition began, or else this one's own.
    of_earlier = _by_part({part: r["on"] for part, r in summary.items()}) & (F.col(_PLACE) == 0)
    named = pieces.withColumn("_home", F.when(of_earlier, _by_part(began_before)).otherwise(F.col(PART)))
    named = named.withColumn("_open", of_earlier | (F.col(_PLACE) == _by_part({part: r["place"] for part, r in summary.items()})))
    wanted = [*unpacked(keys), "value", "length", "start", "end"]
    in_order_of = F.struct(PART, _PLACE)
    across = named.where("_open").groupBy("_home", PACKED).agg(
        F.max("value").alias("value"),
        F.sum("length").alias("length"),
        F.min_by("start", in_order_of).alias("start"),
        F.max_by("end", in_order_of).alias("end"),
    )
    closed = named.where("NOT _open").select(*wanted)
    return closed.unionByName(across.select(*wanted)).where(F.col("length") >= min_len)
