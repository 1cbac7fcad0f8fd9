"""Putting several series side by side by key, and comparing two of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import clean, ref
from hearthline.operators.columns import leading_row

SIDE = "_hl_side"


def align_series(
    dfs: Sequence[DataFrame | None], on: Sequence[str] = ("timestep",), flags: Sequence[str] | None = None
) -> DataFrame | None:
    """Full outer alignment of series in which a key occurs at most once.

    A key that a series repeats ends the job with an error that names it, rather
    than mixing its rows; ``full_outer`` fans repeated keys out.

    The series are stacked and folded by key: one exchange for any number of
    series, where a chain of outer joins would exchange its growing result
    again for every further series. Absent inputs are passed over; none at all
    gives None. ``flags`` names a boolean per series telling whether it has
    the key. NULL keys meet each other.
    """
    kept = [(i, d) for i, d in enumerate(dfs) if d is not None]
    if not kept:
        return None
    by = [ref(k) for k in on]
    if len(kept) == 1 and not flags:
        return kept[0][1]
    marked = []
    for i, d in kept:
        d = d.withColumn(SIDE, F.lit(i))
        marked.append(d.withColumn(flags[i], F.lit(True)) if flags else d)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    order: list[str] = []
    for d in marked:
        order += [c for c in d.columns if c not in order and c not in on and c != SIDE]
    clash = [c for c in order if sum(c in d.columns for d in marked) > 1]
    if clash:
        raise ValueError(f"series share the columns {clash}; rename them first")
    wanted = [c for c in order if not flags or c not in flags]
    folds = [F.any_value(ref(c), True).alias(c) for c in wanted]
    repeats = F.greatest(*[F.count_if(F.col(SIDE) == i) for i, _ in kept], F.lit(0))
    folds.append(F.when(repeats > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*by))))).alias(SIDE))
    if flags:
        folds += [F.coalesce(F.max(ref(f)), F.lit(False)).alias(f) for i, f in enumerate(flags) if dfs[i] is not None]
    # The filter keeps the check alive when later steps drop its column.
    return stacked.groupBy(*by).agg(*folds).where(F.col(SIDE).isNull()).drop(SIDE)


def full_outer(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Outer equi-join; columns both sides have get a suffix."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, list(on), "full")


def assemble(
    observations: DataFrame | None,
    actions: DataFrame | Sequence[DataFrame | None],
    on: str = "timestep",
    keys: Sequence[str] = (),
    align: str = "reference",
) -> DataFrame | None:
    """Observations against actions with the row for the moment before any action.

    ``align="reference"`` adds an empty action row at 0 and leaves the other
    action keys alone, so key 0 occurs twice. ``align="shift"`` moves every
    action one step on, which makes an observation meet the action before it.
    All series must have unique keys. One exchange for any number of series;
    None without any action series.
    """
    by = [*keys, on]
    moves = [d for d in ([actions] if isinstance(actions, DataFrame) else actions) if d is not None]
    if not moves:
        return None
    if align == "shift":
        return align_series([observations, *[d.withColumn(on, ref(on) + 1) for d in moves]], by)
    flags = ["_has_obs", *[f"_has_{i}" for i in range(len(moves))]]
    both = align_series([observations, *moves], by, flags=flags)
    acted = reduce(lambda a, b: a | b, [F.col(f) for f in flags[1:]])
    action_cols = {c for d in moves for c in d.columns} - set(by)
    # Key 0 gets the empty row, and its own row if some action has that key.
    kinds = F.when(ref(on) != 0, F.array(F.lit(False))).when(acted, F.array(F.lit(False), F.lit(True)))
    spread = both.withColumn("_empty", F.explode(kinds.otherwise(F.array(F.lit(True)))))
    return spread.select(
        *[
            F.when(~F.col("_empty"), ref(c)).alias(c) if c in action_cols else ref(c)
            for c in both.columns
            if c not in flags
        ]
    )


def assemble_by_join(observations: DataFrame, actions: DataFrame, on: str = "timestep") -> DataFrame:
    """``assemble`` for a single series whose keys may repeat, by outer join."""
    return full_outer(observations, leading_row(actions, on, 0), [on])


def alignment_report(left: DataFrame, right: DataFrame, on: Sequence[str] = ("timestep",)) -> DataFrame:
    """Length check plus what it does not see: unmatched and repeated keys."""
    by = [ref(k) for k in on]
    stacked = left.select(*by, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*by, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = stacked.groupBy(*by).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("unmatched_left"),
        F.count_if((F.col("r") > 0) & (F.col("l") == 0)).alias("unmatched_right"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("duplicated_keys"),
    ).withColumn("same_length", F.col("n_left") == F.col("n_right"))


def compare_series(
    a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Per column: identical, or the mean, largest and number of differences.

    Status is ``shape_mismatch`` when the numbers of rows differ, and no
    differences are given then. Series of one length that repeat a key cannot be
    paired, which is an error. Two missing values at one place count as equal.
    """
    by = [*keys, *on]
    left = a.select(*[ref(c) for c in by], F.lit(True).alias(SIDE), *[clean(a, c).alias(f"a_{c}") for c in cols])
    right = b.select(*[ref(c) for c in by], F.lit(False).alias(SIDE), *[clean(b, c).alias(f"b_{c}") for c in cols])
    both = (
        left.unionByName(right, allowMissingColumns=True)
        .groupBy(*[ref(c) for c in by])
        .agg(
            F.count_if(SIDE).alias("_in_a"),
            F.count_if(~F.col(SIDE)).alias("_in_b"),
            *[F.any_value(ref(f"{side}_{c}"), True).alias(f"{side}_{c}") for side in "ab" for c in cols],
        )
    )
    aggs = [
        F.sum("_in_a").alias("n_a"),
        F.sum("_in_b").alias("n_b"),
        F.max(F.greatest("_in_a", "_in_b")).alias("_most"),
    ]
    for i, c in enumerate(cols):
        x, y = ref(f"a_{c}"), ref(f"b_{c}")
        gap = F.abs(x - y)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.count_if(~(x.eqNullSafe(y) & (F.col("_in_a") == F.col("_in_b")))) == 0).alias("identical"),
                F.avg(gap).alias("mean_diff"),
                F.max(gap).alias("max_diff"),
                F.count_if(gap > 0).alias("n_diff"),
            ).alias(f"c{i}")
        )
    group = [ref(k) for k in keys]
    wide = both.groupBy(*group).agg(*aggs)
    rows = wide.select(*group, "n_a", "n_b", "_most", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cols))])).alias("_c"))
    comparable = F.col("n_a") == F.col("n_b")
    repeated = F.raise_error(F.lit("series of equal length repeat a key; number their rows first"))
    return rows.select(
        *group,
        "_c.column",
        F.when(~comparable, "shape_mismatch").when(F.col("_most") > 1, repeated.cast("string")).when(F.col("_c.identical"), "identical").otherwise("different").alias("status"),
        *[F.when(comparable, F.col(f"_c.{m}")).alias(m) for m in ("mean_diff", "max_diff", "n_diff")],
    )
