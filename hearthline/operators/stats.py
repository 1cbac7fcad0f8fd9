"""Profiles, ranges, exact quantiles, outliers, histograms and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.numbers import (
    PACKED,
    clean,
    is_missing,
    is_numeric,
    packed,
    ref,
    unpacked,
)
from hearthline.operators.columns import numeric_columns


def _rows_per_column(agg: DataFrame, cells: list[Column]) -> DataFrame:
    return agg.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Missing values (NULL or NaN) per column, in one pass."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(cols)])
    out = _rows_per_column(
        counts, [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_missing")) for i, c in enumerate(cols)]
    )
    return out.where("n_missing > 0") if only_missing else out


def column_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum and maximum per column, missing values left out."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(clean(df, c)).alias(f"lo{i}"), F.max(clean(df, c)).alias(f"hi{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"lo{i}").cast("double").alias("min"),
            F.col(f"hi{i}").cast("double").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    return _rows_per_column(df.agg(*aggs), cells)


def quantiles(
    df: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Exact quantiles with linear interpolation: keys, column, q, quantile.

    Two scans for all columns together. The first builds a mergeable sketch per key and
    column, whose ranks are off by at most 1 in ``accuracy``; twice that on either side of
    a wanted rank gives a bracket that holds it. The second counts the rows below each
    bracket and the values inside, a few in ``accuracy`` of all, and only those are
    ranked. A group of less than four times ``accuracy`` rows is its own bracket,
    and a bracket that would reach beyond the first or last rank ends at the least or
    greatest value.
    """
    wide = [(i, float(q)) for i in range(len(cols)) for q in qs]
    if not wide:
        raise ValueError("no column or no quantile is named")
    values = packed(df, keys).select(PACKED, *[clean(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    ends = [min(max(q + side * 2.0 / accuracy, 0.0), 1.0) for q in qs for side in (-1, 1)]
    sketches = []
    for i in range(len(cols)):
        v = F.col(f"v{i}")
        sketches += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        sketches.append(F.percentile_approx(v, ends, accuracy).alias(f"s{i}"))
    sketched = values.groupBy(PACKED).agg(*sketches)
    bracket = []
    for at, (i, _) in enumerate(wide):
        few, place = F.col(f"n{i}") < 4 * accuracy, 2 * (at % len(qs))
        low, high = (
            F.when(few | F.lit(ends[place + side] in (0.0, 1.0)), F.col(f"{end}{i}")).otherwise(F.get(f"s{i}", F.lit(place + side)))
            for end, side in (("lo", 0), ("hi", 1))
        )
        bracket.append(F.struct(low.alias("low"), high.alias("high"), F.col(f"n{i}").alias("total")))
    brackets = sketched.select(PACKED, *[b.alias(f"b{at}") for at, b in enumerate(bracket)])

    cells, below = [], []
    for at, (i, _) in enumerate(wide):
        v, b = F.col(f"v{i}"), f"b{at}"
        cells.append(F.when((v >= F.col(f"{b}.low")) & (v <= F.col(f"{b}.high")), F.struct(F.lit(at).alias("at"), v.alias("value"))))
        below.append(F.when(v < F.col(f"{b}.low"), 1).otherwise(0).alias(f"l{at}"))
    every_row = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("double").alias("value"))
    spread = values.join(brackets, PACKED).select(PACKED, *below, F.explode(F.array_compact(F.array(every_row, *cells))).alias("_c"))
    counted = spread.groupBy(PACKED, "_c").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"l{at}") for at in range(len(wide))]).alias("below")
    )
    group = Window.partitionBy(PACKED)
    known = counted.withColumn("below", F.max(F.when(F.col("_c.at") < 0, F.col("below"))).over(group)).where("_c.at >= 0")
    inside = Window.partitionBy(PACKED, "_c.at").orderBy("_c.value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = known.join(brackets.select(PACKED, F.array(*[f"b{at}.total" for at in range(len(wide))]).alias("total")), PACKED)
    placed = named.select(
        PACKED,
        F.col("_c.at").alias("at"),
        F.col("_c.value").alias("value"),
        (F.get("below", "_c.at") + F.sum("n").over(inside)).alias("upto"),
        "n",
        F.get("total", "_c.at").alias("total"),
        F.get(F.array(*[F.lit(q) for _, q in wide]), "_c.at").alias("q"),
    )
    place = F.col("q") * (F.col("total") - 1)

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))

    found = placed.groupBy(PACKED, "at", "q", "total").agg(at_rank(F.floor(place)).alias("low"), at_rank(F.ceil(place)).alias("high"))
    part = place - F.floor(place)
    missed = F.raise_error(F.lit("a sketch was less accurate than it promises; raise `accuracy`"))
    low, high = (F.coalesce(end, missed.cast("double")) for end in ("low", "high"))
    # At a whole rank no neighbour is involved, so infinities stay what they are.
    between = F.when((part == 0.0) | (low == high), low).otherwise(low * (1.0 - part) + high * part)
    column = F.get(F.array(*[F.lit(cols[i]) for i, _ in wide]), "at").alias("column")
    return found.select(*unpacked(keys), column, "q", between.alias("quantile"))


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max of each numeric column."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = clean(df, c).cast("double")
        aggs.append(
            F.struct(
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.when(F.count(v) > 1, F.stddev_samp(v)).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"c{i}")
        )
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s")) for i, c in enumerate(cols)]
    base = _rows_per_column(df.agg(*aggs), cells).select("column", "s.*")
    q = (
        quantiles(df, cols, (0.25, 0.5, 0.75))
        .groupBy("column")
        .agg(
            F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q25"),
            F.max(F.when(F.col("q") == 0.5, F.col("quantile"))).alias("q50"),
            F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q75"),
        )
    )
    return base.join(q, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def _value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per distinct non-missing value of each column, as text."""
    cells = [F.struct(F.lit(c).alias("column"), clean(df, c).cast("string").alias("value")) for c in cols]
    return (
        df.select(F.explode(F.array(*cells)).alias("_c"))
        .select("_c.column", "_c.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, unique, most frequent value and its frequency of each text column.

    The smallest of several equally frequent values is reported.
    """
    cols = list(cols or [c for c in df.columns if not is_numeric(df, c)])
    found = (
        _value_counts(df, cols)
        .groupBy("column")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct(-F.col("n"), F.col("value"))).alias("_top"),
        )
    )
    return found.select("column", "count", "unique", F.col("_top.value").alias("top"), (-F.col("_top.col1")).alias("freq"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column; the value itself if there is one.

    Counting values per column first keeps every column's distinct count
    spread over all tasks. ``approximate`` counts by sketch in a single pass.
    """
    cols = list(cols or df.columns)
    if approximate:
        aggs = [
            F.struct(
                F.lit(c).alias("column"),
                F.approx_count_distinct(clean(df, c)).alias("n_unique"),
                F.min(clean(df, c).cast("string")).alias("lo"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
        found = _rows_per_column(df.agg(*aggs), [F.col(f"c{i}") for i in range(len(cols))])
    else:
        counted = (
            _value_counts(df, cols)
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_unique"), F.min("value").alias("lo"))
        )
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
        found = names.join(counted, "column", "left").select(
            "column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "lo"
        )
    constant = F.col("n_unique") == 1
    return found.select(
        "column", "n_unique", constant.alias("is_constant"), F.when(constant, F.col("lo")).alias("value")
    )


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """q1, q3 and the limits ``q1 - k*iqr`` and ``q3 + k*iqr``, per key.

    A spread that is not finite sets no limit on that side.
    """
    by = [ref(x) for x in keys]
    q = quantiles(df, [col], (0.25, 0.75), keys).groupBy(*by).agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q3"),
    )
    spread = (F.col("q3") - F.col("q1")) * k
    return q.select(
        *by, "q1", "q3", F.nanvl(F.col("q1") - spread, F.lit(None)).alias("lower"), F.nanvl(F.col("q3") + spread, F.lit(None)).alias("upper")
    )


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """Rows outside the limits of ``iqr_bounds``, with the limits."""
    bounds = iqr_bounds(df, col, k, keys)
    value = clean(df, col)
    outside = (value < F.col("lower")) | (value > F.col("upper"))
    if keys:
        limits = packed(bounds, keys).select(PACKED, "lower", "upper")
        return packed(df, keys).join(limits, PACKED).where(outside).drop(PACKED)
    limits = bounds.select(F.struct("lower", "upper")).scalar()
    return df.withColumn("_b", limits).withColumns({"lower": F.col("_b.lower"), "upper": F.col("_b.upper")}).drop(
        "_b"
    ).where(outside)


def grouped_stats(
    df: DataFrame, keys: Sequence[str], col: str, fns: Sequence[str] = ("avg", "min", "max")
) -> DataFrame:
    """Statistics of one measure per key; rows without a key are left out."""
    value = clean(df, col)
    kept = df
    for key in keys:
        kept = kept.where(~is_missing(df, key))
    return kept.groupBy(*[ref(k) for k in keys]).agg(*[getattr(F, fn)(value).alias(fn) for fn in fns])


def continuity_check(
    df: DataFrame, day_cols: Sequence[str], per_day: int = 24, keys: Sequence[str] = ()
) -> DataFrame:
    """Expected rows (distinct days times ``per_day``) against actual rows.

    Rows without a complete day still count as actual rows.
    """
    known = F.lit(True)
    for c in day_cols:
        known = known & ~is_missing(df, c)
    by = [ref(k) for k in keys]
    days = (
        df.withColumn("_known", known)
        .groupBy(*by, "_known", *[ref(c) for c in day_cols])
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by)
        .agg((F.count_if("_known") * per_day).alias("expected_rows"), F.sum("n").alias("actual_rows"))
    )
    return days.withColumn(
        "status", F.when(F.col("expected_rows") == F.col("actual_rows"), "ok").otherwise("gap")
    )


def correlation_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, over complete pairs.

    NULL where either column is constant or fewer than two pairs are complete.
    All pairs come from one pass; each row is spread over the pairs and folded
    again before anything is exchanged.
    """
    cols = list(cols or numeric_columns(df))
    values = df.select(*[clean(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    pairs = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
        for i in range(len(cols))
        for j in range(i, len(cols))
    ]
    sums = (
        values.select(F.explode(F.array(*pairs)).alias("_p"))
        .select("_p.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("i", "j")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_sxy("y", "x").alias("sxy"),
            F.regr_sxx("y", "x").alias("sxx"),
            F.regr_syy("y", "x").alias("syy"),
        )
    )
    r = F.when(
        (F.col("n") > 1) & (F.col("sxx") > 0) & (F.col("syy") > 0),
        F.greatest(F.least(F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")), F.lit(1.0)), F.lit(-1.0)),
    )
    names = F.array(*[F.lit(c) for c in cols])
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return sums.select(r.alias("r"), F.explode(both).alias("_p")).select(
        F.get(names, "_p.i").alias("col_a"), F.get(names, "_p.j").alias("col_b"), "r"
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the finite values: bin, lower, upper, n.

    All bins are listed, empty ones too. Equal values give a one-wide range
    around them.
    """
    value = clean(df, col).cast("double")
    finite = df.select(value.alias("v")).where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    limits = finite.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ).alias("b")
    )
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    place = F.least(F.floor((F.col("v") - F.col("b.lo")) / width) + 1, F.lit(bins)).cast("int")
    counts = finite.withColumn("b", limits.scalar()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    listed = frame.join(F.broadcast(counts), "bin", "left").withColumn("b", limits.scalar())
    return listed.where(F.col("b.lo").isNotNull()).select(
        "bin",
        (F.col("b.lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("b.lo") + width * F.col("bin")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_excluded(df: DataFrame, col: str) -> DataFrame:
    """How many rows have no finite value and so are in no bin."""
    v = ref(col).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.agg(F.count_if(finite).alias("n_binned"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("n_excluded"))
