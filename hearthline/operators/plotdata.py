"""The tables behind the usual plots of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import clean, ref
from hearthline.operators.scoring import vector_health
from hearthline.operators.stats import correlation_long


def series(df: DataFrame, order: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Chosen columns in series order."""
    by = [ref(k) for k in keys]
    return df.select(*by, ref(order), *[ref(c) for c in cols if c in df.columns]).orderBy(*by, ref(order))


def series_buckets(df: DataFrame, order: str, cols: Sequence[str], width: int, keys: Sequence[str] = ()) -> DataFrame:
    """min, max and mean per ``width`` consecutive positions, for long series."""
    by = [ref(k) for k in keys]
    aggs = []
    for c in cols:
        v = clean(df, c)
        aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.avg(v).alias(f"{c}_avg")]
    return df.groupBy(*by, F.floor(ref(order) / width).alias("bucket")).agg(*aggs)


def series_preview(df: DataFrame, order: str, cols: Sequence[str], n: int = 1000) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.select(ref(order), *[ref(c) for c in cols]).orderBy(ref(order)).limit(n)


def point_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) points with their number, missing ones left out."""
    points = df.select(clean(df, x).alias("x"), clean(df, y).alias("y")).where("x is not null and y is not null")
    return points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def common_range(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ends of the line of equal values: least minimum and greatest maximum."""
    a, b = clean(df, x), clean(df, y)
    return df.agg(
        F.least(F.min(a), F.min(b)).alias("line_min"), F.greatest(F.max(a), F.max(b)).alias("line_max")
    )


def correlation_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlations with a two-decimal label per cell."""
    r = correlation_long(df, cols)
    label = F.when(F.col("r").isNotNull(), F.format_string("%.2f", F.col("r")))
    return r.select("col_a", "col_b", "r", label.alias("label"))


def vector_norms(df: DataFrame, order: str, vector: str = "embedding") -> DataFrame:
    return vector_health(df, vector).select(ref(order), "l2_norm").orderBy(ref(order))
