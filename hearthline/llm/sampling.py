"""Bounded samples of labelled rows, to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_keys(labelled: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` keys of each label, spread evenly and always the same ones.

    Keys are dealt into ``per_label`` buckets by hash, and each bucket gives the key
    with the least second hash. Both are plain aggregates with map-side combine, so a
    label that holds most rows costs no more than others. NULL keys and labels are left
    out.
    """
    order = F.xxhash64(F.col(key), F.lit(1))
    dealt = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key), F.col(label), F.pmod(F.xxhash64(F.col(key), F.lit(0)), F.lit(per_label)).alias("_bucket"), order.alias("_order")
    )
    picked = dealt.groupBy(label, "_bucket").agg(F.min_by(key, "_order").alias(key))
    return picked.select(key, label)
