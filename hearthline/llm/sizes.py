"""Broadcasts of frames whose size has been counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_NUMBERS = 20_000_000  # of four bytes or so, in the lists of a frame that is sent


def sent_if_small(kept: DataFrame, most_rows: int = 500_000, numbers: Column | None = None) -> DataFrame:
    """A stored frame with a broadcast hint if it has at most ``most_rows`` rows.

    For frames of a few numbers per row, so that the bound is one of bytes as well. Rows with
    lists have ``numbers`` in them, of which there may be ``MOST_NUMBERS`` in all.
    Beyond it the join that follows shuffles both sides; its result is the same.
    """
    if kept.limit(most_rows + 1).count() > most_rows:
        return kept
    if numbers is not None and (kept.agg(F.sum(numbers)).first()[0] or 0) > MOST_NUMBERS:
        return kept
    return F.broadcast(kept)
