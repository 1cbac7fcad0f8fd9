"""Row numbers in file order, without shuffling the rows.

A file is read in splits, and a split is read front to back by one task. So a
row number is the number of rows in the earlier splits plus the row's place in
its own split. Only one small row per split is aggregated; the data itself is
scanned twice (the first time for counts alone) and never exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


FILE = "_hl_file"
BLOCK = "_hl_block"
MARK = "_hl_mark"


def with_scan_marks(scan: DataFrame) -> DataFrame:
    """Add file, split and in-task order to a frame that is a bare file scan."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(MARK),
    )


def number_rows(marked: DataFrame, name: str, per_file: bool = False, start: int = 0) -> DataFrame:
    """Replace the scan marks by a row number, per file or over all files.

    Files follow each other in path order. ``marked`` must come straight from
    ``with_scan_marks`` with projections at most: a filter or shuffle before
    the numbering would change what is counted.
    """
    splits = marked.groupBy(FILE, BLOCK).agg(F.min(MARK).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy(FILE, BLOCK)
    if per_file:
        earlier = Window.partitionBy(FILE).orderBy(BLOCK)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        F.col(FILE),
        F.col(BLOCK),
        F.col("_first"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    return marked.join(offsets, [FILE, BLOCK]).select(
        *[c for c in marked.columns if c not in (FILE, BLOCK, MARK)],
        F.col(FILE),
        (F.col(MARK) - F.col("_first") + F.col("_before") + start).alias(name),
    )
