"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """NULL and empty texts, NULL keys and other columns, repeated rows, a very long text,
    and extra columns named like results."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, " \n\t ", "en", None, 4),
        (None, "a text without a key", "en", "src0", 20),
        (4, "the same row twice", "en", "src0", 18),
        (4, "the same row twice", "en", "src0", 18),
        (5, long, "en", "src1", len(long)),
        (6, long, "en", "src1", len(long)),
        (7, "é😀ß \x00\x1c <|endoftext|>", "fr", "src1", None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("n_tokens", "kept", "spans", "score", "class_id", "sequence_id", "component", "node", "key"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def no_items(spark):
    return spark.createDataFrame([], "item_id long, text string")
