"""From raw documents to packed training sequences, as stages that each call one operator.

A stage takes the documents that the one before it kept, all of them, and returns a
table with the same columns; the last one returns the packing. Extra columns pass
through. Rows with a NULL text or key: quality rules drop texts without words; a NULL
key is kept by the stages in between and packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.decontamination import without_leaks
from hearthline.llm.neardup import without_near_copies
from hearthline.llm.packing import pack
from hearthline.llm.quality import fit_rules, judged
from hearthline.llm.secret_scan import find_secrets
from hearthline.llm.spans import replaced
from hearthline.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048
IN_PLACE_OF_SECRETS = "[secret]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the forest keep."""
    forest = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, forest, into="_rules").where("_rules.kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item stands."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    found = find_secrets(docs, into="_secrets")
    clean = found.withColumn("text", replaced(F.col("text"), F.col("_secrets"), IN_PLACE_OF_SECRETS))
    if "n_chars" in docs.columns:
        length = F.when(F.size("_secrets") > 0, F.length("text")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(VOCABULARY), SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", packing),
]

#: Isolation forests, alignments and tokenizers have no SQL form; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
