"""The stages one after the other."""

import re

import corpus_pipeline
import pytest
from frames import SMALL, awkward
from hearthline.llm.decontamination import leaks
from hearthline.llm.neardup import near_classes

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        assert after.columns == columns and 0 < after.count() <= docs.count()
        docs = after
    assert near_classes(docs).where("doc_id != class_id").isEmpty()
    assert leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).isEmpty()
    for r in docs.collect():
        assert r.n_chars == len(r.text)
        assert not re.search(r"[0-9a-f]{16}|(?i:token) = \"?[A-Za-z0-9]{12}", r.text)
    packed = STAGES["best-fit packing"](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 0 and "sequence_id" in rows.columns


@pytest.mark.parametrize("name", ["near-duplicates", "decontamination", "secret scans", "best-fit packing", "quality rules"])
def test_awkward_and_empty_tables(spark, name):
    for frame in (awkward(spark), awkward(spark).limit(0)):
        made = STAGES[name](spark, frame, SMALL)
        assert made.count() <= 10**6
        if name != "best-fit packing":
            assert made.columns == frame.columns
