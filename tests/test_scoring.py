"""Response scores and vector health."""

import math

from conftest import rows

from hearthline.operators import scoring


def test_keyword_coverage(spark):
    df = spark.createDataFrame(
        [("Ask x1 ", "Ask x1 energy ZONE", ["Energy", "zone", "x1"]), ("p", "p", [])],
        "prompt string, response string, keywords array<string>",
    )
    got = scoring.keyword_scores(df).collect()
    assert [(r["keyword_matches"], r["keyword_coverage"], r["response_length"]) for r in got] == [(3, 1.0, 11), (0, None, 0)]
    assert scoring.keyword_scores(df, include_prompt=False).first()["keyword_coverage"] == 2 / 3


def test_limits(spark):
    df = spark.createDataFrame([("p" * 5, "x" * 15), ("p" * 5, "x" * 16)], "prompt string, response string")
    assert rows(scoring.long_enough(df), "long_enough") == [(False,), (True,)]
    assert rows(scoring.long_enough(df, prompt=None, margin=15), "long_enough") == [(False,), (True,)]


def test_expected_and_terms(spark):
    df = spark.createDataFrame([("It is 50 KWH", "50 kWh"), ("none", "$2")], "response string, expected string")
    assert rows(scoring.contains_expected(df), "correct") == [(False,), (True,)]
    terms = spark.createDataFrame([("The ROOM has a VAV box",), ("room room",)], "response string")
    assert rows(scoring.domain_terms(terms), "term_matches", "success") == [(1, False), (2, True)]


def test_summary_and_pass(spark):
    df = spark.createDataFrame([(0.6,), (0.6,)], "keyword_coverage double")
    assert rows(scoring.score_summary(df, "keyword_coverage", 0.6)) == [(2, 0.6, True)]
    half = spark.createDataFrame([(True,), (False,)], "success boolean")
    assert rows(scoring.score_summary(half, "success", 0.5, strict=True)) == [(2, 0.5, False)]
    flags = spark.createDataFrame([(True,), (False,)], "passed boolean")
    assert rows(scoring.all_passed(flags)) == [(False,)]


def test_pairs_drop_leftovers(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", "y"])], "p array<string>, e array<string>")
    assert rows(scoring.zip_lists(df, "p", "e")) == [(0, "a", "x"), (1, "b", "y")]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [math.nan, 1.0]), (2, [-math.inf])], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in scoring.vector_health(df).collect()}
    assert (got[0]["l2_norm"], got[0]["ok"]) == (5.0, True)
    assert (got[1]["has_nan"], got[1]["has_inf"], got[1]["ok"]) == (True, False, False)
    assert (got[2]["has_nan"], got[2]["has_inf"], got[2]["ok"]) == (False, True, False)
    assert rows(scoring.vectors_ok(scoring.vector_health(df))) == [(3, True, True, False)]
