"""Response scores over the conversations, vector health over the embeddings."""

from pyspark.sql import functions as F

from bindings.base import query, rounded, table
from hearthline.operators import plotdata, scoring
from hearthline.presets import MIN_BLUEPRINT_CHARACTERS

WORDS = ["The", "eau", "und", "zone", "esen"]
WORDS_SQL = "['The', 'eau', 'und', 'zone', 'esen']"

# Each turn as the prompt of the next one; the response repeats its prompt.
PAIRS_SQL = """pairs AS (SELECT conv_id, turn, role, text AS prompt, text || ' ' || next AS response FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL)"""


def pairs(spark, sf):
    c = table(spark, sf, "conversations")
    ahead = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(ahead, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("prompt"),
        F.concat("text", F.lit(" "), "next").alias("response"),
    )


def _coverage(text):
    return f"len(list_filter({WORDS_SQL}, lambda k: contains(lower({text}), lower(k))))"


@query(
    "M1_keyword_scores",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, {_coverage('response')} AS keyword_matches, round({_coverage('response')} / 5.0, 6) AS keyword_coverage,
 length(response) - length(prompt) AS response_length FROM pairs""",
)
def keyword_scores(spark, sf):
    out = scoring.keyword_scores(pairs(spark, sf), keywords=WORDS)
    return rounded(out.select("conv_id", "turn", "keyword_matches", "keyword_coverage", "response_length"))


@query(
    "M1_keyword_scores_without_prompt",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, {_coverage('substr(response, length(prompt) + 1)')} AS keyword_matches FROM pairs""",
)
def keyword_scores_without_prompt(spark, sf):
    out = scoring.keyword_scores(pairs(spark, sf), keywords=WORDS, include_prompt=False)
    return out.select("conv_id", "turn", "keyword_matches")


# Whether the next turn takes up the second word of the one before it.
REPLIES_SQL = """replies AS (SELECT conv_id, turn, role, next AS response, split_part(text, ' ', 2) AS expected
 FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL)"""


def replies(spark, sf):
    c = table(spark, sf, "conversations")
    ahead = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return c.join(ahead, ["conv_id", "turn"]).select("conv_id", "turn", "role", "response", F.split_part("text", F.lit(" "), F.lit(2)).alias("expected"))


@query(
    "M2_contains_expected",
    f"WITH {REPLIES_SQL} SELECT conv_id, turn, contains(lower(response), lower(expected)) AS correct FROM replies",
)
def contains_expected(spark, sf):
    return scoring.contains_expected(replies(spark, sf)).select("conv_id", "turn", "correct")


@query(
    "M3_long_enough",
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, length(response) > length(prompt) + 10 AS long_enough FROM pairs",
)
def long_enough(spark, sf):
    return scoring.long_enough(pairs(spark, sf)).select("conv_id", "turn", "long_enough")


TERMS = ("thth", "eau", "keit", "ciónra", "@mail", "555-", "license")
TERMS_SQL = f"len(list_filter({list(TERMS)}, lambda k: contains(lower(text), k)))"


@query("M3_found_text", "SELECT doc_id, coalesce(length(text) > 200, false) AS success FROM documents")
def found_text(spark, sf):
    return scoring.found_text(table(spark, sf, "documents"), "text", 200).select("doc_id", "success")


@query("M3_found_text_by_preset", "SELECT p_partkey, length(p_name) > 20 AS success FROM part")
def found_text_by_preset(spark, sf):
    return scoring.found_text(table(spark, sf, "part"), "p_name", MIN_BLUEPRINT_CHARACTERS).select("p_partkey", "success")


@query(
    "M4_domain_terms",
    f"SELECT doc_id, {TERMS_SQL} AS term_matches, {TERMS_SQL} >= 2 AS success FROM documents",
)
def domain_terms(spark, sf):
    return scoring.domain_terms(table(spark, sf, "documents"), "text", TERMS).select("doc_id", "term_matches", "success")


@query(
    "M5_pass_flags",
    f"""WITH {REPLIES_SQL}, s AS (SELECT conv_id, avg({_coverage('response')} / 5.0) >= 0.4 AS a,
 avg(CAST(contains(lower(response), lower(expected)) AS INTEGER)) >= 0.5 AS b FROM replies GROUP BY 1)
SELECT conv_id, a AND b AS all_passed FROM s""",
)
def pass_flags(spark, sf):
    p = replies(spark, sf)
    scored = scoring.keyword_scores(p.withColumn("prompt", F.lit("")), keywords=WORDS)
    covered = scoring.score_summary(scored, "keyword_coverage", 0.4, keys=["conv_id"])
    right = scoring.score_summary(scoring.contains_expected(p), "correct", 0.5, keys=["conv_id"])
    return scoring.all_passed(covered.select("conv_id", "passed").union(right.select("conv_id", "passed")), keys=["conv_id"])


@query(
    "A15_score_summary",
    f"""WITH {PAIRS_SQL} SELECT role, count(*) AS n_responses, round(avg({_coverage('response')} / 5.0), 6) AS score,
 round(avg(length(response) - length(prompt)), 6) AS avg_response_length, avg({_coverage('response')} / 5.0) >= 0.6 AS passed FROM pairs GROUP BY 1""",
)
def score_summary(spark, sf):
    scored = scoring.keyword_scores(pairs(spark, sf), keywords=WORDS)
    return rounded(scoring.score_summary(scored, "keyword_coverage", 0.6, means=["response_length"], keys=["role"]))


@query(
    "A15_success_rate",
    f"SELECT lang, count(*) AS n_responses, round(avg(CAST({TERMS_SQL} >= 2 AS INTEGER)), 6) AS score, avg(CAST({TERMS_SQL} >= 2 AS INTEGER)) > 0.5 AS passed FROM documents GROUP BY 1",
)
def success_rate(spark, sf):
    scored = scoring.domain_terms(table(spark, sf, "documents"), "text", TERMS)
    return rounded(scoring.score_summary(scored, "success", 0.5, strict=True, keys=["lang"]))


@query(
    "M7_pair_by_position",
    """SELECT u.conv_id, u.turn AS prompt_id, md5(u.text) AS prompt_md5, md5(a.text) AS expected FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn AND u.role = 'user' AND a.role <> 'system'""",
)
def pair_by_position(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("turn", "prompt_id")
    prompts = c.where("role = 'user'").select("conv_id", "prompt_id", F.md5("text").alias("prompt_md5"))
    expected = c.where("role <> 'system'").select("conv_id", "prompt_id", F.md5("text").alias("expected"))
    return scoring.pair_by_position(prompts, expected, ["conv_id", "prompt_id"])


@query(
    "M7_zip_lists",
    """SELECT event_id, i::INTEGER AS prompt_id, list_extract([event_type, CAST(user_id AS VARCHAR), 'x'], i + 1) AS prompt,
 list_extract(['a', CAST(value AS VARCHAR) ], i + 1) IS NOT NULL AS has_expected FROM events, range(0, 2) r(i)""",
)
def zip_lists(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.array("event_type", F.col("user_id").cast("string"), F.lit("x")).alias("prompts"),
        F.array(F.lit("a"), F.col("value").cast("string")).alias("answers"),
    )
    out = scoring.zip_lists(df, "prompts", "answers")
    return out.select("event_id", "prompt_id", "prompt", F.col("expected").isNotNull().alias("has_expected"))


@query(
    "M6_vector_health",
    """SELECT vec_id, false AS has_nan, vec_id % 7 = 0 AS has_inf,
 CASE WHEN vec_id % 7 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) END AS l2_norm,
 vec_id % 7 <> 0 AS ok FROM embeddings""",
)
def vector_health(spark, sf):
    e = table(spark, sf, "embeddings")
    bad = F.array_append("embedding", F.lit(float("-inf")).cast("float"))
    e = e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, bad).otherwise(F.col("embedding")))
    out = scoring.vector_health(e).select("vec_id", "has_nan", "has_inf", "l2_norm", "ok")
    finite = F.abs(F.col("l2_norm")) < float("inf")
    return out.withColumn("l2_norm", F.when(finite, F.round("l2_norm", 5)).otherwise(F.col("l2_norm")))


@query(
    "M6_vectors_ok",
    "SELECT label, count(*) AS n_vectors, false AS has_nan, false AS has_inf, true AS ok FROM embeddings GROUP BY 1",
)
def vectors_ok(spark, sf):
    return scoring.vectors_ok(scoring.vector_health(table(spark, sf, "embeddings")), keys=["label"])


@query(
    "V5_vector_norms",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS l2_norm FROM embeddings",
)
def vector_norms(spark, sf):
    return rounded(plotdata.vector_norms(table(spark, sf, "embeddings"), "vec_id"), 5)
