"""Scoring of response tables and health of vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import ref
from hearthline.presets import BLUEPRINT_MIN_TERMS, BLUEPRINT_TERMS, MIN_NEW_CHARACTERS, MIN_OCR_CHARACTERS


def _terms_in(text: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda k: F.contains(F.lower(text), F.lower(k))))


def keyword_scores(
    df: DataFrame,
    response: str = "response",
    keywords: str | Sequence[str] = "keywords",
    prompt: str | None = "prompt",
    include_prompt: bool = True,
) -> DataFrame:
    """Adds keyword_matches, keyword_coverage and response_length.

    ``keywords`` is an array column or a fixed list. The response is taken to
    begin with its prompt, so prompt words count as hits unless
    ``include_prompt`` is off.
    """
    terms = ref(keywords) if isinstance(keywords, str) else F.array(*[F.lit(k) for k in keywords])
    text = ref(response)
    length = F.length(text)
    if prompt is not None:
        length = length - F.length(ref(prompt))
        if not include_prompt:
            text = F.substring(text, F.length(ref(prompt)) + 1, F.length(text))
    hits = _terms_in(text, terms)
    return df.withColumns(
        {
            "keyword_matches": hits,
            "keyword_coverage": F.try_divide(hits.cast("double"), F.size(terms).cast("double")),
            "response_length": length,
        }
    )


def contains_expected(df: DataFrame, response: str = "response", expected: str = "expected") -> DataFrame:
    """Adds ``correct``: the expected answer occurs in the response, any case."""
    return df.withColumn("correct", F.contains(F.lower(ref(response)), F.lower(ref(expected))))


def long_enough(
    df: DataFrame, response: str = "response", prompt: str | None = "prompt", margin: int = MIN_NEW_CHARACTERS
) -> DataFrame:
    """Adds ``long_enough``: more than ``margin`` characters beyond the prompt."""
    base = F.lit(0) if prompt is None else F.length(ref(prompt))
    return df.withColumn("long_enough", F.length(ref(response)) > base + margin)


def found_text(df: DataFrame, response: str = "response", margin: int = MIN_OCR_CHARACTERS) -> DataFrame:
    """Adds ``success``: text read from a picture has more than ``margin`` characters.

    ``MIN_OCR_CHARACTERS`` is the limit for a sample picture,
    ``MIN_BLUEPRINT_CHARACTERS`` that for a drawing. A missing text is no success.
    """
    return df.withColumn("success", F.coalesce(F.length(ref(response)) > margin, F.lit(False)))


def domain_terms(
    df: DataFrame,
    response: str = "response",
    terms: Sequence[str] = BLUEPRINT_TERMS,
    at_least: int = BLUEPRINT_MIN_TERMS,
) -> DataFrame:
    """Adds term_matches and ``success`` when enough terms occur."""
    hits = _terms_in(ref(response), F.array(*[F.lit(t) for t in terms]))
    return df.withColumns({"term_matches": hits, "success": hits >= at_least})


def score_summary(
    df: DataFrame,
    score: str,
    threshold: float,
    strict: bool = False,
    means: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean score (or rate of a boolean), further means, and the pass flag."""
    kind = df.schema[score].dataType.simpleString()
    value = F.avg(ref(score).cast("int") if kind == "boolean" else ref(score))
    passed = value > threshold if strict else value >= threshold
    return df.groupBy(*[ref(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_responses"),
        value.alias("score"),
        *[F.avg(ref(m)).alias(f"avg_{m}") for m in means],
        passed.alias("passed"),
    )


def all_passed(df: DataFrame, flag: str = "passed", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[ref(k) for k in keys]).agg(F.bool_and(ref(flag)).alias("all_passed"))


def pair_by_position(prompts: DataFrame, expectations: DataFrame, on: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """Prompts with the expectation at the same place; leftovers are dropped."""
    return prompts.join(expectations, list(on))


def zip_lists(df: DataFrame, prompts: str, expectations: str) -> DataFrame:
    """The same for two array columns: one row per place both arrays have."""
    both = F.arrays_zip(ref(prompts).alias("prompt"), ref(expectations).alias("expected"))
    n = F.least(F.size(ref(prompts)), F.size(ref(expectations)))
    return df.select(
        *[ref(c) for c in df.columns if c not in (prompts, expectations)],
        F.posexplode(F.slice(both, 1, n)).alias("prompt_id", "_p"),
    ).select(
        *[ref(c) for c in df.columns if c not in (prompts, expectations)],
        "prompt_id",
        F.col("_p.prompt").alias("prompt"),
        F.col("_p.expected").alias("expected"),
    )


def vector_health(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds has_nan, has_inf, l2_norm and ``ok`` per vector.

    A missing element counts as NaN, and the norm is then NULL; a missing vector
    has neither and is not ok.
    """
    v = ref(vector)
    nan = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    inf = F.coalesce(F.exists(v, lambda x: F.coalesce(F.abs(x) == float("inf"), F.lit(False))), F.lit(False))
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return df.withColumns({"has_nan": nan, "has_inf": inf, "l2_norm": F.sqrt(total), "ok": ~(nan | inf) & v.isNotNull()})


def vectors_ok(health: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether any vector holds NaN or Inf, over the whole table."""
    return health.groupBy(*[ref(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.bool_or("has_nan").alias("has_nan"),
        F.bool_or("has_inf").alias("has_inf"),
        F.bool_and("ok").alias("ok"),
    )
