"""Secrets in texts: known forms, and strings whose characters look drawn at random."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.spans import apart_from, matches, ordered

KINDS = ("assign", "access", "hex", "entropy")

# The forms of known secrets and the least lengths of a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Strings that may be secrets without any context: whole runs, then their parts between
#: slashes, then those between any signs. Each is judged by itself.
CANDIDATES = (r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+_=-]{20,}", r"[A-Za-z0-9]{20,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Character classes of candidates, the first that fits counts: name, pattern of the
#: whole string, and the bits per character that a window must reach.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("alphanumeric", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.7),
    ("symbols", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).*[+/_=-]", 3.9),
    ("one case", r"^(?=(?:.*?[0-9]){4})(?=(?:.*?[A-Za-z]){4})(?:[a-z0-9+_=-]+|[A-Z0-9+_=-]+)$", 4.0),
    ("letters", r"^(?=(?:.*?[a-z][A-Z]){4})[A-Za-z]+$", 3.9),
)
#: Candidates that are no secrets: identifiers of a fixed form, placeholders, alphabets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefghij",
    r"(.)\1{5,}",
)


def window_entropy(text: Column, window: int) -> Column:
    """The greatest Shannon entropy, in bits, of ``window`` neighbouring characters.

    Counts per character move along with the window: one character comes in, one goes
    out, and the sum of c log2 c changes by their terms only. NULL for shorter texts;
    characters outside of ``ALPHABET`` count as one.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1)
    late = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
    moves = F.slice(F.arrays_zip(codes.alias("comes"), late.alias("goes")), 1, F.length(text))

    def term(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)

    def step(state: Column, move: Column) -> Column:
        comes, goes, counts = move["comes"], move["goes"], state["counts"]
        more, fewer = F.element_at(counts, comes), F.element_at(counts, F.coalesce(goes, F.lit(1)))
        gain = term(more + 1) - term(more)
        loss = F.when(goes.isNull(), 0.0).otherwise(term(fewer) - term(fewer - 1))
        total = state["sum"] + F.when(goes.isNull() | (goes != comes), gain - loss).otherwise(0.0)
        shift = lambda n, k: n + (k + 1 == comes).cast("int") - F.coalesce((k + 1 == goes).cast("int"), F.lit(0))
        bits = math.log2(window) - total / window
        return F.struct(
            (state["seen"] + 1).alias("seen"),
            F.transform(counts, shift).alias("counts"),
            total.alias("sum"),
            F.when(state["seen"] + 1 >= window, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"),
        )

    start = F.struct(
        F.lit(0).alias("seen"),
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("double").alias("best"),
    )
    return F.aggregate(moves, start, step, lambda state: state["best"])


def entropy_spans(
    text: Column, candidate: str, window: int, classes: Sequence[tuple[str, str, float]], allowed: Sequence[str]
) -> Column:
    """Candidates with a window as rich as their class asks for, without allowed ones."""

    def secret(span: Column) -> Column:
        found = span["found"]
        needed = F.lit(None).cast("double")
        for _, pattern, bits in reversed(classes):
            needed = F.when(found.rlike(pattern), bits).otherwise(needed)
        for pattern in allowed:
            needed = F.when(~found.rlike(pattern), needed)
        return F.when(needed.isNotNull(), F.coalesce(window_entropy(found, window) >= needed, F.lit(False))).otherwise(False)

    return F.filter(matches(text, "entropy", candidate), secret)


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    window: int = 20,
    classes: Sequence[tuple[str, str, float]] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
    candidates: Sequence[str] = CANDIDATES,
    into: str = "secrets",
) -> DataFrame:
    """Adds the column ``into``: ordered spans of the secrets in each whole text.

    Kinds: ``assign`` (a name that promises a secret, and a value), ``access`` (access
    key ids), ``hex`` (long hexadecimal strings), and ``entropy``: strings of which some
    ``window`` characters reach the entropy of their character class, unless a pattern
    in ``allowed`` matches them or another span covers part of them. Where a run is none,
    its parts are tried (``candidates``, coarse ones first), so an allowed word beside a
    secret does not hide it. NULL or empty texts have an empty list; rows keep their number and order of columns, and a column
    that has the name ``into`` already is replaced. Only Spark functions are used and no
    rows are exchanged.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        F.filter(matches(whole, "assign", ASSIGN, part=1, needs="[:=]"), lambda s: F.length(s["part"]) >= ASSIGN_VALUE),
        matches(whole, "access", ACCESS),
        matches(whole, "hex", HEX),
    )
    named = docs.withColumn(into, base)
    for candidate in candidates:
        added = entropy_spans(whole, candidate, window, classes, allowed)
        named = named.withColumn(into, F.concat(F.col(into), apart_from(added, F.col(into))))
    return named.withColumn(into, ordered(F.col(into), KINDS))
