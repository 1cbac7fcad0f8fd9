"""Spans of patterns in texts, with Spark functions only.

A span has ``kind``, ``begin``, ``end`` (code points, end exclusive), the matched text
``found``, and ``part``, the group of it that a check looks at. Matches of a kind are
leftmost and do not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,begin:int,end:int,found:string,part:string>>"


def no_spans() -> Column:
    return F.lit([]).cast(SPANS)


def matches(text: Column, kind: str, pattern: str, part: int = 0, needs: str | None = None) -> Column:
    """All matches of ``pattern``; ``part`` is the group kept beside the match.

    The text is cut into pairs of what stands before a match and the match; positions
    are running sums of their lengths. ``needs`` is a cheaper pattern without which
    there is no match; texts that lack it are not cut. ``pattern`` must not match the
    empty string. A NULL text has no spans.
    """
    cut = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    groups = [F.regexp_extract_all(text, cut, F.lit(i)) for i in ((1, 2, 2 + part) if part else (1, 2))]
    pieces = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("before", "found", "part"), strict=False)))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["before"])
        end = begin + F.length(piece["found"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            begin.alias("begin"),
            end.alias("end"),
            piece["found"].alias("found"),
            piece["part" if part else "found"].alias("part"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), no_spans().alias("spans"))
    spans = F.aggregate(F.filter(pieces, lambda p: p["found"] != ""), start, step, lambda state: state["spans"])
    return F.when(text.rlike(needs or pattern), spans).otherwise(no_spans())


def ordered(spans: Column, kinds: Sequence[str]) -> Column:
    """Spans by begin, then in the order of ``kinds``, then by end."""

    def earlier(a: Column, b: Column) -> Column:
        kind = F.lit(list(kinds))
        places = [(s["begin"], F.array_position(kind, s["kind"]), s["end"]) for s in (a, b)]
        order = F.lit(0)
        for left, right in reversed(list(zip(*places, strict=True))):
            order = F.when(left < right, -1).when(left > right, 1).otherwise(order)
        return order

    return F.array_sort(spans, earlier)


def listed(spans: Column) -> Column:
    """``kind:begin:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that share no position with any of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["begin"] < o["end"]) & (o["begin"] < s["end"])))


def replaced(text: Column, spans: Column, by: str) -> Column:
    """The text with each stretch that ordered spans cover replaced by ``by``."""

    def step(state: Column, span: Column) -> Column:
        kept = F.when(
            span["begin"] >= state["at"],
            F.concat(state["text"], F.substring(text, state["at"] + 1, span["begin"] - state["at"]), F.lit(by)),
        ).otherwise(state["text"])
        return F.struct(kept.alias("text"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
