"""Test items inside training texts, also edited ones.

Seeds are all runs of words of an item. They join the passages of texts to items; a bound
by the words of a passage leaves out pairs that cannot reach the least score, and a
Smith-Waterman alignment scores the others.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.shingles import runs
from hearthline.llm.sizes import sent_if_small
from hearthline.llm.vocabulary import Memo
from hearthline.session import materialize

WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
SHORT = 12  # items of fewer words count only if they stand in a text as they are


@lru_cache(maxsize=1)
def _hashes() -> Memo:
    return Memo(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words of a text, without signs; none for NULL."""
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and its end in ``passage`` (exclusive)."""
    places = np.arange(1, len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        step = np.maximum(step, 0)
        row[1:] = np.maximum.accumulate(step - GAP * places) + GAP * places  # gaps along the passage
        top = int(np.argmax(row))
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


@dataclass
class Items:
    """A block of test items with the places of their seeds."""

    keys: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted hashes
    places: dict[int, list[tuple[int, int]]]  # seed: (item, its place there)
    widths: list[int]  # of the seeds: items of fewer words have one seed of all their words

    @classmethod
    def of(cls, keys: list, words: list[np.ndarray], width: int) -> Items:
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(words):
            for at, gram in enumerate(runs(item, width).tolist()):
                places[gram].append((i, at))
        return cls(keys, words, np.array(sorted(places), np.uint64), dict(places), sorted({min(len(w), width) for w in words}))

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """The places in ``grams`` where a seed stands."""
        if not len(self.seeds):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        return np.flatnonzero(self.seeds[at] == grams)

    def found_in(self, words: np.ndarray, width: int, least: float) -> Iterator[tuple]:
        """(item key, score, begin, end) of each item's best passage in a text."""
        begins: dict[int, list[int]] = defaultdict(list)
        for size in self.widths:
            grams = runs(words, size) if len(words) >= size else words[:0]
            for at in self.hits(grams).tolist():
                for i, place in self.places[int(grams[at])]:
                    begins[i].append(at - place)
        if not begins:
            return
        there = np.unique(words)
        for i in self._reachable(list(begins), there, least):
            item = self.words[i]
            needed = (1.0 if len(item) < SHORT else least) * MATCH * len(item)
            reach = len(item) // 2 + width
            best = (0.0, 0, 0)
            for low, high in _near(sorted(begins[i]), len(item)):
                low, high = max(0, low - reach), min(len(words), high + len(item) + reach)
                if most_score(np.isin(item, words[low:high])) < needed:
                    continue
                score, end = smith_waterman(item, words[low:high])
                if score > best[0]:
                    best = score, low, low + end
            score, low, end = best
            if score >= needed:
                _, back = smith_waterman(item[::-1], words[low:end][::-1])
                yield self.keys[i], score / (MATCH * len(item)), end - back, end

    def _reachable(self, found: list[int], there: np.ndarray, least: float) -> list[int]:
        """Those of the items that a text of the words ``there`` (sorted) can hold at ``least``."""
        sizes = np.array([len(self.words[i]) for i in found])
        every = np.concatenate([self.words[i] for i in found])
        known = there[np.minimum(np.searchsorted(there, every), len(there) - 1)] == every
        shares = np.add.reduceat(known, np.cumsum(sizes) - sizes, dtype=np.int64)
        return [found[k] for k in np.flatnonzero(shares >= np.where(sizes < SHORT, 1.0, least) * sizes)]


def most_score(known: np.ndarray) -> int:
    """The greatest score of a local alignment of an item of which ``known`` words can match.

    Each word of the aligned part of the item is matched, replaced or left out.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(known, MATCH, max(MISMATCH, GAP)))])
    return int((sums - np.minimum.accumulate(sums)).max())


def _near(starts: list[int], apart: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of starts that are at most ``apart`` from the next."""
    low = last = starts[0]
    for start in starts[1:]:
        if start - last > apart:
            yield low, last
            low = start
        last = start
    yield low, last


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 4,
    least: float = 0.5,
    block: int = 10_000,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
) -> DataFrame:
    """The pairs of a document and a test item that stands in it, whole or edited.

    Words are lower-case and without signs. All runs of ``width`` words of
    each item are looked up in all texts, whatever their number there. Where one is met,
    the passage around it is aligned with the item, unless too few of the item's words
    stand in it for ``least``; the score is the alignment's, as a share of a perfect one,
    and ``least`` is the lowest returned; for items of fewer than ``SHORT`` words it is 1, and
    those of fewer than ``width`` words are looked up whole. ``first_word`` and ``end_word``
    bound the passage.

    Items are taken in blocks of about ``block``, the only data sent to every task; the
    number of blocks follows the benchmark. Texts are read whole, once per block, and
    never exchanged. NULL or empty texts, items without words and NULL keys give
    nothing; equal items are all reported; repeated rows give one pair.
    """
    parts = -(-benchmark.count() // block) or 1
    wanted = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).where("text IS NOT NULL AND node IS NOT NULL")
    types = f"node {docs.schema[key].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}"
    found = [_leaks_of(texts, wanted.where(F.col("part") == p).drop("part"), width, least, types) for p in range(parts)]
    best = F.max(F.struct("score", (-F.col("first_word")).alias("early"), "end_word")).alias("best")
    pairs = reduce(DataFrame.union, found).groupBy("node", "item").agg(best)
    return pairs.select(
        F.col("node").alias(key),
        F.col("item").alias(item),
        "best.score",
        (-F.col("best.early")).alias("first_word"),
        "best.end_word",
    )


def _leaks_of(texts: DataFrame, wanted: DataFrame, width: int, least: float, types: str) -> DataFrame:
    rows = wanted.distinct().toPandas().sort_values("item", kind="stable")
    with np.errstate(over="ignore"):
        worded = [(k, w) for k, w in zip(rows["item"].tolist(), map(plain_words, rows["text"]), strict=True) if len(w)]
        items = Items.of([k for k, _ in worded], [w for _, w in worded], width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [
                    (node, *leak)
                    for node, text in zip(batch["node"], batch["text"], strict=True)
                    for leak in items.found_in(plain_words(text), width, least)
                ]
                yield pd.DataFrame(found, columns=["node", "item", "score", "first_word", "end_word"])

    return texts.mapInPandas(run, f"{types}, score double, first_word int, end_word int")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents in which no test item stands; rows with a NULL key stay."""
    gone = materialize(leaks(docs, benchmark, key=key, **options).select(key).distinct())
    return docs.join(sent_if_small(gone), key, "left_anti").select(docs.columns)
