"""Quality rules: statistics of a text, judged by an isolation forest."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.sampling import bounded_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHERS = ("n_upper", "n_marks")
VERDICT = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words inside of windows of ``width`` words that occur at least twice."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + width - max(upto, at)
            upto = at + width
    return covered


def statistics_of(text: str) -> tuple[int, ...]:
    """``COUNTS`` and ``OTHERS`` of one whole text."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    lower = text.lower()
    upper = (_code_points(text) != _code_points(lower)).sum() if len(lower) == len(text) else sum(map(str.isupper, text))
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(upper),
        sum(map(text.count, "!?.,;:")),
    )


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def features_of(counts: np.ndarray) -> np.ndarray:
    """What the forest looks at, from rows of counts.

    Length, digits and repeated lines are left out: good texts differ in them as much
    as bad ones (licence lines, personal data), and their rare values look anomalous.
    """
    words, chars, symbols, _, repeats, upper, marks = counts.astype(float).T
    some = np.maximum(words, 1)
    rare = np.log1p(100 * symbols / some)  # magnitudes matter, not amounts
    return np.column_stack([chars / some, rare, repeats / some, upper / np.maximum(chars, 1), marks / some])


def fails(counts: np.ndarray) -> np.ndarray:
    """Rows of counts that fail without a look at the forest."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Forest:
    """Random splits of a box, grown on rows that are known to be good.

    Splits are drawn evenly over the box of all labelled rows, so that places where no
    good row is are cut off early: a short path marks an anomaly.
    """

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    scale: float
    threshold: float = np.inf

    @classmethod
    def grow(cls, good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, rows: int, depth: int, seed: int) -> Forest:
        random = np.random.default_rng(seed)
        feature, cut, child, length = [], [], [], []

        def node(inside: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), child.append((at, at)), length.append(level + usual_path(len(inside)))
            wide = np.flatnonzero(high > low)
            if level < depth and len(inside) > 1 and len(wide):
                f = random.choice(wide)
                c = random.uniform(low[f], high[f])
                left = inside[:, f] < c
                below, above = high.copy(), low.copy()
                below[f] = above[f] = c
                feature[at], cut[at] = f, c
                child[at] = (node(inside[left], low, below, level + 1), node(inside[~left], above, high, level + 1))
            return at

        roots = [node(good[random.permutation(len(good))[:rows]], low, high, 0) for _ in range(trees)]
        scale = usual_path(min(rows, len(good))) or 1.0
        return cls(np.array(feature), np.array(cut), np.array(child), np.array(length), np.array(roots), depth, scale)

    def anomaly(self, features: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length, in usual path lengths."""
        total = np.zeros(len(features))
        rows = np.arange(len(features))
        for root in self.roots:
            at = np.full(len(features), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f >= 0, self.child[at, (features[rows, f] >= self.cut[at]).astype(int)], at)
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / self.scale)


def usual_path(rows: int) -> float:
    """Mean length of an unsuccessful search in a random search tree of ``rows`` rows."""
    return 0.0 if rows < 2 else 2 * (np.log(rows - 1) + 0.5772156649) - 2 * (rows - 1) / rows


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = 2048,
    most_good_lost: float = 0.002,
    trees: int = 200,
    rows: int = 256,
    depth: int = 12,
    seed: int = 7,
) -> Forest | None:
    """A forest and its threshold from at most ``per_label`` good and as many bad rows.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); other values, NULLs and
    documents without text are left out. Only the statistics of those rows come to the
    driver, and those that fail without the forest are set aside. The threshold catches
    as many bad rows as can be while losing at most the share ``most_good_lost`` of the
    good ones. Without good rows there is no forest;
    without bad rows the threshold is the highest score of a good one.
    """
    picked = bounded_keys(labels.where(F.col("quality").isin(0, 1)), "doc_id", "quality", per_label)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())
    found = sample.select("doc_id", "quality", count_column(F.col("text")).alias("counts")).toPandas()
    found = found.sort_values(["doc_id", "quality"]).drop_duplicates(["doc_id", "quality"])
    counts = np.array(found["counts"].tolist(), np.int64).reshape(len(found), len(COUNTS) + len(OTHERS))
    judged_here = ~fails(counts) if len(counts) else np.zeros(0, bool)
    good, features = found["quality"].to_numpy()[judged_here] == 1, features_of(counts[judged_here])
    if not good.any():
        return None
    forest = Forest.grow(features[good], features.min(axis=0), features.max(axis=0), trees, rows, depth, seed)
    scores = forest.anomaly(features)
    forest.threshold = calibrated(scores[good], scores[~good], most_good_lost)
    return forest


def calibrated(good: np.ndarray, bad: np.ndarray, most_good_lost: float) -> float:
    """The score from which on documents are rejected."""
    ranked = np.sort(good)[::-1]
    floor = ranked[int(most_good_lost * len(ranked))]  # rejecting above it loses few enough good rows
    caught = bad[bad > floor]
    return float((floor + caught.min()) / 2) if len(caught) else float(np.nextafter(ranked[0], np.inf))


def count_column(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([list(statistics_of("" if t is None else t)) for t in texts])

    return counts(text)


def judged(docs: DataFrame, forest: Forest | None, text: str = "text", into: str = "quality_rules") -> DataFrame:
    """Adds the struct ``into``: the counts, ``base_failed``, ``anomaly``, ``kept``.

    A text fails without the forest if it has fewer than 50 words or if more than half
    of its words are in repeated windows of three; else the forest's threshold decides.
    NULL and empty texts have no words and fail. Rows, their order of columns and
    repeated rows stay; a column that has the name ``into`` already is replaced.
    No rows are exchanged.
    """

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        counts = np.array([statistics_of("" if t is None else t) for t in texts], np.int64).reshape(len(texts), len(COUNTS) + len(OTHERS))
        failed = fails(counts)
        anomaly = forest.anomaly(features_of(counts)) if forest else np.zeros(len(texts))
        out = pd.DataFrame(counts[:, : len(COUNTS)], columns=COUNTS)
        return out.assign(base_failed=failed, anomaly=anomaly, kept=~failed & (anomaly < forest.threshold if forest else True))

    return docs.withColumn(into, verdict(F.col(text)))
