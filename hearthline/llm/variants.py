"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Dense prefix-suffix tiling. Words are rows of padded code-point matrices, aligned left and
right. Comparing a block of words with another gives, for all their pairs at once, the
length of the common prefix and of the common suffix; two different words are a single
edit apart if both together reach the longer length minus one.

Words are dealt so that only blocks that can hold such a pair meet: of two words whose
longer one has ``m`` code points, either the first ``m - m // 2`` or the last ``m // 2`` are
equal. Large groups are cut into blocks of a bounded number of code points, and each pair
of blocks is a row of its own, which any task can take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.session import stored

BLOCK = 1 << 14  # code points per block, about
CELLS = 1 << 20  # pairs of a tile that are compared at once
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def padded(words: list[str], width: int, right: bool = False) -> np.ndarray:
    """One row of code points per word, filled up with zeros on the other side."""
    joined = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def common(left: np.ndarray, right: np.ndarray, columns: range) -> np.ndarray:
    """How many code points in a row each pair of words shares along ``columns``."""
    same = np.ones((len(left), len(right)), bool)
    length = np.zeros(same.shape, np.int32)
    for c in columns:
        same &= left[:, c, None] == right[None, :, c]
        length += same
    return length


def near_pairs(left: list[str], right: list[str], m: int, by_suffix: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words, the left ones being ``m`` long, the right ones ``m`` or one less.

    Pairs that share ``m - m // 2`` code points in front are left to the group of
    prefixes if this is a group of suffixes.
    """
    rights = padded(right, m), padded(right, m, True)
    shorter = np.array([len(w) for w in right])
    step = max(1, CELLS // max(len(right), 1))
    for start in range(0, len(left), step):
        words = padded(left[start : start + step], m)
        prefix = np.minimum(common(words, rights[0], range(m)), shorter)
        suffix = np.minimum(common(words, rights[1], range(m - 1, -1, -1)), shorter)
        near = (prefix + suffix >= m - 1) & (prefix < m)
        if by_suffix:
            near &= prefix < m - m // 2
        a, b = np.nonzero(near)
        yield a + start, b


def occurrences(docs: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """``word`` and ``n``: runs of letters, with one letter gone where the checksum says so."""
    found = docs.select(
        F.col(key).cast("string").alias("k"), F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run")
    )
    lowered = found.select("k", F.translate("run", CAPITALS, SMALL).alias("run"))
    checksum = F.crc32(F.concat(F.coalesce("k", F.lit("")), F.lit(":"), "run"))
    at = (checksum % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = lowered.select(F.when(checksum % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.length("word") >= least)


def dealt(words: DataFrame) -> DataFrame:
    """Each word in its four groups: as the longer and the shorter word, by both ends."""
    size = F.length("word")
    sides = []
    for m, longer in ((size, True), (size + 1, False)):
        back = F.floor(m / 2).cast("int")
        for by_suffix, end in ((False, F.left("word", m - back)), (True, F.right("word", back))):
            sides.append(F.struct(m.alias("m"), F.lit(by_suffix).alias("by_suffix"), end.alias("end"), F.lit(longer).alias("longer")))
    return words.select("word", "n", F.explode(F.array(*sides)).alias("s")).select("s.*", "word", "n")


def tiles(groups: DataFrame) -> DataFrame:
    """Pairs of blocks of one group: a block of longer words with one of all words."""
    by = ["m", "by_suffix", "end"]
    sizes = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("all"), F.count_if("longer").alias("long"))
    sizes = stored(sizes.where("long > 0 AND all > 1"), "variant-groups")

    def blocks(count: str) -> Column:
        return F.ceil(F.col(count) * F.col("m") / BLOCK).cast("int")

    named = groups.join(sizes, by)
    place = F.xxhash64("word")
    held = F.array_sort(F.collect_list(F.struct("word", "n")))
    right = named.groupBy(*by, F.pmod(place, blocks("all")).cast("int").alias("right")).agg(held.alias("rights"))
    left = named.where("longer").groupBy(*by, F.pmod(place, blocks("long")).cast("int").alias("left")).agg(held.alias("lefts"))
    right, left = stored(right, "variant-blocks"), stored(left, "variant-blocks")
    meets = left.select(*by, "left").join(right.select(*by, "right"), by)
    return meets.join(left, [*by, "left"]).join(right, [*by, "right"]).select("m", "by_suffix", "lefts", "rights")


def near_counts(pairs_of_blocks: DataFrame) -> DataFrame:
    """Per word: the number of near words, and the commonest of them, the smallest of equal ones.

    What a tile finds is added up per word before it is exchanged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list] = {}
            for m, by_suffix, lefts, rights in batch.itertuples(index=False):
                left, right = [w["word"] for w in lefts], [w["word"] for w in rights]
                for first, second in near_pairs(left, right, m, by_suffix):
                    for i, j in zip(first.tolist(), second.tolist()):
                        # Two words of one length meet twice, once from either side.
                        ways = ((lefts[i], rights[j]),) if len(right[j]) == m else ((lefts[i], rights[j]), (rights[j], lefts[i]))
                        for word, other in ways:
                            best = (-other["n"], other["word"])
                            if (known := seen.get(word["word"])) is None:
                                seen[word["word"]] = [1, best]
                            else:
                                known[0] += 1
                                known[1] = min(known[1], best)
            yield pd.DataFrame([(w, c, -b[0], b[1]) for w, (c, b) in seen.items()], columns=["word", "n_near", "form_n", "form"])

    found = pairs_of_blocks.mapInPandas(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words with a form: the end of the chain of forms.

    Each round follows every chain twice as far. A form is ten times as common as its
    word, so chains are as short as the logarithm of the largest count.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        after = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ways.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stored(moved, "variant-roots")
        ways = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 7, least_n: int = 2, times: int = 10) -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are the longest runs of Latin letters (``A-Z``, ``a-z``, U+00C0 to U+00FF), with
    ``A-Z`` as small letters, of at least ``least_length`` code points and ``least_n``
    occurrences. Where 31 divides the CRC-32 of ``<key>:<run>``, the run loses the code point
    at that number modulo its length first, a stand-in for misspelling. ``n_near`` counts
    the words that differ by one inserted, deleted or replaced code point. ``form`` is the
    commonest of them (of several the smallest) if it occurs at least ``times`` as often,
    else NULL; ``root`` is where following forms ends, the word itself without a form.

    A NULL key counts as empty, NULL and empty texts have no words, repeated rows count
    each. No words, no rows. Only the two named columns are read.
    """
    words = stored(occurrences(docs, text, key, least_length).where(F.col("n") >= least_n), "variant-words")
    near = near_counts(tiles(dealt(words)))
    accepted = F.col("form_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("form")).alias("form"),
        F.when(accepted, F.col("form_n")).alias("form_n"),
    )
    named = stored(named, "variant-forms")
    roots = rooted(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
