"""Near-duplicate documents by order-sensitive minimum hashes.

A sketch takes, for each of several hash functions, the few least occurrence-labelled
word runs of a text in the order in which they stand there. Texts whose sketches agree
in a band are compared: the overlap of their word runs and a banded alignment decide.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.alignment import similarity
from hearthline.llm.components import components
from hearthline.llm.shingles import bit_words, mixed, occurrences, odd_bits, runs, signed, word_hashes
from hearthline.llm.sizes import sent_if_small
from hearthline.session import materialize

WIDTH = 5
LEAST = 0.8
BANDS = 16
ROWS = 2  # sketches per band
TAKEN = 2  # runs per sketch, in text order
PACK = 512  # members compared at once


def sketch(labels: np.ndarray, bands: int = BANDS, rows: int = ROWS, taken: int = TAKEN) -> np.ndarray:
    """One value per band, from the labelled runs of a text in their order."""
    random = np.random.default_rng(11)
    factors = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    taken = min(taken, len(labels))
    at_once = max(1, 1_000_000 // len(labels))
    places = []
    for part in (factors[i : i + at_once] for i in range(0, len(factors), at_once)):
        hashed = part[:, None] * labels
        least = np.empty((len(part), taken), np.int64)
        for t in range(taken):
            least[:, t] = hashed.argmin(axis=1)
            hashed[np.arange(len(part)), least[:, t]] = np.iinfo(np.uint64).max
        places.append(np.sort(least, axis=1))
    values = np.arange(1, len(factors) + 1, dtype=np.uint64)
    for runs_in_order in labels[np.concatenate(places)].T:
        values = mixed(values * np.uint64(31) + runs_in_order)
    total = np.arange(bands, dtype=np.uint64)
    for row in values.reshape(bands, rows).T:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + row)
    return total


def sketches(docs: DataFrame, text: str, key: str, bands: int, rows: int, taken: int) -> DataFrame:
    """Per document: a 128-bit hash of its words, its bands (none without words), and the
    number and odd bits of its distinct runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = []
                for doc, value in zip(batch["node"], batch["text"], strict=True):
                    words = word_hashes(value)
                    whole = xxhash.xxh3_128_intdigest(words.tobytes())
                    grams = runs(words, WIDTH)
                    labels = mixed(grams + occurrences(grams).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
                    made = signed(sketch(labels, bands, rows, taken)) if len(labels) else []
                    distinct = np.unique(grams)
                    digest = signed(np.array([whole >> 64, whole & (1 << 64) - 1], np.uint64))
                    found.append((doc, *digest, made, len(distinct), odd_bits(distinct)))
                yield pd.DataFrame(found, columns=["node", "high", "low", "bands", "n", "odd"])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).where("node IS NOT NULL")
    return got.mapInPandas(run, f"node {kind}, high long, low long, bands array<long>, n long, odd binary")


class Seen:
    """The words and sorted distinct runs of texts looked at last."""

    def __init__(self, places: int = 32) -> None:
        self.places = places
        self.kept: OrderedDict = OrderedDict()

    def __call__(self, node, text: str) -> tuple[np.ndarray, np.ndarray]:
        if (node, text) not in self.kept:  # a key can have several texts
            words = word_hashes(text)
            self.kept[node, text] = words, np.unique(runs(words, WIDTH))
            if len(self.kept) > self.places:
                self.kept.popitem(last=False)
        self.kept.move_to_end((node, text))
        return self.kept[node, text]


def compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are near: overlap of runs and alignment at least ``least``.

    A text of many pairs travels along with each of them, so pairs of one text can be
    split over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        with np.errstate(over="ignore"):
            for batch in batches:
                kept = []
                for a, b, first, second in zip(batch["a"], batch["b"], batch["first"], batch["second"], strict=True):
                    (words, grams), (others, other_grams) = seen(a, first), seen(b, second)
                    shared = len(np.intersect1d(grams, other_grams, assume_unique=True))
                    overlap = shared / max(len(grams) + len(other_grams) - shared, 1)
                    if overlap >= least and (alike := similarity(words, others, least)) is not None:
                        kept.append((a, b, overlap, alike))
                yield pd.DataFrame(kept, columns=["a", "b", "overlap", "alignment"])

    kind = texts.schema["node"].dataType.simpleString()
    first, second = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "first"), ("b", "second")))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "first", "second")
    return both.mapInPandas(run, f"a {kind}, b {kind}, overlap double, alignment double")


def distinct_pairs(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()


def lead_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each member with the lead of its bucket.

    The lead is the member that shares the most places with others, which stands in the
    middle of a group of copies, so that most of them are near it.
    """
    known = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("known"))
    ranked = members.join(known, "node")
    leads = ranked.groupBy("bucket").agg(F.max(F.struct("known", "node")).alias("lead")).select("bucket", F.col("lead.node").alias("lead"))
    return distinct_pairs(members.join(materialize(leads), "bucket"), "node", "lead")


def undecided(members: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that leads have left in several classes, dealt into packs.

    ``minor`` members are outside of their bucket's largest class. Packs hold about
    ``PACK`` members, those of ``minor`` members for themselves.
    """
    named = members.join(sizes.where("size > 2"), "bucket").join(classes.withColumnRenamed("component", "class"), "node", "left")
    named = named.withColumn("class", F.coalesce("class", "node"))
    counted = named.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "class")).alias("largest")
    main = counted.groupBy("bucket").agg(largest, F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("bucket", F.col("largest.class").alias("main"), "all", (F.col("all") - F.col("largest.n")).alias("others"))

    def pack(count: str):
        return F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / PACK)).cast("int")

    minor = (F.col("class") != F.col("main")).alias("minor")
    return named.join(main, "bucket").select(
        "bucket", "node", "class", minor, pack("all").alias("pack"), pack("others").alias("minor_pack")
    )


def pairs_between(packs: DataFrame, single: DataFrame, least: float) -> DataFrame:
    """Pairs of minor members with the others of their buckets, pack against pack.

    Packs hold a size and odd bits per member, not its words. All pairs of two packs are
    bounded inside a task, and only those of different classes that can overlap enough
    come out of it. Pairs of packs are dealt over all tasks, so a large bucket is as many
    small tasks.
    """
    kind = single.schema["node"].dataType.simpleString()
    filled = packs.join(single.select("node", "n", "odd"), "node")
    held = F.collect_list(F.struct("node", "class", "n", "odd"))
    all_of = materialize(filled.groupBy("bucket", "pack").agg(held.alias("right")))
    minor = materialize(filled.where("minor").groupBy("bucket", "minor_pack").agg(held.alias("left")))
    meets = minor.select("bucket", "minor_pack").join(all_of.select("bucket", "pack"), "bucket")
    both = meets.join(minor, ["bucket", "minor_pack"]).join(all_of, ["bucket", "pack"]).select("left", "right")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {pair for left, right in zip(batch["left"], batch["right"], strict=True) for pair in _pairs(left, right, least)}
            yield pd.DataFrame(list(found), columns=["a", "b"])

    return distinct_pairs(both.mapInPandas(run, f"a {kind}, b {kind}"), "a", "b")


def _pairs(left, right, least: float) -> Iterator[tuple]:
    """Pairs of two lists of members that are of different classes and may be near."""
    classes = {c: i for i, c in enumerate({m["class"] for m in (*left, *right)})}
    sides = []
    for members in (left, right):
        sides.append((np.array([classes[m["class"]] for m in members]), np.array([m["n"] for m in members]), bit_words(m["odd"] for m in members)))
    (class_a, n_a, odd_a), (class_b, n_b, odd_b) = sides
    for i in range(len(left)):
        fits = np.flatnonzero((class_b != class_a[i]) & (np.minimum(n_b, n_a[i]) >= least * np.maximum(n_b, n_a[i]) - 1e-9))
        differ = np.bitwise_count(odd_b[fits] ^ odd_a[i]).sum(axis=1)
        for j in fits[differ <= (1 - least) / (1 + least) * (n_b[fits] + n_a[i]) + 1e-9]:
            yield left[i]["node"], right[j]["node"]


def near_classes(
    docs: DataFrame,
    least: float = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
    taken: int = TAKEN,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``key`` and ``class_id``, the least key of the document's near-duplicate class.

    Two documents are linked if their runs of five lower-case words overlap (Jaccard)
    by ``least`` or more and a banded alignment of their words finds a similarity of
    ``least`` or more; classes are what links connect. Texts with the same words are one
    before anything else is done, however many they are; shorter texts than five words
    are linked only so. Pairs to compare come from equal bands of sketches; with the
    defaults a pair at an overlap of 0.8 is missed about twice in ten thousand times.
    Members of a bucket are compared with one lead first; where this leaves several
    classes, members outside of the largest are compared with all others, in packs
    (see :func:`pairs_between`). No bucket or number of partners has a cap.

    One row per distinct key. NULL keys are left out; NULL texts and texts without words
    are a class of their own each; a key with several texts counts as one document with
    all of them. Only the two named columns are read.
    """
    with_words = materialize(sketches(docs, text, key, bands, rows, taken))
    worded = with_words.where(F.size("bands") > 0)
    picked = [F.min_by(c, "node").alias(c) for c in ("bands", "n", "odd")]
    single = materialize(worded.groupBy("high", "low").agg(F.min("node").alias("node"), *picked))
    buckets = single.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = materialize(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket"))
    members = materialize(buckets.join(shared, "bucket", "left_semi"))
    sizes = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")))

    wanted = sent_if_small(materialize(members.select("node").distinct()))
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).where("text IS NOT NULL")
    texts = materialize(texts.join(wanted, "node", "left_semi").dropDuplicates(["node", "text"]))
    near = materialize(compared(lead_pairs(members, sizes), texts, least))
    packs = materialize(undecided(members, sizes, components(near)))
    near = near.union(materialize(compared(pairs_between(packs, single, least), texts, least)))
    first = sent_if_small(materialize(single.select("high", "low", F.col("node").alias("head"))))
    same = worded.select("node", "high", "low").join(first, ["high", "low"]).where("node != head")
    # A key with several texts joins their classes.
    repeated = worded.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    heads = same.select(F.col("node").alias("a"), F.col("head").alias("b"))
    several = heads.join(repeated.withColumnRenamed("node", "a"), "a", "left_semi")
    linked = components(near.select("a", "b").union(several))
    plain = with_words.select("node").distinct()
    by_head = heads.groupBy("a").agg(F.min("b").alias("head"))
    named = plain.join(by_head.withColumnRenamed("a", "node"), "node", "left").withColumn("head", F.coalesce("head", "node"))
    classes = named.join(linked.withColumnRenamed("node", "head"), "head", "left")
    return classes.select(F.col("node").alias(key), F.coalesce("component", "head").alias("class_id"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents whose key is the least of their class; rows with a NULL key stay.

    Repeated rows of a kept key become one row.
    """
    classes = near_classes(docs, key=key, **options)
    gone = materialize(classes.where(F.col(key) != F.col("class_id")).select(key))
    kept = docs.join(sent_if_small(gone), key, "left_anti")
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    repeated = materialize(repeated)
    if not repeated.isEmpty():
        again = kept.join(repeated, key, "left_semi").dropDuplicates([key])
        kept = kept.join(repeated, key, "left_anti").unionByName(again)
    return kept.select(docs.columns)
