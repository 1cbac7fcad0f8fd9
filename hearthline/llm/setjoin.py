"""Documents whose word-run sets overlap: a Jaccard join by adaptive multi-match prefixes.

All sets are sorted in one order of tokens, rare ones first. Of two sets that overlap
enough, the first ``size - needed + reach`` tokens of either share at least ``reach``
tokens, whatever ``reach`` is. Each document takes the reach whose estimated cost is
least: a longer prefix brings more lookups, but a pair must then share more of it before
its sets are compared. A pair must share as many tokens as the smaller of its two reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.components import components
from hearthline.llm.shingles import bit_words, mixed, odd_bits, runs, signed, word_hashes
from hearthline.llm.sizes import sent_if_small
from hearthline.session import stored

WIDTH = 3
PERCENT = 90
BITS = 22  # bins of the frequency table: 4 MB as sent to tasks, whatever the corpus
BLOCK = 1 << 16
REACHES = np.arange(1, 9)
VERIFYING = 20.0  # a comparison of two sets costs as much as so many lookups
FEW = 8  # documents per token up to which pairs are rows
PACK = 1 << 16  # tokens per pack of documents of one token, about


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``WIDTH`` words, of all words if fewer."""
    with np.errstate(over="ignore"):
        return np.unique(runs(word_hashes(text, ascii_only=True), WIDTH))


def bins(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(tokens) >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """How many documents have a token of each bin, on a scale of eighths of a doubling.

    Every task counts into one table of ``2 ** BITS`` bins and sends it in blocks, which
    are added up per block. The table's size is fixed, and it only orders tokens: no
    result depends on how well it separates them.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for start in range(0, len(batch), 512):
                found = [bins(shingles(t)) for t in batch["text"].iloc[start : start + 512]]
                np.add.at(table, np.concatenate(found), 1)
        packing = zstandard.ZstdCompressor(level=1)
        for i in range(0, 1 << BITS, BLOCK):
            if (part := table[i : i + BLOCK]).any():
                yield pd.DataFrame({"block": [i // BLOCK], "counts": [packing.compress(part.tobytes())]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        unpacking, packing = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, packed in zip(batch["block"], batch["counts"]):
                part = np.frombuffer(unpacking.decompress(packed), np.uint32).astype(np.uint64)
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            scale = np.floor(8 * np.log2(total + 1.0)).clip(0, 255).astype(np.uint8)
            yield pd.DataFrame({"block": [block], "counts": [packing.compress(scale.tobytes())]})

    schema = "block int, counts binary"
    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, schema).repartition("block").mapInPandas(add, schema)
    table = np.zeros(1 << BITS, np.uint8)
    for block, packed in counted.collect():  # at most 2 ** BITS bytes
        table[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(packed)), np.uint8)
    return table


def coded(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tokens as numbers that sort rare ones first: the bin's scale, then the hash."""
    return np.sort((table[bins(tokens)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8)))


def needed(sizes: np.ndarray | int, others: np.ndarray | int = 0) -> np.ndarray | int:
    """The least common tokens of sets of two sizes; without the other, of any partner."""
    if isinstance(others, int) and not others:
        return (PERCENT * sizes + 99) // 100
    return (PERCENT * (sizes + others) + 99 + PERCENT) // (100 + PERCENT)


def reach_of(codes: np.ndarray) -> int:
    """The reach of least estimated cost for a sorted set."""
    least = int(needed(len(codes)))
    reaches = REACHES[REACHES <= least]
    ends = len(codes) - least + reaches
    others = np.cumsum(np.maximum(np.exp2((codes[: ends[-1]] >> np.uint64(56)) / 8.0) - 2, 0.0))[ends - 1]
    return int(reaches[np.argmin(others + VERIFYING * others / reaches)])


def prefixes(docs: DataFrame, table: np.ndarray, text: str, key: str) -> DataFrame:
    """Per row: key, a 128-bit digest of its set, its size, reach, prefix and odd bits."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                found = []
                for name, value in batch.iloc[start : start + 1024].itertuples(index=False):
                    tokens = shingles(value)
                    digest = xxhash.xxh3_128_digest(tokens.tobytes())
                    if len(tokens):
                        codes = coded(tokens, sent.value)
                        reach = reach_of(codes)
                        prefix = signed(codes[: len(codes) - int(needed(len(codes))) + reach])
                    else:
                        reach, prefix = 0, []
                    found.append((name, digest, len(tokens), reach, prefix, odd_bits(tokens)))
                yield pd.DataFrame(found, columns=["key", "digest", "n", "reach", "prefix", "odd"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
    return rows.mapInPandas(run, f"key {kind}, digest binary, n long, reach int, prefix array<long>, odd binary")


def pairs_of_few(tokens: DataFrame) -> DataFrame:
    """Pairs of documents by the tokens that few have, counted over tokens.

    Beside the count, the places in both prefixes bound the overlap: what stands before
    the last common token and is not common is in one set only.
    """
    member = F.struct("id", "n", "reach", "place")
    met = tokens.where(F.col("size") <= FEW).groupBy("token").agg(F.array_sort(F.collect_list(member)).alias("m"))
    both = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(FEW)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pair = met.select(F.explode(both).alias("p")).select("p.x", "p.y")
    pair = pair.where(F.greatest("x.n", "y.n") * PERCENT <= F.least("x.n", "y.n") * 100)
    counted = pair.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"),
        F.max(F.col("x.place") + F.col("y.place")).alias("places"),
        F.max(F.least("x.reach", "y.reach")).alias("reach"),
        F.max(F.col("x.n") + F.col("y.n")).alias("sizes"),
    )
    apart = F.col("places") + 2 - 2 * F.col("shared")
    least = F.ceil(PERCENT * F.col("sizes") / (100 + PERCENT) - 1e-9)
    return counted.where((F.col("shared") >= F.col("reach")) & (apart <= F.col("sizes") - 2 * least)).select("a", "b")


def pairs_with_leads(tokens: DataFrame) -> DataFrame:
    """Each document with the lead of every token that many have: the one with most such tokens."""
    many = tokens.where(F.col("size") > FEW).select("token", "id")
    known = many.groupBy("id").agg(F.count(F.lit(1)).alias("known"))
    leads = many.join(known, "id").groupBy("token").agg(F.max(F.struct("known", "id")).alias("lead"))
    met = many.join(leads, "token").select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
    return met.where("a != b").distinct()


def _bounded(a_last, b_last, shared, a_n, a_len, b_n, b_len):
    """The greatest overlap that sets with these prefixes can have.

    The set whose prefix ends first has all its common prefix tokens in the other's.
    """
    return shared + np.where(a_last <= b_last, a_n - a_len, b_n - b_len)


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose prefixes and odd bits allow the overlap and share enough tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            differ = np.bitwise_count(bit_words(batch["xo"]) ^ bit_words(batch["yo"])).sum(axis=1)
            batch = batch[differ <= batch["xn"] + batch["yn"] - 2 * needed(batch["xn"], batch["yn"])]
            for row in batch.itertuples(index=False):
                x, y = (np.asarray(p, np.int64).view(np.uint64) for p in (row.x, row.y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                most = _bounded(x[-1], y[-1], shared, row.xn, len(x), row.yn, len(y))
                if shared >= min(row.xr, row.yr) and most >= needed(row.xn, row.yn):
                    kept.append((row.a, row.b))
            yield pd.DataFrame(kept, columns=["a", "b"])

    sides = []
    for name, side in (("a", "x"), ("b", "y")):
        sides.append(sets.select(F.col("id").alias(name), F.col("prefix").alias(side), F.col("n").alias(side + "n"), F.col("reach").alias(side + "r"), F.col("odd").alias(side + "o")))
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    both = both.where(F.greatest("xn", "yn") * PERCENT <= F.least("xn", "yn") * 100)
    return both.mapInPandas(run, "a long, b long")


def pairs_of_many(tokens: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different classes among the documents of tokens that many have.

    Members outside of a token's largest class meet all others, pack against pack, each
    pair of packs in a task of its own. A task looks at prefixes and odd bits, and only
    pairs that can overlap enough come out of it.
    """
    many = tokens.where(F.col("size") > FEW).select("token", "id")
    named = many.join(classes.select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left")
    named = named.withColumn("class", F.coalesce("class", "id"))
    lengths = sets.select("id", F.size("prefix").cast("long").alias("length"))
    weighed = named.join(lengths, "id")
    counted = weighed.groupBy("token", "class").agg(F.sum("length").alias("length"))
    main = counted.groupBy("token").agg(
        F.max(F.struct("length", "class")).alias("main"), F.sum("length").alias("all"), F.count(F.lit(1)).alias("classes")
    )
    main = main.where("classes > 1").select("token", "main", "all")
    dealt = named.join(main, "token").withColumn("minor", F.col("class") != F.col("main.class"))
    place = F.xxhash64("id")
    dealt = dealt.select(
        "token",
        "id",
        "class",
        "minor",
        F.pmod(place, F.ceil(F.col("all") / PACK)).cast("int").alias("right"),
        F.pmod(place, F.ceil((F.col("all") - F.col("main.length")) / PACK + 1e-9)).cast("int").alias("left"),
    )
    filled = dealt.join(sets.select("id", "n", "reach", "prefix", "odd"), "id")
    held = F.collect_list(F.struct("id", "class", "n", "reach", "prefix", "odd"))
    rights = stored(filled.groupBy("token", "right").agg(held.alias("ys")), "join-packs")
    lefts = stored(filled.where("minor").groupBy("token", "left").agg(held.alias("xs")), "join-packs")
    meets = lefts.select("token", "left").join(rights.select("token", "right"), "token")
    both = meets.join(lefts, ["token", "left"]).join(rights, ["token", "right"]).select("xs", "ys")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for xs, ys in zip(batch["xs"], batch["ys"]):
                found.update(_crossing(xs, ys))
            yield pd.DataFrame(sorted(found), columns=["a", "b"])

    return both.mapInPandas(run, "a long, b long").distinct()


def _cells(prefixes: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member and place in ``common`` of each prefix token that is common."""
    members = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
    tokens = np.concatenate(prefixes)
    found = np.isin(tokens, common)
    return members[found], np.searchsorted(common, tokens[found])


def _marks(cells: tuple[np.ndarray, np.ndarray], rows: range, low: int, width: int = 1024) -> np.ndarray:
    members, places = cells
    inside = (members >= rows.start) & (members < rows.stop) & (places >= low) & (places < low + width)
    marks = np.zeros((len(rows), width), np.float32)
    marks[members[inside] - rows.start, places[inside] - low] = 1
    return marks


def _crossing(xs, ys) -> Iterator[tuple[int, int]]:
    """Pairs of two packs that are of different classes and may overlap enough."""
    sides = []
    for members in (xs, ys):
        prefix = [np.asarray(m["prefix"], np.int64).view(np.uint64) for m in members]
        columns = {c: np.array([m[c] for m in members], np.int64) for c in ("id", "class", "n", "reach")}
        columns |= {"last": np.array([p[-1] for p in prefix], np.uint64), "len": np.array([len(p) for p in prefix])}
        sides.append((prefix, columns))
    (left, x), (right, y) = sides
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    cells = [_cells(side, common) for side in (left, right)]
    odd = [bit_words(m["odd"] for m in members) for members in (xs, ys)]
    step = max(1, 4_000_000 // len(right))
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        shared = np.zeros((len(left[part]), len(right)), np.int64)
        for low in range(0, len(common), 1024):
            own, marks = (_marks(c, rows, low) for c, rows in zip(cells, (range(start, start + len(shared)), range(len(right)))))
            shared += np.rint(own @ marks.T).astype(np.int64)
        a, b = ({c: (v[part, None] if i == 0 else v[None, :]) for c, v in side.items()} for i, side in enumerate((x, y)))
        fits = (a["class"] != b["class"]) & (shared >= np.minimum(a["reach"], b["reach"]))
        fits &= _bounded(a["last"], b["last"], shared, a["n"], a["len"], b["n"], b["len"]) >= needed(a["n"], b["n"])
        fits &= np.maximum(a["n"], b["n"]) * PERCENT <= np.minimum(a["n"], b["n"]) * 100
        places = np.argwhere(fits) + [start, 0]
        for low in range(0, len(places), 4096):
            i, j = places[low : low + 4096].T
            differ = np.bitwise_count(odd[0][i] ^ odd[1][j]).sum(axis=1)
            near = differ <= x["n"][i] + y["n"][j] - 2 * needed(x["n"][i], y["n"][j])
            for first, second in zip(x["id"][i[near]].tolist(), y["id"][j[near]].tolist()):
                yield min(first, second), max(first, second)


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs whose whole sets overlap enough. Only the texts of these pairs are read again."""
    pairs = stored(pairs, "join-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    places = sent_if_small(stored(sets.join(wanted, "id", "left_semi").select("id", "key", "digest"), "join-wanted"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(places, "key")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, digest, value in batch.itertuples(index=False):
                tokens = shingles(value)
                if xxhash.xxh3_128_digest(tokens.tobytes()) == bytes(digest):
                    found.append((name, signed(tokens)))
            yield pd.DataFrame(found, columns=["id", "tokens"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for a, b, x, y in batch.itertuples(index=False):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"])

    whole = stored(texts.select("id", "digest", "text").mapInPandas(fill, "id long, tokens array<long>"), "join-sets")
    whole = whole.dropDuplicates(["id"])
    first, second = (whole.select(F.col("id").alias(n), F.col("tokens").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return stored(both.mapInPandas(run, "a long, b long"), "join-links")


def linked_sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per key: ``key``, ``n_shingles``, ``component_id``.

    A document's set are the distinct runs of three words of its whole text, ``A-Z`` taken
    as small letters; with fewer words all of them are the only run. Two documents are
    linked if their sets overlap (Jaccard) by 90 % or more; ``component_id`` is the least
    key that links lead to, the document's own included. Documents without words have an
    empty set and no links. Equal sets are one before anything is joined. Documents of a
    token are not listed as pairs: tokens that many have link them with one lead first,
    and only what is still apart is compared. No token and no number of partners has a cap.

    One row per key; rows with a NULL key are left out. A key with several texts has the
    links of all of them and the size of its largest set. Equality of words and runs is
    that of 64-bit hashes, of sets that of 128-bit ones. Only the two named columns are read.
    """
    members = stored(prefixes(docs, frequencies(docs, text), text, key), "join-members")
    filled = members.where("n > 0")
    one = filled.groupBy("digest").agg(*[F.min_by(c, "key").alias(c) for c in ("n", "reach", "prefix", "odd")], F.min("key").alias("key"))
    sets = stored(one.withColumn("id", F.monotonically_increasing_id()), "join-distinct")

    tokens = sets.select("id", "n", "reach", F.posexplode("prefix").alias("place", "token"))
    sizes = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    tokens = stored(tokens.join(sizes, "token"), "join-tokens")
    near = verified(possible(pairs_with_leads(tokens), sets), sets, docs, text, key)
    classes = components(near)
    few = pairs_of_few(tokens)
    apart = few
    for side in ("a", "b"):
        named = classes.select(F.col("node").alias(side), F.col("component").alias(f"class_{side}"))
        apart = apart.join(named, side, "left")
    apart = apart.where("class_a IS NULL OR class_b IS NULL OR class_a != class_b").select("a", "b")
    rest = apart.union(pairs_of_many(tokens, sets, classes)).distinct()
    near = near.union(verified(rest, sets, docs, text, key))

    places = sent_if_small(stored(sets.select("digest", "id"), "join-places"))
    owned = filled.select("key", "digest", "n").join(places, "digest").select("key", "n", "id")
    owned = stored(owned, "join-owned")
    # A key with several texts links their sets.
    several = owned.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a != last").select("key", "a")
    several = owned.join(several, "key").where("a != id").select("a", F.col("id").alias("b"))
    linked = components(near.union(several))
    labels = sets.select("id", "key").join(linked.select(F.col("node").alias("id"), "component"), "id", "left")
    labels = labels.withColumn("component", F.coalesce("component", "id"))
    least = labels.groupBy("component").agg(F.min("key").alias("least"))
    labels = sent_if_small(stored(labels.join(least, "component").select("id", "least"), "join-labels"))
    found = owned.join(labels, "id").select("key", "n", "least")
    without = members.where("n = 0").select("key", "n", F.col("key").alias("least"))
    result = found.unionByName(without).groupBy("key").agg(F.max("n").alias("n"), F.min("least").alias("least"))
    return result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
