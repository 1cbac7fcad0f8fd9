"""A Merkle manifest of a table: digests of its rows, of their groups and of the whole.

Trees are folded by time-forward processing. A node's label is its level and its place
in it; a priority queue ordered by labels delivers the digests of children when their
parent's turn comes. A reversed sweep then delivers the rest of the proof from parents
to children. A queue only ever holds one block of ``FAN ** LEVELS`` neighbours: what goes
from a block to a later one are rows of an exchange, sorted by label, one per block. So
a tree of any size takes a few rounds, and no task holds more than a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import PACKED, packed
from hearthline.operators.position import with_position
from hearthline.session import stored

FAN = 3
LEVELS = 7  # folded per round: blocks of 2187 nodes
HEX = 64  # characters of a digest
NODE = "tree long, pos long, n long, digest string"
GIVEN = "proof string, path string, subroot string, root string"


def digest_of(*values: Column) -> Column:
    """The digest of a row: each value as its length in bytes, ``:`` and itself, NULL as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def hashed(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def depth(nodes: int, most: int) -> int:
    """Levels until one node remains, ``most`` if a block is not all of its tree."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def risen(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest on top of a block, and the digests that met in each of its nodes."""
    runs: dict[tuple[int, int], list[str]] = {}
    if not levels:
        return digests[0], runs
    queue = [(1, i // FAN, i % FAN, d) for i, d in enumerate(digests)]  # sorted, so a heap
    while True:
        level, place = queue[0][:2]
        met = []
        while queue and queue[0][:2] == (level, place):
            met.append(heappop(queue)[3])
        runs[level, place] = met
        made = hashed(met)
        if level == levels:
            return made, runs
        heappush(queue, (level + 1, place // FAN, place % FAN, made))


def delivered(runs: dict[tuple[int, int], list[str]], levels: int, proof: str, path: str) -> list[tuple[str, str]]:
    """Proof and path of each node at the bottom of a block, given those of its top."""
    queue = [(-levels, 0, (proof, path))]
    found = []
    while queue:
        level, place, (proof, path) = heappop(queue)
        level, place = -level, -place
        if not level:
            found.append((proof, path))
            continue
        met = runs[level, place]
        for i in range(len(met)):
            siblings = "".join(met[:i] + met[i + 1 :])
            heappush(queue, (1 - level, -(place * FAN + i), (siblings + proof, f"{i}{len(met)}{path}")))
    return found[::-1]


def folded(digest: str, proof: str, path: str) -> str:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for i in range(0, len(path), 2):
        before, after = int(path[i]) * HEX, (int(path[i + 1]) - 1) * HEX
        digest = hashed((proof[at : at + before], digest, proof[at + before : at + after]))
        at += after
    return digest


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block after the other, from rows sorted by block."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        new = (rows["tree"].diff() != 0) | (rows["block"].diff() != 0)
        starts = new.to_numpy().nonzero()[0]
        for start, end in zip(starts[:-1], starts[1:]):
            yield rows.iloc[start:end]
        held = rows.iloc[starts[-1] :]
    if held is not None:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole blocks to each task, in the order of labels."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block(most: int) -> Column:
    return F.floor(F.col("pos") / FAN**most).cast("long").alias("block")


def rounds_of(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes each round starts from, and the root of every tree.

    ``nodes`` has ``tree``, ``pos`` (0, 1, ...), ``n`` (nodes of the tree) and ``digest``.
    """

    def rise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for rows in _blocks(batches):
            n = int(rows["n"].iloc[0])
            top, _ = risen(rows["digest"].tolist(), depth(n, most))
            made.append((rows["tree"].iloc[0], rows["block"].iloc[0], -(-n // FAN**most), top))
            if len(made) >= 10_000:
                yield pd.DataFrame(made, columns=["tree", "pos", "n", "digest"])
                made = []
        yield pd.DataFrame(made, columns=["tree", "pos", "n", "digest"])

    starts, tops = [nodes], []
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        made = stored(_dealt(starts[-1].select("tree", _block(most), "pos", "n", "digest")).mapInPandas(rise, NODE), "manifest-round")
        tops.append(made.where("n = 1"))
        largest = -(-largest // FAN**most)
        if largest <= 1:
            break
        starts.append(made.where("n > 1"))
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.union(more)
    return starts, roots.select("tree", F.col("digest").alias("subroot"))


def _down(nodes: DataFrame, given: DataFrame, most: int, kept: Sequence[str], fold: str | None) -> DataFrame:
    """Proofs of ``nodes`` from those of their blocks, with the columns ``kept``.

    ``given`` has ``tree``, ``pos`` (the block), and what :data:`GIVEN` names.
    """
    names = ["tree", "pos", *kept, *GIVEN.replace(" string", "").split(", "), "folded_root"]
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in names)

    def sink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for rows in _blocks(batches):
            top, rows = rows.iloc[0], rows.iloc[1:]
            levels = depth(int(rows["n"].iloc[0]), most)
            _, runs = risen(rows["digest"].tolist(), levels)
            proofs, paths = zip(*delivered(runs, levels, top["proof"], top["path"]))
            rows = rows.assign(proof=proofs, path=paths, subroot=top["subroot"], root=top["root"], folded_root=None)
            if fold:
                rows["folded_root"] = [folded(*each) for each in zip(rows[fold], proofs, paths)]
            out.append(rows[names])
            held += len(rows)
            if held >= 4096:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    columns = [c for c in ("n", "digest", *kept) if c in nodes.columns]
    columns = list(dict.fromkeys(columns))
    blank = [F.lit(None).cast("string").alias(c) for c in ("proof", "path", "subroot", "root")]
    below = nodes.select("tree", _block(most), "pos", *columns, *blank)
    above = given.select(
        "tree",
        F.col("pos").alias("block"),
        F.lit(-1).cast("long").alias("pos"),
        *[F.lit(None).cast(types[c]).alias(c) for c in columns],
        "proof",
        "path",
        "subroot",
        "root",
    )
    return _dealt(below.union(above)).mapInPandas(sink, schema)


def proven(
    nodes: DataFrame, starts: list[DataFrame], given: DataFrame, most: int, kept: Sequence[str] = (), fold: str | None = None
) -> DataFrame:
    """Proofs of all leaves, round by round from the top.

    ``given`` has one row per tree: its :data:`GIVEN` above the tree's own root.
    """
    below = None
    for i in range(len(starts) - 1, -1, -1):
        last = starts[i].where(F.col("n") <= FAN**most).select("tree").distinct()
        ends = given.join(last, "tree", "left_semi").withColumn("pos", F.lit(0).cast("long"))
        tops = ends if below is None else ends.unionByName(below.select(ends.columns))
        first = not i
        below = _down(nodes if first else starts[i], tops, most, kept if first else (), fold if first else None)
        if not first:
            below = stored(below, "manifest-proofs")
    return below


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    key: str = "doc_id",
    group: str = "source",
    claimed: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """Per row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof``, ``path``, ``folded_root``, ``verified``.

    A leaf is the digest of ``columns``. The leaves of one ``group`` ascend by ``key`` (NULL
    first, rows of one key by their leaf) and are folded by threes, level by level, until
    one is left, the group's ``subroot``; subroots in the order of groups (NULL first, by
    bytes) are folded to ``root`` likewise. The last run of a level may be shorter, also a
    single node; a lone leaf is the subroot itself. ``proof`` has the digests of the run's
    other nodes on each level up to the root, from left to right, and ``path`` two digits
    per level: the node's place in its run and the run's length. ``claimed`` is another
    digest to be checked against the proof (by default the leaf): ``folded_root`` is what
    it leads to, and ``verified`` whether that is the root. ``levels`` are folded per round,
    in blocks of ``FAN ** levels`` nodes.

    Texts are hashed where they are read; only digests are exchanged. Repeated rows are
    leaves of their own. An empty table gives no rows. Only the named columns are read.
    """
    named = [F.col(c) for c in columns]
    leaf = digest_of(*named)
    rows = docs.select(
        F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed")
    )
    placed = with_position(rows, ["key", "digest"], ["group"], name="pos")
    sizes = packed(placed, ["group"]).groupBy(PACKED).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(sizes.select(F.col(f"{PACKED}.group").alias("group"), "n"), "manifest-groups")
    trees = with_position(groups, ["group"], name="tree")
    trees = packed(trees, ["group"]).select(PACKED, "tree", "n")
    leaves = packed(placed, ["group"]).join(trees, PACKED).select("tree", "pos", "n", "digest", "key", "claimed")
    leaves = stored(leaves, "manifest-leaves")

    starts, subroots = rounds_of(leaves, levels)
    subroots = stored(subroots, "manifest-subroots")
    count = subroots.agg(F.count(F.lit(1)).alias("n"))
    whole = subroots.crossJoin(F.broadcast(count)).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "n", F.col("subroot").alias("digest")
    )
    whole_starts, root = rounds_of(whole, levels)
    nothing = F.lit("")
    top = root.select("tree", nothing.alias("proof"), nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("subroot").alias("root"))
    above = stored(proven(whole, whole_starts, top, levels).select("pos", "proof", "path", "root"), "manifest-above")
    given = above.withColumnRenamed("pos", "tree").join(subroots, "tree").select("tree", "proof", "path", "subroot", "root")
    found = proven(leaves, starts, given, levels, ["key", "digest", "claimed"], "claimed")
    return found.select(
        F.col("key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "proof",
        "path",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
