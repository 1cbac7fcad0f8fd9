"""Packing token sequences by bounded-space online best fit."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.vocabulary import Memo, words_of

SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """A fixed number of open bins; a bitset says which free spaces occur.

    An item goes to the open bin with the least free space that holds it: the lowest
    set bit from the item's length on. If none holds it and all places are taken, the
    fullest bin is closed first.
    """

    def __init__(self, capacity: int, places: int) -> None:
        self.capacity, self.places = capacity, places
        self.spaces = 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        taken = bins.pop()
        if not bins:
            self.spaces ^= 1 << space
        self.open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """The number of the bin and the place in it where an item goes."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.places:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.spaces |= 1 << left
            self.open += 1
        return number, self.capacity - space


@lru_cache(maxsize=4)
def _encoded(path: str) -> tuple[object, Memo]:
    words = words_of(path)
    return words, Memo(lambda word: struct.pack(f"<{len(ids := words.ids(word))}I", *ids))


def encode_pieces(keys, texts, vocabulary: str, capacity: int, end_id: int) -> Iterator[tuple]:
    """(key, piece, start, length, checksum of the ids) for each text's ids and end id."""
    words, ids_of = _encoded(vocabulary)
    end = struct.pack("<I", end_id)
    for key, text in zip(keys, texts, strict=True):
        ids = b"".join([*map(ids_of.__getitem__, words.split(text or "")), end])
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            yield key, piece, at // 4, len(part) // 4, zlib.crc32(part)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    places: int = 1024,
    look_ahead: int = 4096,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Places every text's token ids, followed by ``end_id``, into sequences.

    Only texts longer than ``capacity`` are cut. Each task packs what it reads, with
    ``places`` open bins; it takes in ``look_ahead`` pieces at a time, longest first,
    which keeps the loss near zero at bounded memory. Nothing is exchanged, so no
    source, key or text can make one task large. Sequences are numbered by task, so
    a task that runs again gives the same rows as long as it reads the same rows.

    One row per piece: the key, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. A NULL or empty text is the end id alone; NULL keys and
    repeated rows are packed like others; an empty table gives no rows. Only the two
    named columns are read, so further columns may have any name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, places)
        first = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []

        def placed() -> pd.DataFrame:
            waiting.sort(key=lambda p: -p[3])
            rows = [(*p, first + number, offset) for p in waiting for number, offset in (bins.place(p[3]),)]
            waiting.clear()
            return pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        for batch in batches:
            keys = batch["key"].astype(object).where(batch["key"].notna(), None)
            for piece in encode_pieces(keys, batch["text"], vocabulary, capacity, end_id):
                waiting.append(piece)
                if len(waiting) >= look_ahead:
                    yield placed()
        if waiting:
            yield placed()

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInPandas(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
