"""Exact token counts of every prefix of a text, by dynamic programming.

Within a word, the encoding of a prefix is found from those of shorter prefixes: its
last token is the one that ends there and that the merge rules leave alone beside the
last token of what comes before it, and the count is one more than before it. So one
pass over a word yields the count at each of its prefixes, and questions about
truncation or budgets are answered from stored counts without encoding again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from hearthline.llm.vocabulary import STRETCH, Memo, Words, words_of


#: Distance from a symbol to its form at the end of a word.
FINAL = 0x400
#: Longer words are counted without recursion.
DEEP = 100


class PrefixCounter:
    """Token counts of prefixes under one vocabulary.

    A word is a string of one symbol per byte, the last one in its final form, and the
    vocabulary's tokens are such strings too.
    """

    def __init__(self, words: Words) -> None:
        self.words = words
        self.tokens = {self._form(t): i for t, i in words.vocab.items() if t not in words.special}
        self.longest = max(map(len, self.tokens))
        self.rules = BPE(vocab=self.tokens, merges=[(self._form(a), self._form(b)) for a, b in words.ranks])
        self.fits = Memo(self._fits)
        self.states = Memo(self._state)
        self.total = Memo(self._of_word)

    def _form(self, token: str) -> str:
        cut = len(token) - len(self.words.suffix)
        if cut > 0 and token.endswith(self.words.suffix):
            return token[: cut - 1] + chr(ord(token[cut - 1]) + FINAL)
        return token

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the merge rules leave two tokens (or one, after nothing) as they are."""
        before, token = pair
        found = self.rules.tokenize(before + token)
        return len(found) == 1 + bool(before) and found[-1].value == token

    def _state(self, symbols: str) -> tuple[str, int]:
        """Last token and number of tokens of ``symbols``, from the states of prefixes.

        Only the prefixes are looked at before which a token of the vocabulary stands.
        """
        tokens, fits, states = self.tokens, self.fits, self.states
        for start in range(max(0, len(symbols) - self.longest), len(symbols)):
            token = symbols[start:]
            if token in tokens:
                last, count = states[symbols[:start]] if start else ("", 0)
                if fits[last, token]:
                    return token, count + 1
        raise ValueError(f"no token of the vocabulary ends {symbols!r}")

    def _of_word(self, word: str) -> int:
        if word in self.words.special:
            return 1
        symbols = self.words.symbols(word)
        if len(symbols) > DEEP:
            return self._at_ends(symbols, only_last=True)[-1]
        return self._state(symbols[:-1] + chr(ord(symbols[-1]) + FINAL))[1]

    def _at_ends(self, symbols: str, only_last: bool = False) -> list[int]:
        """Tokens of ``symbols[:i]`` taken as a word of its own, for i from 1, forwards."""
        last, count, ends = [""], [0], []

        def found(end: int, closing: str) -> tuple[str, int]:
            for start in range(max(0, end - self.longest), end):
                token = symbols[start : end - 1] + closing
                if token in self.tokens and self.fits[last[start], token]:
                    return token, count[start] + 1
            raise ValueError(f"no token of the vocabulary ends at {end}")

        for end in range(1, len(symbols) + 1):
            if not only_last or end == len(symbols):
                ends.append(found(end, chr(ord(symbols[end - 1]) + FINAL))[1])
            token, tokens = found(end, symbols[end - 1])
            last.append(token)
            count.append(tokens)
        return ends

    def _sum(self, words: list[str]) -> int:
        return sum(map(self.total.__getitem__, words))

    def in_stretch(self, stretch: str) -> np.ndarray:
        """Counts at each code point of a text without white space."""
        counts, at = np.zeros(len(stretch), np.int64), 0
        base = 0
        for part in self.words.marks.split(stretch) if self.words.marks else [stretch]:
            if not part:
                continue
            if part in self.words.special:  # cut short, it is ordinary text, together with what stands before
                before = stretch[:at]
                begun = max((before.rfind(s) + len(s) for s in self.words.special if s in before), default=0)
                outer = base - self._sum(self.words.plain_words(stretch[begun:at])) if begun < at else base
                for k in range(1, len(part)):
                    counts[at + k - 1] = outer + self._sum(self.words.plain_words(stretch[begun : at + k]))
                counts[at + len(part) - 1] = base + 1
            else:
                counts[at : at + len(part)] = base + self._in_plain(part)
            at += len(part)
            base = int(counts[at - 1])
        return counts

    def _in_plain(self, part: str) -> np.ndarray:
        lowered = [self.words.tokenizer.normalizer.normalize_str(c) for c in part]
        if not unicodedata.is_normalized("NFC", part) or any(len(c) != 1 for c in lowered):
            return np.array([self._sum(self.words.plain_words(part[:k])) for k in range(1, len(part) + 1)])
        counts: list[int] = []
        base = 0
        for word in self.words.plain_words(part):
            if word[0] == "'" and len(word) > 2:  # shorter, it is no contraction any more
                counts += [base + self._sum(self.words.plain_words(word[:k])) for k in range(1, len(word) + 1)]
            else:
                ends = self._at_ends(self.words.symbols(word))
                where = np.cumsum([len(c.encode()) for c in word]) - 1
                counts += [base + ends[i] for i in where]
            base = counts[-1]
        return np.array(counts)

    def count(self, text: str) -> int:
        return self._sum(self.words.split(text))

    def every_prefix(self, text: str) -> np.ndarray:
        """Counts of ``text[:k]`` for k from 0 to its length."""
        counts, base, at = np.zeros(len(text) + 1, np.int32), 0, 0
        for found in STRETCH.finditer(text):
            counts[at : found.start() + 1] = base
            counts[found.start() + 1 : found.end() + 1] = base + self.in_stretch(found.group())
            base, at = int(counts[found.end()]), found.end()
        counts[at:] = base
        return counts

    def longest_within(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        base = at = 0
        for found in STRETCH.finditer(text):
            more = self._sum(self.words.split_stretch(found.group()))
            if base + more > budget:
                inside = np.flatnonzero(base + self.in_stretch(found.group()) <= budget)
                return found.start() + (int(inside[-1]) + 1 if len(inside) else 0)
            base, at = base + more, found.end()
        return len(text)


@lru_cache(maxsize=4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(words_of(path))


def count_tokens(docs: DataFrame, vocabulary: str, budget: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens of each whole text and the longest prefix within ``budget`` tokens.

    One row per row of ``docs`` (repeated rows give repeated results): the key,
    ``n_bytes`` (UTF-8), ``n_tokens``, and ``budget_chars``, the code points of the
    longest prefix that has at most ``budget`` tokens. A NULL text counts as empty
    (0, 0, 0), a NULL key stays NULL, an empty table gives an empty result. Only the
    two named columns are read, so further columns may have any name.
    No rows are exchanged; a text is handled whole and on its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            tokens = [counter.count(t) for t in texts]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts],
                    "n_tokens": tokens,
                    "budget_chars": [len(t) if n <= budget else counter.longest_within(t, budget) for t, n in zip(texts, tokens, strict=True)],
                }
            )

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInPandas(run, f"key {kind}, n_bytes long, n_tokens long, budget_chars long").withColumnRenamed("key", key)


def prefix_counts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and ``counts``: tokens of the first k code points, k from 0 to the length.

    To be stored once and asked often with :func:`tokens_before` and :func:`cut_at`.
    NULL texts have the counts of an empty text, ``[0]``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "counts": [counter.every_prefix(t or "") for t in batch["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInPandas(run, f"key {kind}, counts array<int>").withColumnRenamed("key", key)


def tokens_before(counts: Column, length: Column) -> Column:
    """Tokens of the prefix of ``length`` code points (beyond the end: of the whole)."""
    return F.get(counts, F.greatest(F.lit(0), F.least(length, F.size(counts) - 1)).cast("int"))


def cut_at(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return F.coalesce(F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i))), F.lit(0))
