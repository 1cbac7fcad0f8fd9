"""A word-level view of a BPE vocabulary file, for counting and packing tokens.

The vocabularies meant here (a ``tokenizers`` JSON file) lower the text, drop white
space and encode every word on its own, with a mark on the word's last symbol. So
the ids of a text are those of its words put together, and the ids of a word can be
kept and used again.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tokenizers import Tokenizer

SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters are split here; they are composed, and each has one
#: letter as its lower case. Other texts are split by the library, one stretch
#: without white space at a time.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-/:-@\[-`{-~"
KNOWN_WORD = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{SIGNS}]+")
KNOWN_BYTES = bytes(b for b in range(256) if re.match(rf"[{LETTERS}{SIGNS}0-9 \t-\r]", chr(b)))
#: White space as the vocabulary's patterns define it.
SPACE = "\t-\r \x85\xa0  -     　"
STRETCH = re.compile(f"[^{SPACE}]+")


class Words:
    """Splits texts into the vocabulary's words and encodes single words."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or split.get("pattern", {}).get("Regex") != SPLIT_PATTERN
            or not spec["model"].get("end_of_word_suffix")
        ):
            raise ValueError(f"{path}: not a lower-case vocabulary with word ends")
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        self.hint = next(iter(self.special), "\0")[:2]
        self.bytes = _symbol_table()

    def symbols(self, word: str) -> str:
        """The word with one printable symbol for each UTF-8 byte."""
        return word.encode("utf-8", "replace").decode("latin-1").translate(self.bytes)

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(self.symbols(word))]

    def split(self, text: str) -> list[str]:
        """The words of a text in order; a special string stands for itself."""
        if known(text) and self.hint not in text:
            return KNOWN_WORD.findall(text.lower())
        words: list[str] = []
        for stretch in STRETCH.findall(text):
            words += self.split_stretch(stretch)
        return words

    def split_stretch(self, stretch: str) -> list[str]:
        """The same for a text without white space."""
        if known(stretch) and self.hint not in stretch:
            return KNOWN_WORD.findall(stretch.lower())
        words: list[str] = []
        for part in self.marks.split(stretch) if self.marks else [stretch]:
            if part in self.special:
                words.append(part)
            elif part:
                words += self.plain_words(part)
        return words

    def plain_words(self, part: str) -> list[str]:
        """Words of a stretch in which special strings are ordinary text."""
        part = self.tokenizer.normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]


def known(text: str) -> bool:
    """Whether the text has only characters that are split here."""
    try:
        return not text.encode("latin-1").translate(None, KNOWN_BYTES)
    except UnicodeEncodeError:
        return False


def _symbol_table() -> dict[int, int]:
    """Byte to printable symbol, in the way of byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def words_of(path: str) -> Words:
    """One vocabulary per Python worker and path."""
    return Words(path)


class Memo(dict):
    """Values per word, kept up to ``limit`` words and then begun anew.

    The limit bounds a worker's memory; values do not depend on it.
    """

    def __init__(self, make, limit: int = 150_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value
