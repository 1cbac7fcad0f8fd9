"""Hashes of words and of runs of words, as numpy arrays."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
#: White space between words: blank, tab, line ends.
_SPACE = np.isin(np.arange(256), [*b" \t\n\r\x0b\x0c"])
ODD_BITS = 2048
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse


def _powers_upto(count: int) -> list[np.ndarray]:
    if len(_powers[0]) < count:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(count, 1 << 16), base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers


def word_hashes(text: str | None, ascii_only: bool = False) -> np.ndarray:
    """A 64-bit hash of each lower-case word, cut at ASCII white space; none for NULL.

    With ``ascii_only``, only ``A-Z`` are made small. A word's hash is a polynomial in its bytes, from differences of sums over the
    whole text, so all words are hashed at once.
    """
    small = text if ascii_only or not text else text.lower()
    raw = small.encode("utf-8", "surrogatepass") if small else b""
    data = np.frombuffer(raw.lower() if ascii_only else raw, np.uint8)
    with np.errstate(over="ignore"):
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        begins, ends = edges[0::2], edges[1::2]
        powers, inverse = _powers_upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64) * np.uint64(_ODD))


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; one for all if there are fewer."""
    count = len(words) - width + 1
    if count < 1:
        if not len(words):
            return np.zeros(0, np.uint64)
        width, count = len(words), 1
    total = np.zeros(count, np.uint64)
    for i in range(width):
        total = total * np.uint64(_ODD) + words[i : i + count]
    return mixed(total + np.uint64(width))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value has occurred before its place."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
    counts = np.empty(len(values), np.int64)
    counts[order] = np.arange(len(values)) - np.repeat(begins, np.diff(np.append(begins, len(ranked))))
    return counts


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def odd_bits(tokens: np.ndarray) -> bytes:
    """One bit per bin of tokens, set if an odd number of them is in it.

    The bits in which two sets differ are at most the tokens in which they do, and nearly
    as many if these are few, however large the sets are.
    """
    odd = np.bincount((tokens % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bit_words(bits) -> np.ndarray:
    """Odd bits of several sets as rows of 64-bit words."""
    return np.frombuffer(b"".join(bytes(b) for b in bits), np.uint64).reshape(-1, ODD_BITS // 64)
