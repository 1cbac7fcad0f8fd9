"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from frames import SMALL, awkward, documents, empty
from hearthline.llm.packing import OpenBins, pack
from hearthline.llm.queries import op3_token_counts, op9_best_fit_packing
from hearthline.llm.tokencount import PrefixCounter, count_tokens, cut_at, prefix_counts, tokens_before
from hearthline.llm.vocabulary import Words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "the", "'re", "'", "r", "e", "é", "É", "ß", "1", "23", ".", ",", "!!", " ", "  ", "\n", "\t", "\x1c", "\xa0",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "end", "İ", "Σ", "中", "文字", "😀", "ing", "tion", "THE",
    "​", "_", "²", "don't", "they've", "̀", "x" * 130,
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return Words(PATH)


def test_every_character_alone_and_in_a_word(words, library):
    for code in [*range(0x500), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), *range(0xFB00, 0xFB50), *range(0x1F600, 0x1F640)]:
        text = f"a{chr(code)}B {chr(code)} x"
        assert [i for w in words.split(text) for i in words.ids(w)] == library(text), hex(code)


def test_random_texts_and_all_their_prefixes(words, library):
    counter, chance = PrefixCounter(words), random.Random(3)
    for _ in range(250):
        text = "".join(chance.choice(PARTS) for _ in range(chance.randint(0, 10)))
        expected = [len(library(text[:k])) for k in range(len(text) + 1)]
        assert counter.every_prefix(text).tolist() == expected
        assert counter.count(text) == expected[-1]
        for budget in (0, 1, 3, 9):
            assert counter.longest_within(text, budget) == max(k for k, n in enumerate(expected) if n <= budget)


def test_query_counts_like_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    for row in op3_token_counts(spark, SMALL).collect():
        ids = library(texts[row.doc_id])
        assert (row.n_bytes, row.n_tokens) == (len(texts[row.doc_id].encode()), len(ids))
        assert row.over_limit == (len(ids) > 2048)
        assert len(library(texts[row.doc_id][: row.budget_chars])) <= 2048


def test_stored_counts_answer_questions(spark, library):
    text = "They've counted 12 things, doubtlessly."
    stored = prefix_counts(documents(spark, [text, None]), PATH)
    got = stored.select("doc_id", tokens_before(F.col("counts"), F.lit(9)).alias("n"), cut_at(F.col("counts"), F.lit(4)).alias("cut"))
    first, second = got.orderBy("doc_id").collect()
    assert first.n == len(library(text[:9]))
    assert first.cut == max(k for k in range(len(text) + 1) if len(library(text[:k])) <= 4)
    assert (second.n, second.cut) == (0, 0)


def test_counts_of_awkward_rows(spark, library):
    frame = awkward(spark)
    got = count_tokens(frame, PATH).collect()
    assert len(got) == frame.count()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r.doc_id or -1, len(library(r.text or ""))) for r in frame.collect())
    assert count_tokens(empty(spark), PATH).count() == 0


def checked(rows, texts, library, capacity=2048):
    """All ids are there once, in pieces that fill sequences without gaps or overlap."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids = np.array([*library(texts[doc] or ""), 0], "<u4")
        expected = [(i // capacity, i, len(part), zlib.crc32(part.tobytes())) for i in range(0, len(ids), capacity) for part in (ids[i : i + capacity],)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_a_round_trip_and_tight(spark, library):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = op9_best_fit_packing(spark, SMALL).collect()
    used = checked(rows, texts, library)
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_awkward_rows(spark, library):
    frame = awkward(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    checked(pack(frame, PATH).collect(), {r.doc_id: r.text for r in frame.collect()}, library)
    assert sorted(r.length for r in pack(awkward(spark).where("doc_id IS NULL OR doc_id = 4"), PATH).collect())[1] == 5
    assert pack(empty(spark), PATH).count() == 0


def test_bins_choose_the_fullest_that_fits_and_close_the_fullest():
    chance = random.Random(5)
    for _ in range(50):
        bins, open_bins, made = OpenBins(20, 3), {}, 0
        for _ in range(60):
            length = chance.randint(1, 20)
            number, offset = bins.place(length)
            fitting = [s for s in open_bins.values() if s >= length]
            if fitting:
                assert open_bins[number] == min(fitting) and offset == 20 - open_bins[number]
            else:
                if len(open_bins) == 3:
                    least = min(open_bins.values())
                    closed = next(n for n in reversed(open_bins) if open_bins[n] == least)
                    closed = [n for n in open_bins if open_bins[n] == least and n not in {m for b in bins.by_space for m in b}] or [closed]
                    del open_bins[closed[0]]
                assert (number, offset) == (made, 0)
                made, open_bins[number] = made + 1, 20
            open_bins[number] -= length
            if not open_bins[number]:
                del open_bins[number]
