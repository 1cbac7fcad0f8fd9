"""Near-duplicates, benchmark leaks and shared passages against brute force."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from frames import SMALL, awkward, documents, empty, no_items
from hearthline.llm import passages, sizes
from hearthline.llm.alignment import edits_between, edits_within, similarity
from hearthline.llm.components import components
from hearthline.llm.decontamination import GAP, MATCH, MISMATCH, leaks, most_score, smith_waterman, without_leaks
from hearthline.llm.neardup import near_classes, without_near_copies
from hearthline.llm.passages import (
    FAR, WIDTH, Surroundings, aligned, chains, common_tokens, connecting, edits_on_the_way, lone_parts, packs_of, seed_places, shared_passages,
)
from hearthline.llm.queries import op1_benchmark_leaks, op2_near_duplicates, op4_shared_passages
from hearthline.llm.shingles import occurrences, runs, word_hashes
from pyspark.sql import functions as F

CHANCE = random.Random(6)
VOCABULARY = ["".join(CHANCE.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]


def prose(words):
    return [CHANCE.choice(VOCABULARY) for _ in range(words)]


def edited(words, changes):
    words = list(words)
    for at in CHANCE.sample(range(len(words)), changes):
        words[at] = f"changed{CHANCE.randrange(10**9)}"
    return words


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_edits():
    chance = random.Random(0)
    for _ in range(1500):
        a = [chance.randint(0, 3) for _ in range(chance.randint(0, 12))]
        b = a[: chance.randint(0, 12)] + [chance.randint(0, 3) for _ in range(chance.randint(0, 6))]
        most, expected = chance.randint(0, 14), slow_edits(a, b)
        assert edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (expected if expected <= most else None)
    assert similarity(np.zeros(0), np.zeros(0), 0.8) == 1.0


def test_edits_by_columns_are_the_least():
    chance = random.Random(6)
    for _ in range(400):
        size, kinds = chance.choice((5, 40, 150)), chance.choice((2, 5, 400))
        a = np.array([chance.randrange(kinds) for _ in range(chance.randint(0, size))])
        b = np.array([chance.randrange(kinds) for _ in range(chance.randint(0, size))])
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist(), 1):
            last, row = row, [i]
            for j, y in enumerate(b.tolist(), 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert edits_between(a, b, size) == row[-1]
        assert edits_between(a, b, row[-1] - 1) is None


def test_local_alignment():
    chance = random.Random(1)
    for _ in range(200):
        a = [chance.randint(0, 4) for _ in range(chance.randint(1, 9))]
        b = [chance.randint(0, 4) for _ in range(chance.randint(1, 14))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (MATCH if x == y else MISMATCH), table[i - 1, j] + GAP, table[i, j - 1] + GAP)
        assert smith_waterman(np.array(a), np.array(b))[0] == table.max()


def test_occurrences_and_short_runs():
    assert occurrences(np.array([5, 3, 5, 5, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1]
    assert len(runs(word_hashes("a b"), 5)) == 1 and not len(runs(word_hashes(None), 5))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 9), (5, 6), (20, 20)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 7), 1), 7: 7, 8: 7, 9: 7, 20: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_classes(texts):
    """Classes by comparing all pairs of distinct texts."""
    words = {d: t.lower().split() for d, t in texts.items() if t is not None}
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in words.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    met = defaultdict(set)
    for d in sorted(words):
        near = {o for g in grams[d] for o in met[g]}
        same = [o for o in root if o in words and o < d and words[o] == words[d] and words[d]]
        for o in [*same, *(o for o in near if len(grams[d] & grams[o]) >= 0.8 * len(grams[d] | grams[o]))]:
            a, b = sorted((find(d), find(o)))
            root[b] = a
        for g in grams[d]:
            met[g].add(d)
    return {d: find(d) for d in texts}


def test_near_classes_query(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert dict(op2_near_duplicates(spark, SMALL).collect()) == slow_classes(texts)


def test_group_of_near_copies_around_a_lost_origin(spark):
    origin = prose(200)
    texts = [" ".join(edited(origin, CHANCE.randint(1, 6))) for _ in range(120)] + [" ".join(prose(80)) for _ in range(30)]
    got = dict(near_classes(documents(spark, texts)).collect())
    assert got == slow_classes(dict(enumerate(texts)))


def test_near_classes_of_awkward_rows(spark):
    frame = awkward(spark)
    got = dict(near_classes(frame).collect())
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    kept = without_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert near_classes(empty(spark)).count() == 0 and without_near_copies(empty(spark)).count() == 0


def test_leaks_query(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect())
    whole = {(d, i) for d, t in texts.items() for i, item in items.items() if " ".join(item.lower().split()) in " ".join(t.lower().split())}
    got = op1_benchmark_leaks(spark, SMALL).collect()
    assert whole <= {(r.doc_id, r.item_id) for r in got if r.score > 0.95}


def test_edited_leaks_in_blocks_of_items(spark):
    items = [prose(40) for _ in range(12)]
    texts = [" ".join([*prose(150), *edited(item, 5), *prose(100)]) for item in items] + [" ".join(prose(300)) for _ in range(20)]
    texts.append(" ".join([*prose(30), *items[0], *prose(30), *items[0][:15], *prose(30)]).upper())
    rows = [(i, " ".join(item)) for i, item in enumerate(items)] + [(50, None), (51, ""), (None, "x y z")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    expected = {(i, i) for i in range(12)} | {(32, 0)}
    for block in (10_000, 5):
        got = leaks(documents(spark, texts), benchmark, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
        assert all(150 <= r.first_word < r.end_word <= 190 for r in got if r.doc_id < 12)
    kept = without_leaks(documents(spark, texts), benchmark)
    assert kept.count() == 20 and kept.columns == documents(spark, texts).columns


def test_every_edited_copy_of_an_item_is_found(spark):
    items = [prose(59) for _ in range(42)]
    copies = [edited(item, 6 + i % 7) for i, item in enumerate(items)]
    texts = [" ".join([*prose(50), *copy, *prose(50)]) for copy in copies]
    rows = [(i, " ".join(item)) for i, item in enumerate(items)]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    shares = {i for i, c in enumerate(copies) if set(runs(word_hashes(" ".join(c)), 4).tolist()) & set(runs(word_hashes(" ".join(items[i])), 4).tolist())}
    assert len(shares) == 42
    alone = {(r.doc_id, r.item_id) for r in leaks(documents(spark, texts), benchmark).collect()}
    assert alone == {(i, i) for i in range(42)}
    whole = [" ".join([*prose(20), *item, *prose(20)]) for item in items]
    beside = {(r.doc_id, r.item_id) for r in leaks(documents(spark, texts + whole), benchmark).collect()}
    assert beside == {(i + n, i) for i in range(42) for n in (0, 42)}


def test_short_items_are_found_as_they_are(spark):
    items = [prose(n) for n in (1, 2, 3, 5, 8, 11)]
    texts = [" ".join([*prose(30), *item, *prose(30)]) for item in items] + [" ".join([*prose(30), *items[4][:4], *prose(30)])]
    benchmark = spark.createDataFrame([(i, " ".join(f"{w}q" for w in item)) for i, item in enumerate(items)], "item_id long, text string")
    marked = [" ".join(f"{w}q" if w in items[min(i, 4)] or (i < 6 and w in items[i]) else w for w in t.split()) for i, t in enumerate(texts)]
    got = leaks(documents(spark, marked), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(i, i, 1.0) for i in range(6)}


def test_bound_of_the_score():
    chance = random.Random(3)
    for _ in range(300):
        a, b = (np.array([chance.randint(0, 9) for _ in range(n)]) for n in (12, 20))
        assert smith_waterman(a, b)[0] <= most_score(np.isin(a, b))


def test_leaks_of_awkward_rows(spark):
    item = spark.createDataFrame([(1, "the same row twice")], "item_id long, text string")
    assert [tuple(r)[:3] for r in leaks(awkward(spark), item).collect()] == [(4, 1, 1.0)]
    assert without_leaks(awkward(spark), item).count() == 7
    assert leaks(awkward(spark), no_items(spark)).count() == 0 and leaks(empty(spark), item).count() == 0


def slow_chain(matches, cost):
    worth = []
    for i, (x, y) in enumerate(matches):
        worth.append(max([1.0] + [1 + worth[j] - cost * (x - u + y - v) for j, (u, v) in enumerate(matches[:i]) if u < x and v < y]))
    return max(worth)


def test_chains_are_worth_as_much_as_by_brute_force():
    chance = random.Random(4)
    for _ in range(200):
        matches = np.array(sorted({(chance.randint(0, 25), chance.randint(0, 25)) for _ in range(chance.randint(1, 20))}))
        found = chains(matches, 0.05, 10**9)
        assert sum(map(len, found)) == len(matches)
        for chain in found:
            assert (np.diff(chain, axis=0) > 0).all()
        best = max(len(c) - 0.05 * (c[-1] - c[0]).sum() for c in found)
        assert best == pytest.approx(slow_chain(matches.tolist(), 0.05))


def test_edited_passages_are_found():
    draw = np.random.default_rng(5)
    for size, edits in ((60, 6), (80, 8), (100, 10), (200, 40)):
        found = 0
        for _ in range(100):
            a = draw.integers(1, 2**63, size + 150).astype(np.uint64)
            b = draw.integers(1, 2**63, size + 120).astype(np.uint64)
            b[70 : 70 + size] = a[80 : 80 + size]
            b[70 + draw.choice(size, edits, replace=False)] += np.uint64(1)
            with np.errstate(over="ignore"):
                (here, grams), (there, others) = seed_places(a), seed_places(b)
            _, i, j = np.intersect1d(grams, others, return_indices=True)
            matches = np.array(sorted(zip(here[i].tolist(), there[j].tolist(), strict=True)), np.int64).reshape(-1, 2)
            kept = [c for c in chains(matches) if len(c) >= 2] if len(matches) > 1 else []
            found += any(aligned(a, b, c, WIDTH, 50, 0.8) for c in kept)
        assert found >= 90, (size, edits, found)


def test_repeated_lines_are_named_at_each_place():
    ends = np.array([(r * 60 + e, s * 70 + e) for r in range(30) for s in range(40) for e in (0, 45)])
    parts = lone_parts(ends, 50, 5)
    assert {p[0, 0] for p in parts} == {r * 60 for r in range(30)} and {p[0, 1] for p in parts} == {s * 70 for s in range(40)}
    assert len(parts) <= 70 and all(len(p) == 2 for p in parts)


def test_repeated_lines_of_two_texts(spark):
    line = prose(55)
    texts = [" ".join(w for _ in range(n) for w in [*line, *prose(60)]) for n in (1, 7, 9)]
    rows = shared_passages(documents(spark, texts)).collect()
    places = defaultdict(set)
    for r in rows:
        assert r.similarity >= 0.8 and r.end_word - r.first_word >= 50
        places[r.doc_id].add(r.first_word // 115)
        places[r.other_id].add(r.other_first_word // 115)
    assert places == {0: {0}, 1: set(range(7)), 2: set(range(9))}


def test_planted_passages(spark):
    passage, other = prose(70), prose(60)
    texts = [" ".join([*prose(CHANCE.randint(20, 200)), *edited(passage, i % 2), *prose(50)]) for i in range(12)]
    texts += [" ".join([*prose(30), *other[:30]]), " ".join([*prose(90), *other]), " ".join([*other, *prose(40)])]
    texts += [" ".join(prose(200)) for _ in range(15)] + [" ".join([*prose(60), *passage[:30]])]
    rows = shared_passages(documents(spark, texts)).collect()
    named = {d for r in rows for d in (r.doc_id, r.other_id)}
    assert named == {*range(12), 13, 14}
    assert all(r.end_word - r.first_word >= 50 and r.similarity >= 0.8 for r in rows)
    assert len(rows) <= 2 * len(texts)


def test_passages_of_which_every_part_is_frequent(spark):
    shared = prose(60)
    parts = [shared[:40], shared[20:]]
    ends = [" ".join([*prose(60), *part, *prose(60)]) for part in parts]
    both = [" ".join([*prose(70), *shared, *prose(70)]) for _ in range(2)]
    late = [" ".join([*prose(50), *part, *prose(50)]) for part in parts]
    exact = prose(50)
    both += [" ".join([*prose(70), *exact, *prose(n)]) for n in (70, 80)]
    pieces = [" ".join([*prose(60), *exact[n : n + 40], *prose(60)]) for n in (0, 10)]
    texts = [*ends, *pieces, *both, *late, *pieces]
    rows = shared_passages(documents(spark, texts)).collect()
    found = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in rows}
    assert {(4, 5), (6, 7)} <= found
    assert {(r.first_word, r.end_word) for r in rows if {r.doc_id, r.other_id} == {4, 5}} == {(70, 130)}


def test_edited_passages_of_which_every_part_is_frequent(spark):
    passages = [prose(60) for _ in range(6)]
    pieces = [" ".join([*prose(60), *p[n : n + 24], *prose(60)]) for p in passages for n in (0, 12, 24, 36)]
    changed = [[*p[:18], *prose(1), *p[19:41], *prose(1), *p[42:]] for p in passages]
    middle = [" ".join([*prose(80), *p, *prose(80)]) for pair in zip(passages, changed, strict=True) for p in pair]
    texts = [*pieces, *middle, *pieces]
    rows = shared_passages(documents(spark, texts).coalesce(1)).collect()
    found = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in rows}
    first = len(pieces)
    assert {(first + 2 * i, first + 2 * i + 1) for i in range(6)} <= found
    assert all(r.similarity >= 0.8 and r.end_word - r.first_word >= 50 for r in rows)


def test_common_tokens_by_brute_force():
    draw = np.random.default_rng(8)
    rows = [np.unique(draw.integers(0, 60, 30)).astype(np.uint32) for _ in range(60)]
    value, comp = np.array([5**20, 7**20, 11**17], np.uint64)[draw.integers(0, 3, 60)], draw.integers(0, 20, 60)
    for need in (0, 1, 9, 14):
        pairs = [p for i, j in common_tokens([r.tobytes() for r in rows], value, comp, lambda i, j: i != j, need) for p in zip(i, j, strict=True)]
        expected = {
            (min(i, j), max(i, j))
            for i in range(60)
            for j in range(i)
            if value[i] == value[j] and comp[i] != comp[j] and len(np.intersect1d(rows[i], rows[j])) >= need
        }
        assert len(pairs) == len(expected) and {(min(p), max(p)) for p in pairs} == expected


def test_common_tokens_of_which_one_row_is_fresh():
    draw = np.random.default_rng(9)
    rows = [np.unique(draw.integers(0, 60, 30)).astype(np.uint32) for _ in range(60)]
    value, comp, fresh = draw.integers(0, 3, 60).astype(np.uint64), draw.integers(0, 20, 60), draw.random(60) < 0.3
    pairs = [p for i, j in common_tokens([r.tobytes() for r in rows], value, comp, lambda i, j: i != j, 9, fresh) for p in zip(i, j, strict=True)]
    expected = {
        (j, i)
        for i in range(60)
        for j in range(i)
        if (fresh[i] or fresh[j]) and value[i] == value[j] and comp[i] != comp[j] and len(np.intersect1d(rows[i], rows[j])) >= 9
    }
    assert len(pairs) == len(expected) and {(min(p), max(p)) for p in pairs} == expected


def test_memory_of_common_tokens():
    draw = np.random.default_rng(10)
    rows = draw.integers(0, 2**32, (4_000, 110), np.uint32)
    rows[:2_000, :40] = rows[0, :40]  # alike surroundings in one component, and of one row in another one
    rows[3_000, :40] = rows[0, :40]
    comp = np.arange(4_000)
    comp[:2_000] = 0
    listed = [r.tobytes() for r in rows]
    fits = lambda i, j: i != j
    tracemalloc.start()
    found = sum(len(i) for i, j in common_tokens(listed, np.zeros(4_000, np.uint64), comp, fits, 18))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2_000
    assert most < 45 * rows.size  # bytes a token


def test_edits_on_the_way_by_brute_force():
    draw = np.random.default_rng(11)
    size, band, share = 20, 6, 0.2
    a = draw.integers(0, 4, (size, 60)).astype(np.int32)
    b = a.copy()
    b[draw.random(a.shape) < 0.2] = 9
    b[:, ::2] = np.roll(b[:, ::2], 2, axis=0)
    a[15:, 3], b[14:, 4] = -1, -1  # texts that end
    found = edits_on_the_way(a, b, band, share)
    for k in range(a.shape[1]):
        x, y = a[:, k][a[:, k] >= 0], b[:, k][b[:, k] >= 0]
        for i in range(1, len(x) + 1):
            ways = [slow_edits(x[: i - 1].tolist(), y[: j - 1].tolist()) - share * max(j - i, 0) for j in range(max(i - band, 1), min(i + band, len(y)) + 1) if x[i - 1] == y[j - 1]]
            if min(ways, default=FAR) < band:
                assert found[i, k] == pytest.approx(min(ways), abs=0.02)


def test_alike_entries_are_connected_by_few_pairs():
    draw = np.random.default_rng(12)
    line = draw.integers(0, 10**6, 116)
    rows, places, comp = [], [], []
    for i in range(300):
        around = draw.integers(10**6, 10**9, 121)
        around[30:100] = line[30:100]
        if i % 3 == 2:  # shares a stretch that is too short
            around[:45], around[75:] = (draw.integers(10**6, 10**9, n) for n in (45, 46))
        around[draw.choice([*range(32, 56), *range(65, 98)], 5, replace=False)] += 1
        rows.append(around.astype(np.int32).tobytes())
        places.append(1_000)
        comp.append(i)
    near = Surroundings(rows, np.array(places), 50, 0.8, WIDTH)
    value = np.repeat(np.array([5**20, 7**20], np.uint64), [40, 260])  # few rows of one value, and many
    found = connecting(near, value, np.array(comp), np.ones(300, bool), lambda i, j: i != j)
    alike = [{i for i in part if i % 3 < 2} for part in (range(40), range(40, 300))]
    assert len(found) == sum(map(len, alike)) - 2
    groups = {i: {i} for i in range(300)}
    for i, j, matches in found:
        assert {i, j} <= alike[0] or {i, j} <= alike[1]
        assert all(0 <= 58 + m < 117 for m in np.ravel(matches))
        both = groups[i] | groups[j]
        for k in both:
            groups[k] = both
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == set(map(frozenset, alike))


def test_packs_meet_where_one_entry_is_fresh(monkeypatch):
    monkeypatch.setattr(passages, "PACK", 10)
    draw = np.random.default_rng(13)
    gram = np.repeat(np.arange(6), [5, 10, 11, 450, 30, 25])
    fresh = draw.random(len(gram)) < np.array([0.5, 0.3, 0.3, 0.01, 0.9, 0])[gram]
    pack, packs = packs_of(gram, fresh)
    held = defaultdict(list)
    for i in range(len(gram)):
        for q in range(packs[i]):
            held[gram[i], min(pack[i], q), max(pack[i], q)].append(i)
    assert max(map(len, held.values())) <= 20
    pairs = [(i, j) for (_, low, high), of in held.items() for i in of for j in of if i < j and (low == high or pack[i] != pack[j]) and (fresh[i] or fresh[j])]
    expected = {(i, j) for i in range(len(gram)) for j in range(i) if gram[i] == gram[j] and (fresh[i] or fresh[j])}
    assert len(pairs) == len(expected) and {(j, i) for i, j in pairs} == expected
    rare = gram == 3  # of 450 entries few are fresh: the others stand there once for each pack of fresh ones
    assert packs[rare].sum() < 2 * rare.sum()


def test_long_lists_are_not_sent(spark, monkeypatch):
    frame = spark.createDataFrame([(1, list(range(50))), (2, list(range(51)))], "node long, places array<int>")
    hinted = lambda most: "ResolvedHint" in sent(most)._jdf.queryExecution().analyzed().toString()

    def sent(most):
        monkeypatch.setattr(sizes, "MOST_NUMBERS", most)
        return sizes.sent_if_small(frame, numbers=F.size("places"))

    assert hinted(101) and not hinted(100)


def test_passages_without_broadcasts(spark, monkeypatch):
    passage, other = prose(70), prose(90)
    texts = [" ".join([*prose(90), *passage[:k], *prose(1), *passage[k:], *prose(90), *other[k:]]) for k in (10, 20, 30, 40, 50, 60)]
    sent = {tuple(r) for r in shared_passages(documents(spark, texts)).collect()}
    monkeypatch.setattr(sizes, "MOST_NUMBERS", 0)
    assert sent and sent == {tuple(r) for r in shared_passages(documents(spark, texts)).collect()}


def test_passages_query_names_all_documents_with_a_shared_run(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    met = defaultdict(set)
    for d, t in texts.items():
        words = t.lower().split()
        for i in range(len(words) - 49):
            met[tuple(words[i : i + 50])].add(d)
    expected = {d for found in met.values() if len(found) > 1 for d in found}
    assert expected <= {d for r in op4_shared_passages(spark, SMALL).collect() for d in (r.doc_id, r.other_id)}


def test_passages_of_awkward_rows(spark):
    rows = shared_passages(awkward(spark)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(6, 5)}
    assert max(r.end_word - r.first_word for r in rows) == 40_000
    assert shared_passages(empty(spark)).count() == 0


def test_pairs_of_alike_passages_follow_the_documents(spark):
    passage = prose(60)
    pieces = [" ".join([*prose(60), *passage[n : n + 24], *prose(60)]) for n in (0, 12, 24, 36)]
    middle = [" ".join([*prose(80), *passage[:18], *prose(1), *passage[19:41], *prose(1), *passage[42:], *prose(80)]) for _ in range(40)]
    rows = shared_passages(documents(spark, [*pieces, *middle, *pieces]).coalesce(1)).collect()
    pairs = {(r.doc_id, r.other_id) for r in rows if {r.doc_id, r.other_id} <= set(range(4, 44))}
    group = {4}
    while more := {d for pair in pairs if group & set(pair) for d in pair} - group:
        group |= more
    assert group == set(range(4, 44))
    assert len(pairs) < 6 * len(middle)  # all pairs are 780
