"""The Jaccard join, spelling variants and the manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from frames import awkward, documents, empty
from pyspark.sql import functions as F

from hearthline.llm import manifest, setjoin, variants
from hearthline.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(400)]


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", small(text)) if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(rows):
    sets = [(key, shingle_set(text)) for key, text in rows]
    least = {key: key for key, _ in sets}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                first, second = sorted((root(a), root(b)))
                least[second] = first
    return sorted((key, len(s), root(key)) for key, s in sets)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = rng.choice([rng.choice(WORDS), "zz" + str(rng.random())])
    return words


def family_texts():
    """Copies with few and many edits, long and short texts, and a passage all have."""
    rng = random.Random(5)
    shared = [rng.choice(WORDS) for _ in range(40)]
    texts = ["", None, "One two", "one TWO", "one two three", "one two threE four"]
    for size in (12, 60, 200):
        base = [rng.choice(WORDS) for _ in range(size)]
        texts += [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(30)]
    hot = [rng.choice(WORDS) for _ in range(100)]
    texts += [" ".join(edited(rng, hot, rng.choice([0, 1, 1, 2, 3]))) for _ in range(120)]
    texts += [" ".join(shared + [rng.choice(WORDS) for _ in range(rng.randrange(3, 40))]) for _ in range(60)]
    return texts


@pytest.mark.parametrize("pack", [1 << 16, 300])
def test_components_equal_all_pairs(spark, monkeypatch, pack):
    monkeypatch.setattr(setjoin, "PACK", pack)
    texts = family_texts()
    got = setjoin.linked_sets(documents(spark, texts, 7).repartition(5))
    assert sorted(map(tuple, got.collect())) == brute_components(list(enumerate(texts, 7)))


def test_a_poor_frequency_table_changes_nothing(spark, monkeypatch):
    texts = family_texts()[:140]
    monkeypatch.setattr(setjoin, "frequencies", lambda docs, text: np.zeros(1 << setjoin.BITS, np.uint8))
    got = setjoin.linked_sets(documents(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(list(enumerate(texts)))


def test_join_of_awkward_rows(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in setjoin.linked_sets(awkward(spark)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[5][1] == got[6][1] == 5
    assert setjoin.linked_sets(empty(spark)).count() == 0


def test_a_key_with_two_texts_links_both(spark):
    rows = [(3, "a b c d"), (9, "a b c d"), (9, "e f g h i"), (5, "e f g h i")]
    got = setjoin.linked_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(3, 2, 3), (5, 3, 3), (9, 3, 3)]


def single_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, forms = {}, {}
    for w, n in words.items():
        near = [(-m, o) for o, m in words.items() if single_edit(w, o)]
        best = min(near, default=None)
        forms[w] = best[1] if best and -best[0] >= 10 * n else None
        out[w] = [n, len(near), forms[w], -best[0] if forms[w] else None]
    for w in words:
        last = w
        while forms[last]:
            last = forms[last]
        out[w].append(last)
    return sorted((w, *v) for w, v in out.items())


def variant_texts():
    rng = random.Random(2)
    stems = ["aaaaaaa", "abababab", "Éclairées", "straßen×÷", "internationalization", "zzzzzzzz" * 40]
    texts = []
    for stem in stems:
        texts.append((stem + " ") * 220)
        for _ in range(40):
            at = rng.randrange(len(stem) + 1)
            changed = rng.choice([stem[:at] + rng.choice("abé") + stem[at:], stem[:at] + stem[at + 1 :], stem[:at] + "b" + stem[at + 1 :]])
            texts.append((changed + "-") * rng.choice([1, 2, 3, 21, 30]))
    return [*texts, None, "", "short words only"]


@pytest.mark.parametrize("block", [1 << 14, 64])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    texts = variant_texts()
    got = variants.spelling_variants(documents(spark, texts).repartition(4))
    got = got.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute_variants(enumerate(texts))


def test_variants_of_awkward_rows(spark):
    docs = awkward(spark).select("doc_id", "text")
    got = variants.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute_variants([tuple(r) for r in docs.collect()])
    assert variants.spelling_variants(empty(spark)).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def brute_proof(levels, at):
    steps = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        steps.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return steps


def brute_manifest(rows):
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((held, brute_tree([leaf for _, leaf in held])))
    top = brute_tree([levels[-1][0] for _, levels in trees])
    out = []
    for i, (held, levels) in enumerate(trees):
        for at, (key, leaf) in enumerate(held):
            steps = brute_proof(levels, at) + brute_proof(top, i)
            out.append((key, leaf, levels[-1][0], top[-1][0], "".join("".join(a + b) for a, b in steps)))
    return sorted(out, key=repr)


def encoded(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_trees(spark, levels):
    """Groups of one row and of many, a NULL group, and blocks of any height."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "src0", "src0", "é", "z", f"one{i}"]), f"line\n{i % 7}") for i in range(130)]
    rows += [(None, "src0", "no key"), (5, "src0", "again"), (5, "src0", "again"), (5, "src0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    claimed = manifest.digest_of(F.col("doc_id"), F.col("source"), F.replace("text", F.lit("\n"), F.lit("")))
    found = manifest.manifest(docs, ["doc_id", "source", "text"], claimed=claimed, levels=levels).collect()
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in found), key=repr)
    assert got == brute_manifest([(k, g, encoded(k, g, t)) for k, g, t in rows])
    changed = {encoded(k, g, t): "\n" in (t or "") for k, g, t in rows}
    assert all(r["verified"] is not changed[r["leaf"]] for r in found)
    assert all(r["folded_root"] == manifest.folded(r["leaf"], r["proof"], r["path"]) for r in found if r["verified"])


def test_manifest_of_awkward_rows(spark):
    docs = awkward(spark)
    found = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"]).collect()
    rows = [(r["doc_id"], r["source"], encoded(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in found), key=repr) == brute_manifest(rows)
    assert all(r["verified"] for r in found)
    assert manifest.manifest(empty(spark), ["doc_id"]).count() == 0
    one = manifest.manifest(documents(spark, ["alone"]), ["text"]).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == ""


def test_queries_over_the_tables(spark):
    from frames import SMALL

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_jaccard_join"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == brute_components(docs)
    got = QUERIES["op12_spelling_variants"](spark, SMALL).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute_variants(docs)
