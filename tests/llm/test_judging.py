"""Quality rules and language identification."""

import zlib

import numpy as np
from frames import SMALL, awkward, documents, empty, no_labels
from hearthline.llm.language import clustered, fit_languages, identified
from hearthline.llm.quality import Forest, fit_rules, judged, repeated_words, statistics_of, usual_path
from hearthline.llm.queries import op6_quality_rules, op10_language_id
from hearthline.llm.sampling import bounded_keys

MIDDLE = "/root/testdata/sf0.01"


def slow_statistics(text):
    words, at = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            words += [at] if at else []
            at = ""
        else:
            at += c
    words += [at] if at else []
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    again = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_statistics():
    for text in ("", "a b c a b c d", "x\nx\n\nx y\n #$ \xa0z", "a a a a", "\x1ca\x1cb c", "É é! É"):
        assert statistics_of(text)[:5] == slow_statistics(text)
    assert statistics_of("Ab CD!")[5:] == (3, 1)
    assert repeated_words(["a", "b"]) == 0


def test_query_statistics_and_verdict(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = op6_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words, chars, symbols, lines, repeats = slow_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, lines, repeats)
        assert r.base_failed == (words < 50 or 100 * repeats > 50 * words)
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    rows = op6_quality_rules(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    good = rows[rows.quality == 1]
    assert good.kept.mean() > 0.97
    assert rows[rows.quality == 0].kept.mean() < 0.2


def test_forest_isolates_what_lies_apart():
    random = np.random.default_rng(0)
    good = random.normal(0, 1, (400, 3))
    box = np.vstack([good, [[9, 9, 9]]])
    forest = Forest.grow(good, box.min(axis=0), box.max(axis=0), 100, 128, 10, 1)
    inside, outside = forest.anomaly(np.array([[0.0, 0, 0], [9, 9, 9]]))
    assert outside > 0.6 > inside
    assert usual_path(1) == 0 and usual_path(2) < usual_path(100)


def test_rules_without_labels_and_on_awkward_rows(spark):
    frame = awkward(spark)
    assert fit_rules(frame, no_labels(spark)) is None
    got = judged(frame, None, into="rules")
    assert got.count() == frame.count() and got.columns == [*frame.columns, "rules"]
    assert got.where("doc_id = 1").select("rules.n_words", "rules.base_failed", "rules.kept").first() == (0, True, False)
    assert judged(empty(spark), None).count() == 0
    only_bad = spark.createDataFrame([(5, 0, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert fit_rules(frame, only_bad) is None


def test_samples_are_bounded_and_steady(spark):
    rows = spark.createDataFrame([(i % 500, "a" if i % 3 else "b") for i in range(3000)] + [(None, "a"), (1, None)], "k long, l string")
    picked = sorted(bounded_keys(rows, "k", "l", 20).collect())
    assert picked == sorted(bounded_keys(rows.repartition(7), "k", "l", 20).collect())
    assert 10 < sum(r.l == "a" for r in picked) <= 20


def test_held_out_languages(spark):
    truth = dict(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect())
    rows = op10_language_id(spark, MIDDLE).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_awkward_rows(spark):
    frame = awkward(spark)
    model = fit_languages(frame)
    got = identified(frame, model, into="score").select("doc_id", "score.*").collect()
    assert len(got) == frame.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (4, 5)} == {"en"}
    nothing = fit_languages(empty(spark))
    assert [r.g.lang_pred for r in identified(documents(spark, ["text"]), nothing, into="g").collect()] == ["und"]
    far = identified(documents(spark, ["中文字符"]), model, into="g").first().g
    assert far.rejected and far.lang_pred in ("en", "fr")


def test_clusters_are_what_lies_together():
    vectors = np.array([[1, 0, 0], [0.99, 0.1, 0], [0, 1, 0], [0, 0.99, 0.1], [0, 0, 1.0]])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    _, cluster = clustered(vectors, 3)
    assert cluster[0] == cluster[1] and cluster[2] == cluster[3] and len(set(cluster)) == 3
