"""The forms for long series and hot keys against brute force in pandas."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.operators import position, stats


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows and more belong to one key; values repeat a lot."""
    rng = random.Random(7)
    data = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.5 else rng.choice([None, *(f"k{j}" for j in range(20))])
        value = rng.choice([0.0, 1.0, 1.0, 1.0, None, rng.random() * 1e3, -rng.random()])
        data.append((key, i * 3 + rng.randrange(3), value))
    pdf = pd.DataFrame(data, columns=["k", "o", "v"])
    df = spark.createDataFrame(data, "k string, o bigint, v double").repartition(5)
    return df, pdf


FORMS = [{}, {"parts": 1}, {"parts": 40}]


@pytest.mark.parametrize("form", FORMS)
def test_positions(hot, form):
    df, pdf = hot
    got = position.with_position(df, ["o"], keys=["k"], **form).toPandas().sort_values(["k", "o"])
    want = pdf.sort_values(["k", "o"])
    want["timestep"] = want.groupby("k", dropna=False).cumcount()
    assert list(got["timestep"]) == list(want["timestep"])
    one = position.with_position(df, ["o"], **form).toPandas().sort_values("o")
    assert list(one["timestep"]) == list(range(len(pdf)))


def brute_runs(pdf):
    out = []
    for k, part in pdf.sort_values(["k", "o"]).groupby(pdf["k"].fillna("none")):
        last = None
        for o, v in zip(part["o"], part["v"]):
            if last is not None and v == last[1]:
                last[2] += 1
                last[4] = o
            else:
                last = [k, v, 1, o, o]
                out.append(last)
    return sorted(tuple(r) for r in out if r[2] >= 2)  # the missing key shows as "none"


def test_long_series_are_not_exchanged_whole(hot, monkeypatch):
    df, pdf = hot
    spark = df.sparkSession
    want = pdf.groupby("k", dropna=False).cumcount().sum()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, sent in ((22, True), (21, False)):  # the series of the table are 22
            monkeypatch.setattr(position, "FEW_SERIES", few)
            got = position.with_position(df, ["o"], keys=["k"])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) is sent and ("SortMergeJoin" in plan) is not sent
            assert got.agg(F.sum("timestep")).first()[0] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_by_local_time(spark):
    """Clock times order as written, whatever the session's zone does in spring."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(600).selectExpr(
            "id", "timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, int(id), 0) AS ts"
        )
        got = position.with_position(df, ["ts"], parts=20)
        assert got.where("id <> timestep").count() == 0
        assert got.count() == 600
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("form", FORMS)
def test_runs(hot, form):
    df, pdf = hot
    got = position.value_runs(df, "v", "o", keys=["k"], min_len=2, **form)
    assert sorted((r[0] or "none", *r[1:]) for r in got.collect()) == brute_runs(pdf)


def test_run_over_many_chunks(spark):
    df = spark.range(1000).selectExpr("id AS o", "IF(id BETWEEN 100 AND 899, 1.0, id) AS v")
    got = position.value_runs(df, "v", "o", min_len=2, parts=24).collect()
    assert [tuple(r) for r in got] == [(1.0, 800, 100, 899)]


def test_partitions_follow_the_rows(spark):
    """One far value, a dense range and ties of the first column change nothing."""
    dense = spark.range(9000).selectExpr("'a' AS k", "id AS o", "0 AS tied").union(
        spark.createDataFrame([("a", 10**15, 0), ("b", 1, 0), ("b", 10**14, 0)], "k string, o bigint, tied int")
    )
    for order in (["k", "o"], ["k", "tied", "o"]):
        copy = position.in_order(dense, order, parts=36)
        sizes = [r["count"] for r in copy.groupBy(position.PART).count().collect()]
        assert sum(sizes) == 9003 and max(sizes) <= 10 * 250 and len(sizes) > 20


def test_a_stored_order_reads_the_same_twice(spark):
    """Two readings of a copy agree on every row's partition, and plans carry no list of borders."""
    df = spark.range(5000).selectExpr("hash(id) AS o", "id % 3 AS k").repartition(7)
    copy = position.in_order(df, ["o"], parts=40)
    assert copy.exceptAll(copy).isEmpty()
    numbered = position.with_position(df, ["o"], ["k"], parts=40)
    assert "aggregate(" not in numbered._jdf.queryExecution().toString()


def test_many_partitions(spark):
    df = spark.range(2000).selectExpr("id AS o", "CASE WHEN id % 100 < 60 THEN 1.0 END AS v")
    got = position.with_position(df, ["o"], parts=150)
    assert got.where("o <> timestep").isEmpty()
    runs = position.value_runs(df, "v", "o", min_len=2, parts=150).collect()
    assert sorted(tuple(r)[1:] for r in runs) == [(60, i, i + 59) for i in range(0, 2000, 100)]


def test_any_type_orders_rows(spark):
    rows = [(float("nan"), "z"), (None, "é"), (1.5, None), (-0.0, "a"), (float("inf"), "a"), (float("-inf"), "Z"), (2.5, "")] * 30
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "d double, s string, i int").repartition(4)
    for order in (["d", "i"], ["s", "i"], ["s", "d", "i"]):
        whole = df.orderBy(*order).select("i").toPandas()["i"].tolist()
        for form in FORMS:
            got = position.with_position(df, order, **form).toPandas().sort_values("timestep")
            assert got["i"].tolist() == whole and got["timestep"].tolist() == list(range(len(whole)))
    runs = position.value_runs(df.orderBy("i").limit(6), "d", "s", parts=2)
    assert sorted(r["length"] for r in runs.collect()) == [1] * 6


def test_no_quantile_runs_while_plans_are_built(spark):
    tracker = spark.sparkContext.statusTracker()
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS o", "CAST(id AS DOUBLE) AS v")
    spark.sparkContext.setJobGroup("planning", "")
    stats.quantiles(df, ["v"], [0.5], ["k"])
    stats.iqr_outliers(df, "v", keys=["k"])
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("tests", "")


def test_neighbours_over_gaps_and_missing_positions(spark):
    rows = [(p * 2 if p % 5 else p * 2 + 7, p) for p in range(60)] + [(None, -1)]
    df = spark.createDataFrame(rows, "p int, x int").repartition(3)
    for bits in (1, 3, 16):
        got = position.with_neighbours(df, "p", {"l": lambda w: F.lag("x").over(w)}, before=1, bits=bits).collect()
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
        want = {x: before for (_, x), before in zip(ordered, [None, *(x for _, x in ordered)])}
        assert {r["x"]: r["l"] for r in got} == want


def test_neighbours(spark):
    pdf = pd.DataFrame({"p": range(300), "x": [(i * 37) % 11 for i in range(300)]})
    df = spark.createDataFrame(pdf).repartition(3)
    got = position.with_neighbours(
        df,
        "p",
        {
            "d": lambda w: F.col("x") - F.lag("x").over(w),
            "s": lambda w: F.sum("d").over(w.rowsBetween(-4, 0)),
            "n": lambda w: F.lead("x", 2).over(w),
        },
        before=5,
        after=2,
        bits=4,
    ).toPandas().sort_values("p")
    d = pdf["x"].diff()
    assert len(got) == 300
    assert got["d"].fillna(-99).tolist() == d.fillna(-99).tolist()
    assert got["s"].fillna(-99).tolist() == d.rolling(5, min_periods=1).sum().fillna(-99).tolist()
    assert got["n"].fillna(-99).tolist() == pdf["x"].shift(-2).fillna(-99).tolist()


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles(hot, accuracy):
    df, pdf = hot
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = stats.quantiles(df, ["v", "o"], qs, keys=["k"], accuracy=accuracy).collect()
    found = {(r["k"], r["column"], r["q"]): r["quantile"] for r in got}
    for k, part in pdf.groupby(pdf["k"].fillna("none")):
        for c in ("v", "o"):
            for q in qs:
                assert found[None if k == "none" else k, c, q] == pytest.approx(part[c].quantile(q), abs=1e-9)
    whole = stats.quantiles(df, ["v"], qs, accuracy=accuracy).collect()
    assert {r["q"]: r["quantile"] for r in whole} == pytest.approx({q: pdf["v"].quantile(q) for q in qs})


def test_only_rows_inside_a_bracket_are_ranked(spark):
    """Ties across a bracket's ends, skewed values, and ranks at both ends stay exact."""
    rng = random.Random(3)
    values = [float(int(rng.paretovariate(0.7))) if rng.random() < 0.8 else rng.gauss(0, 1) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(9)
    qs = [0.0, 0.001, 0.3, 0.5, 0.9, 0.9999, 1.0]
    for accuracy in (50, 1000, 5000):
        got = {r["q"]: r["quantile"] for r in stats.quantiles(df, ["v"], qs, accuracy=accuracy).collect()}
        assert got == pytest.approx({q: pd.Series(values).quantile(q) for q in qs})


def test_quantiles_with_infinities_and_extremes(spark):
    values = [-math.inf, -1.0, 0.0, 5e-324, 1.0, 1e300, math.inf, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for accuracy in (1, 10_000):
        got = stats.quantiles(df, ["v"], [i / 7 for i in range(8)], accuracy=accuracy).orderBy("q").collect()
        assert [r["quantile"] for r in got][:7] == values[:7]


def test_correlation_is_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 7.0], "b": [2.0, None, 1.0, 5.0, 3.0], "c": [1.0] * 5})
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlation_long(df).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] is None and got["c", "c"] is None


def test_profile_and_text(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "b"), (float("nan"), None)], "x double, t string")
    got = stats.profile_numeric(df).first()
    assert (got["count"], got["min"], got["q25"], got["q50"], got["q75"], got["max"]) == (3, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert tuple(stats.profile_text(df).first()) == ("t", 3, 2, "b", 2)
    assert [tuple(r) for r in stats.null_counts(df).collect()] == [("x", 1), ("t", 1)]
    one = stats.constant_columns(df, ["x"], approximate=True).first()
    assert one["n_unique"] == 3 and not one["is_constant"]
