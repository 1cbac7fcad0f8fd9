"""CSV coercion, row numbers over files and splits, sinks."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.operators.columns import drop_colliding, move_column, prefix_columns
from hearthline.sources import tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", "v,n,t\n1.5,1,x\nNaN,,nan\ninf,7.0,y\n-inf,3,\n 5 ,4,z\nabc,x,N/A\n")
    schema = T.StructType(
        [T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("t", T.StringType())]
    )
    got = [tuple(r) for r in tables.read_table(spark, path, schema, position="p").orderBy("p").collect()]
    inf = float("inf")
    assert got == [
        (1.5, 1, "x", 0),
        (None, None, None, 1),
        (inf, 7, "y", 2),
        (-inf, 3, None, 3),
        (5.0, 4, "z", 4),
        (None, None, None, 5),
    ]


def test_csv_inference(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c,d\n1,1.5,x,\n2,nan,y,\n,2,3,NaN\n")
    df = tables.read_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "double"]
    assert rows(df, "a") == [(1,), (2,), (None,)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_positions_over_files_and_splits(spark, tmp_path, fmt):
    source = spark.range(0, 5000, 1, 3).selectExpr("id", "repeat('x', 50) AS pad")
    path = str(tmp_path / fmt)
    tables.write_table(source, path, fmt)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("pad", T.StringType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = tables.read_table(spark, path, schema, fmt, position="p").select("id", "p").toPandas().sort_values("p")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert list(got["p"]) == list(range(5000))
    assert list(got["id"]) == list(range(5000))


def test_prefix_and_missing_file(spark, tmp_path):
    path = write(tmp_path / "rewards.csv", "reward,Hour,MONTH\n1,2,3\n")
    assert tables.read_prefixed(spark, path, "reward").columns == ["reward_reward", "Hour", "MONTH"]
    assert tables.read_prefixed(spark, path, None).columns == ["reward", "Hour", "MONTH"]
    assert tables.read_prefixed(spark, str(tmp_path / "none.csv"), "reward") is None


def test_round_trips_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "k bigint, v string")
    schema = df.schema
    for fmt in ("csv", "json", "parquet"):
        tables.write_table(df, str(tmp_path / fmt), fmt)
        assert rows(tables.read_table(spark, str(tmp_path / fmt), schema, fmt)) == [(1, None), (2, "b")]
    with pytest.raises(ValueError, match="duplicate"):
        tables.write_table(df.selectExpr("k", "k AS K"), str(tmp_path / "dup"), "csv")


def test_load_report(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "source string, broken boolean")
    assert rows(tables.load_report(df, "source", "broken")) == [("a", 2, 1, "malformed"), ("b", 1, 0, "ok")]


def test_column_edits(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `time` int, `c:[C]` int")
    assert prefix_columns(df, "p").columns == ["p_a.b", "time", "p_c:[C]"]
    assert move_column(df, "c:[C]", 1).columns == ["a.b", "c:[C]", "time"]
    assert drop_colliding(df, ["time", "a.b"], ["time"], "_y").columns == ["a.b_y", "time", "c:[C]"]


def test_bad_values_never_become_numbers_or_end_a_job(spark):
    from hearthline.functions.numbers import to_double, whole
    from hearthline.functions.times import date_from_parts, weather_time

    texts = ["5d", "1f", "0x1p3", "inf", "-Infinity", "abc", "1.7", " 5 ", "1e3", ".5", "5.", "", None, "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(to_double(F.col("t")), whole(F.col("t"))).collect()]
    inf = float("inf")
    want = [None, None, None, inf, -inf, None, 1.7, 5.0, 1000.0, 0.5, 5.0, None, None, None]
    assert [g[0] for g in got] == want
    assert [g[1] for g in got] == [None if w is None or w % 1 or abs(w) == inf else int(w) for w in want]
    month = F.col("t")
    one = F.lit(1)
    dates = df.select(date_from_parts(month, one, one, 2021).alias("d"), weather_time(F.lit(2021), month, one, one).alias("w")).collect()
    assert [r.d is not None for r in dates] == [r.w is not None for r in dates] == [w == 5.0 for w in want]


def test_malformed_csv_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,2\n3,4,5\n6\n"x\ny",7\n')
    assert rows(tables.malformed_records(spark, str(path), multi_line=True), "broken") == [("3,4,5",), ("6",)]
    report = tables.csv_load_report(spark, str(path), multi_line=True).first()
    assert (report["n_rows"], report["n_bad"], report["status"]) == (4, 2, "malformed")
    read = tables.read_table(spark, str(path), multi_line=True)
    assert read.where("b = 7").first()["a"] == "x\ny"
    flags = tmp_path / "b.csv"
    flags.write_text("f,g\nTrue,1\nFalse,\n")
    assert tables.read_table(spark, str(flags)).dtypes == [("f", "boolean"), ("g", "bigint")]


def test_empty_buildings_are_reported(spark):
    from hearthline.operators.objects import presence_checks, required_objects
    from hearthline.sources.buildings import parse_building_objects

    texts = spark.createDataFrame([("empty", "{}"), ("bad", "{"), ("some", '{"Zone": {"Z": {"volume": 1}}}')], "building_id string, text string")
    objs = parse_building_objects(texts)
    assert rows(objs, "building_id", "object_type") == [("empty", None), ("some", "Zone")]
    lacks = required_objects(objs).groupBy("building_id").count().collect()
    assert "empty" in {r["building_id"] for r in lacks}
    assert {r["status"] for r in presence_checks(objs).where("building_id = 'empty'").collect()} == {"missing"}


def test_vectors_with_missing_elements(spark):
    from hearthline.operators.scoring import vector_health

    df = spark.createDataFrame([([1.0, None],), ([3.0, 4.0],), (None,)], "embedding array<double>")
    got = [tuple(r)[1:] for r in vector_health(df).select("embedding", "has_nan", "has_inf", "ok").collect()]
    assert got == [(True, False, False), (False, False, True), (False, False, False)]
