"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.numbers import ref, text_or_null, to_double
from hearthline.operators.columns import prefix_columns
from hearthline.presets import TIME_COLUMNS
from hearthline.sources.numbering import BLOCK, FILE, MARK, number_rows, with_scan_marks

CORRUPT = "_corrupt"


def _typed(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cast the all-text columns named in ``schema``; others stay text."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out = []
    for name in df.columns:
        kind = kinds.get(name)
        if name in keep:
            out.append(ref(name))
        elif kind is None or isinstance(kind, T.StringType):
            out.append(text_or_null(ref(name)).alias(name))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append(to_double(ref(name)).alias(name))
        elif isinstance(kind, T.IntegralType):
            # "5" and "5.0" are both whole numbers to a CSV reader.
            whole = F.trim(ref(name)).try_cast(kind)
            number = to_double(ref(name))
            out.append(F.coalesce(whole, F.when(number == F.floor(number), number).try_cast(kind)).alias(name))
        else:
            out.append(F.trim(text_or_null(ref(name))).try_cast(kind).alias(name))
    return df.select(*out)


def _inferred(df: DataFrame) -> T.StructType:
    """Column types by one aggregate: BIGINT, else DOUBLE, BOOLEAN or STRING."""
    checks = []
    for i, name in enumerate(df.columns):
        given = text_or_null(ref(name))
        number = to_double(given)
        whole = F.trim(given).try_cast("bigint")
        checks.append(
            F.struct(
                F.count(given).alias("given"),
                F.count(number).alias("numbers"),
                F.count(whole).alias("whole"),
                F.count_if(F.lower(F.trim(given)).isin("true", "false")).alias("flags"),
            ).alias(f"c{i}")
        )
    row = df.agg(*checks).first()
    fields = []
    for i, name in enumerate(df.columns):
        found = row[f"c{i}"]
        if found["given"] and found["numbers"] == found["given"]:
            kind = T.LongType() if found["whole"] == found["given"] else T.DoubleType()
        elif not found["given"]:
            kind = T.DoubleType()
        elif found["flags"] == found["given"]:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    fmt: str = "csv",
    position: str | None = None,
    position_start: int = 0,
    multi_line: bool = False,
    rescued: str | None = None,
) -> DataFrame:
    """Scan a table; CSV text is coerced so that NaN, blank and inf come out right.

    With ``position`` a 0-based row number in file order is added. Give a
    ``schema`` for large CSV inputs: without one, types are inferred by an
    extra pass over the file. Quoted line breaks need ``multi_line``, with which a
    file is one task's work. CSV records with too many fields lose the surplus,
    and shorter ones are padded with NULL; ``rescued`` names a column that holds the
    whole text of such a record, from the same scan, so that nothing is lost and
    ``load_report`` needs no scan of its own.
    """
    if fmt == "parquet":
        scan = spark.read.parquet(*([path] if isinstance(path, str) else path))
        return _numbered(scan, position, position_start) if position else scan
    if fmt == "json":
        scan = spark.read.json(path, schema=schema)
        return _numbered(scan, position, position_start) if position else scan
    scan = spark.read.option("header", True).option("multiLine", multi_line).csv(path)
    types = schema if schema is not None else _inferred(scan)
    keep = ()
    if rescued:
        scan = checked_records(spark, path, multi_line, marks=bool(position)).drop("file").withColumnRenamed("broken", rescued)
        keep = (rescued,)
    if position:
        scan = number_rows(scan if rescued else with_scan_marks(scan), position, start=position_start).drop(FILE)
        keep = (*keep, position)
    return _typed(scan, types, keep=keep)


def checked_records(spark: SparkSession, path: str | list[str], multi_line: bool = False, marks: bool = False) -> DataFrame:
    """The records of CSV files as text, with ``file`` and ``broken``, the whole text
    of a record that has more or fewer fields than its header, else NULL."""
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    scan = reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    # Spark asks for a field beside the record's text; this one never gives a value.
    never = F.when(F.length(ref(names[0])) < 0, ref(names[0]))
    broken = F.coalesce(F.col(CORRUPT), never).alias("broken")
    marked = with_scan_marks(scan) if marks else scan
    file = F.col(FILE) if marks else F.col("_metadata.file_path")
    return marked.select(file.alias("file"), *[ref(n) for n in names], broken, *([FILE, BLOCK, MARK] if marks else []))


def malformed_records(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """``(file, broken)`` of the CSV records whose number of fields is wrong."""
    return checked_records(spark, path, multi_line).where(F.col("broken").isNotNull()).select("file", "broken")


def csv_load_report(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """``load_report`` of CSV files; a file without records has no rows and is ok."""
    return load_report(checked_records(spark, path, multi_line).withColumn("_bad", F.col("broken").isNotNull()), "file", "_bad")


def _numbered(scan: DataFrame, position: str, start: int) -> DataFrame:
    return number_rows(with_scan_marks(scan), position, start=start).drop(FILE)


def read_prefixed(
    spark: SparkSession,
    path: str | list[str],
    prefix: str | None = None,
    keep: tuple[str, ...] = TIME_COLUMNS,
    schema: T.StructType | None = None,
    fmt: str = "csv",
    position: str | None = None,
) -> DataFrame | None:
    """``read_table`` with a prefix on all but the time columns; None if absent."""
    from pyspark.errors import AnalysisException

    try:
        df = read_table(spark, path, schema, fmt, position)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return prefix_columns(df, prefix, keep + ((position,) if position else ())) if prefix else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> None:
    """Sink as CSV with header, JSON lines or parquet."""
    if len({c.lower() for c in df.columns}) != len(df.columns):
        raise ValueError(f"duplicate column names: {sorted(df.columns)}")
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(fmt).save(path)


def header_conformance(spark: SparkSession, path: str | list[str], expected: Sequence[str]) -> DataFrame:
    """Per CSV file and expected column: ``file``, ``column``, ``status``, ``place`` (from 1, NULL if missing).

    Looks at the header line of every file, in tasks; an empty file has no header and
    no rows here.
    """
    lines = with_scan_marks(spark.read.text(path)).where(F.col(BLOCK) == 0)
    heads = lines.groupBy(FILE).agg(F.min_by("value", MARK).alias("head"))
    names = F.transform(F.split("head", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda n: F.regexp_replace(F.trim(n), '^"|"$', ""))
    listed = heads.select(F.col(FILE).alias("file"), names.alias("names"), F.explode(F.array(*[F.lit(c) for c in expected])).alias("column"))
    place = F.array_position("names", F.col("column"))
    return listed.select(
        "file", "column", F.when(place > 0, "present").otherwise("missing").alias("status"), F.when(place > 0, place).alias("place")
    )


def load_report(df: DataFrame, source: str, broken: str) -> DataFrame:
    """Per source: rows read, rows that could not be read, and a status.

    ``broken`` names a boolean column that marks unreadable rows.
    """
    bad = F.count_if(ref(broken))
    return df.groupBy(ref(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad.alias("n_bad"),
        F.when(bad == 0, "ok").otherwise("malformed").alias("status"),
    )


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as ``(file, line_no, value)``, line numbers from 1."""
    scan = spark.read.text(path)
    lines = number_rows(with_scan_marks(scan), "line_no", per_file=True, start=1)
    return lines.select(F.col(FILE).alias("file"), "line_no", "value")
