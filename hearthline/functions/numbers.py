"""Numeric expressions: missing values, coercion, grouping keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a CSV reader takes as missing.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

def quoted(name: str) -> str:
    """Backtick a column name, so dots, colons and brackets are plain text."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quoted(name))


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, since NaN means missing here."""
    if is_fractional(df, name):
        return F.nanvl(ref(name), F.lit(None).cast("double"))
    return ref(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if is_fractional(df, name):
        return ref(name).isNull() | F.isnan(ref(name))
    return ref(name).isNull()


def text_or_null(c: Column) -> Column:
    """CSV text with the missing tokens turned into NULL."""
    return F.when(~F.trim(c).isin(*MISSING_TOKENS), c)


#: What counts as a number in a text: digits with an optional exponent, or infinity.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))$"


def to_double(c: Column) -> Column:
    """Text to DOUBLE; blank, unreadable and NaN text become NULL, inf is kept.

    Forms that only a program's source has (``5d``, ``0x1p3``) are unreadable.
    """
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def whole(c: Column) -> Column:
    """A value as INT if it is a whole number, else NULL; never an error."""
    number = to_double(c)
    return F.when(number == F.floor(number), number.try_cast("int"))


PACKED = "_hl_key"


def packed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct, which joins and groups by NULL keys as well.

    Without keys it is a constant, the key of the only group.
    """
    return df.withColumn(PACKED, F.struct(*[ref(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")))


def unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{PACKED}.{quoted(k)}").alias(k) for k in keys]
