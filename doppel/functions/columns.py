"""Typed views of a column that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY_TYPES = {"name", "email", "phone", "address", "text", "uuid", "id"}
NULL_CATEGORY = "__NULL__"

NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its plain name, dots and spaces included."""
    return F.col(quoted(name))


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 as a double, for any date or timestamp type or ISO text."""
    kind = df.schema[name].dataType
    c = quoted(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(c)).cast("double") / F.lit(1e6)
    if isinstance(kind, T.StringType):
        c = f"try_cast({c} as timestamp_ntz)"
    elif not isinstance(kind, T.TimestampNTZType):
        c = f"cast({c} as timestamp_ntz)"
    return F.expr(f"cast(timestampdiff(MICROSECOND, {_EPOCH}, {c}) as double) / 1e6D")


def from_epoch(seconds: Column) -> Column:
    """Timestamp without zone from whole or fractional epoch seconds."""
    whole = F.floor(seconds)
    micros = (seconds - whole).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(secs=whole.cast("decimal(18,6)") + micros)


def numeric(df: DataFrame, name: str) -> Column:
    """The column as a double for modelling: dates as epoch seconds, NaN as null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_seconds(df, name)
    c = col(name)
    if isinstance(kind, T.StringType):
        # The pattern spares non-numbers the cast, which fails by way of an exception.
        c = F.when(c.rlike(NUMBER_TEXT), F.expr(f"try_cast({quoted(name)} as double)"))
    else:
        c = c.cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.StringType)):
        c = F.when(~F.isnan(c), c)
    return c + F.lit(0.0)  # folds -0.0 into 0.0, so equal values group together


def category(name: str) -> Column:
    """The column as a category label; null is a category of its own."""
    return F.coalesce(col(name).cast("string"), F.lit(NULL_CATEGORY))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
