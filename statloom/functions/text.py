"""Column expressions for texts and numbers in statistical files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def number_text(c: Column, kind: T.DataType) -> Column:
    """A code without a label as text: whole numbers without a point."""
    if not isinstance(kind, FRACTIONAL):
        return c.cast("string")
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def trimmed(c: Column) -> Column:
    """Without trailing spaces and NULs, and cut at the first NUL."""
    return F.substring_index(F.regexp_replace(c, r"[ \x00]+$", ""), "\x00", 1)


def clock_text(micros: Column) -> Column:
    """Microseconds as HH:MM:SS, with a fraction where there is one; beyond a day the hours go on."""
    a = F.abs(micros)
    s = F.floor(a / 1_000_000)
    whole = F.format_string("%s%02d:%02d:%02d", F.when(micros < 0, "-").otherwise(""), F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    part = F.rtrim(F.format_string("%06d", a % 1_000_000), F.lit("0"))
    return F.when(micros.isNotNull(), F.when(a % 1_000_000 == 0, whole).otherwise(F.concat(whole, F.lit("."), part)))


def sas_days(c: Column) -> Column:
    return F.datediff(c, F.lit("1960-01-01").cast("date"))


def sas_seconds(c: Column) -> Column:
    """Seconds since 1960 of a timestamp without time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1960-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    return micros / F.lit(1_000_000)
