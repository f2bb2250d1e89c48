"""Arrow columns as fixed-width bytes, and what writers must know of a DataFrame's values before they start."""

from __future__ import annotations

import warnings
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FRACTIONAL, INTEGRAL


def plain(df: DataFrame) -> DataFrame:
    """Only types that files have: decimals as doubles, timestamps without zone; others are an error."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif not isinstance(f.dataType, (*FRACTIONAL, *INTEGRAL, T.BooleanType, T.StringType, T.DateType, T.TimestampNTZType, T.TimeType)):
            raise TypeError(f"column {f.name!r} of type {f.dataType.simpleString()} can't be written")
        out.append(c)
    return df.select(*out)


def stats(df: DataFrame) -> dict:
    """In one job: rows, and by column the number range or the widest text, and whether a text needs a long string."""
    asks = []
    for k, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            asks += [F.max(F.octet_length(c)).alias(f"a{k}"), F.max(c.rlike(r"\x00| $")).alias(f"b{k}")]
        elif isinstance(f.dataType, INTEGRAL):
            asks += [F.min(c).alias(f"a{k}"), F.max(c).alias(f"b{k}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *asks).first()
    return {"rows": row["n"]} | {f.name: (row[f"a{k}"], row[f"b{k}"]) for k, f in enumerate(df.schema.fields) if f"a{k}" in row}


def numbers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column as numbers, and which are null: dates in days, timestamps and times in microseconds."""
    null = np.asarray(pc.is_null(a, nan_is_null=pa.types.is_floating(a.type)))
    if pa.types.is_date32(a.type):
        a = a.cast(pa.int32())
    elif pa.types.is_timestamp(a.type):
        a = a.cast(pa.timestamp("us")).cast(pa.int64())
    elif pa.types.is_time64(a.type):
        a = pc.divide(a.cast(pa.time64("ns")).cast(pa.int64()), 1000)
    elif pa.types.is_boolean(a.type):
        a = a.cast(pa.int8())
    return np.asarray(pc.fill_null(a, 0)), null


def padded(a: pa.Array, width: int, fill: bytes) -> np.ndarray:
    """Texts in UTF-8 as rows of ``width`` bytes; nulls are empty."""
    items = [b"" if b is None else b for b in a.cast(pa.binary()).to_pylist()]
    if too := [b for b in items if len(b) > width]:
        raise ValueError(f"a text of {len(too[0])} bytes doesn't fit {width}")
    return np.frombuffer(b"".join(b.ljust(width, fill) for b in items), np.uint8).reshape(len(items), width)


def unique_names(names: list[str], bad: str, most: int, lead: str, reserved: frozenset[str] = frozenset(), fold: bool = False) -> list[str]:
    """Names without bad characters, not starting with a digit, at most ``most`` long, all different."""
    out, seen = [], set()
    for n in names:
        x = re.sub(bad, "_" if lead == "_" else "", n) or lead
        if not re.match(r"[A-Za-z_]|[^\x00-\x7F]", x) or x.lower() in reserved:
            x = lead + x
        x, k = x[:most], 1
        base = x
        key = (lambda s: s.lower()) if fold else (lambda s: s)
        while key(x) in seen:
            x = f"{base[: most - len(str(k)) - 1]}_{k}"
            k += 1
        seen.add(key(x))
        out.append(x)
    return out


def fitted(text: str | None, n: int, what: str) -> bytes:
    """A text's UTF-8 bytes, cut at a character to at most ``n`` with a warning: the format has no room for more."""
    b = (text or "").encode()
    if len(b) > n:
        warnings.warn(f"{what} has {len(b)} bytes, the format has room for {n}: it is cut", stacklevel=3)
        b = b[:n].decode("utf-8", "ignore").encode()
    return b
