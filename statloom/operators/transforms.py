"""What is done to a scan after decoding, as Column expressions: labels, informative nulls, compression, casts, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FRACTIONAL, INTEGRAL, number_text
from ..options import Compress, InformativeNulls

#: A map is searched from its start for every row.
MAP_LIMIT = 64


def labelled(df: DataFrame, labels: dict[str, dict], host_text: bool = False) -> DataFrame:
    """Columns with labels as text: a code's label, or the code. host_text: codes as Spark casts them, not shortened.

    Up to ``MAP_LIMIT`` labels are a map in the plan; more are a small table that is joined.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    chosen = {}
    for name, own in labels.items():
        if name not in kinds or not own:
            continue
        c, kind = F.col(f"`{name}`"), kinds[name]
        key = "string" if isinstance(kind, T.StringType) else "double"
        plain = c.cast("string") if host_text else number_text(c, kind)
        pairs = [(str(k) if key == "string" else float(k), v) for k, v in own.items() if key == "string" or _number(k)]
        if not pairs:
            continue
        if len(pairs) <= MAP_LIMIT:
            found = F.element_at(F.create_map(*[F.lit(x) for p in dict(pairs).items() for x in p]), c.cast(key))
        else:
            table = df.sparkSession.createDataFrame(list(dict(pairs).items()), f"_code_{name} {key}, _label_{name} string")
            df = df.join(F.broadcast(table), c.cast(key) == F.col(f"_code_{name}"), "left")
            found = F.col(f"_label_{name}")
        chosen[name] = F.when(c.isNotNull(), F.coalesce(found, plain)).alias(name)
    return df.select(*[chosen.get(n, F.col(f"`{n}`")) for n in kinds])


def _number(x) -> bool:
    try:
        float(x)
    except (TypeError, ValueError):
        return False
    return True


def informative(df: DataFrame, opts: InformativeNulls, tags: dict[str, str]) -> DataFrame:
    """Shape columns with tags (column to its tag column) as ``opts.mode`` asks; tag columns go."""
    out: list[Column] = []
    taken = {c for c in df.columns if c not in tags.values()}
    for name in df.columns:
        if name in tags.values():
            continue
        c = F.col(f"`{name}`")
        if name not in tags:
            out.append(c)
            continue
        tag = F.col(f"`{tags[name]}`")
        if opts.mode == "separate_column":
            if name + opts.suffix in taken:
                raise ValueError(f"the column {name + opts.suffix!r} for missing codes exists already")
            out += [c, tag.alias(name + opts.suffix)]
        elif opts.mode == "struct":
            if name == "null_indicator":
                raise ValueError("a column named 'null_indicator' can't be a struct with one")
            out.append(F.struct(c.alias(name), tag.alias("null_indicator")).alias(name))
        else:
            out.append(F.coalesce(c.cast("string"), tag).alias(name))
    return df.select(*out)


def overridden(df: DataFrame, overrides: dict, strict: bool = True) -> DataFrame:
    """Columns cast to given types; unknown names are ignored. Strict casts raise where a value doesn't fit."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        want = overrides.get(f.name)
        if want is None:
            out.append(c)
            continue
        want = T._parse_datatype_string(want) if isinstance(want, str) else want
        cast = (lambda x, t: x.cast(t)) if strict else (lambda x, t: x.try_cast(t))
        if isinstance(f.dataType, T.StructType) and not isinstance(want, T.StructType) and "null_indicator" in f.dataType.names:
            out.append(F.when(c.isNotNull(), F.struct(cast(c[f.name], want).alias(f.name), c["null_indicator"].alias("null_indicator"))).alias(f.name))
        else:
            out.append(cast(c, want).alias(f.name))
    return df.select(*out)


#: The ranges of integer types, and those of Stata's, whose largest values stand for missing ones.
RANGES = (("byte", -128, 127), ("short", -32768, 32767), ("int", -2147483648, 2147483647))
STATA_RANGES = (("byte", -127, 100), ("short", -32767, 32740), ("int", -2147483647, 2147483620))


def compressed(df: DataFrame, opts: Compress, stata: bool = False) -> DataFrame:
    """Narrowed types, decided in one pass over all rows or the first ``infer_compress_length``; values that don't fit
    the types (beyond those rows) become null."""
    plan = narrowed(df, opts, stata)
    return df.select(*[c if (t := plan.get(n)) is None else _apply(c, t).alias(n) for n in df.columns for c in [F.col(f"`{n}`")]])


def _apply(c: Column, target: tuple[str, bool]) -> Column:
    kind, text = target
    number = F.trim(c).try_cast("double") if text else c
    if kind == "boolean" and not text:
        return c.try_cast("boolean")
    if kind in ("boolean", "byte", "short", "int"):
        whole = F.when(number == F.floor(number), number) if text else number
        return F.when(whole.isin(0, 1), whole == 1) if kind == "boolean" else whole.try_cast(kind)
    return number.try_cast(kind)


def narrowed(df: DataFrame, opts: Compress, stata: bool = False) -> dict[str, tuple[str, bool]]:
    """Column to (new type, whether it was text) for the columns that change."""
    asks, fields = [], [f for f in df.schema.fields if opts.cols is None or f.name in opts.cols]
    for k, f in enumerate(fields):
        c, kind = F.col(f"`{f.name}`"), f.dataType
        asks.append(F.count(c).alias(f"n{k}"))
        number = c if isinstance(kind, (*FRACTIONAL, *INTEGRAL)) else None
        if isinstance(kind, T.TimestampNTZType | T.TimestampType):
            asks.append(F.bool_and(c == F.date_trunc("day", c).cast(kind)).alias(f"midnight{k}"))
        elif isinstance(kind, T.StringType):
            full = F.when(F.trim(c) != "", F.trim(c))
            number = full.try_cast("double")
            asks += [F.count_if(full.isNotNull() & number.isNull()).alias(f"bad{k}"), F.count(full).alias(f"full{k}")]
        if number is not None:
            asks += [F.min(number).alias(f"low{k}"), F.max(number).alias(f"high{k}"), F.coalesce(F.bool_and(number == F.floor(number)), F.lit(True)).alias(f"whole{k}")]
    some = df.limit(opts.infer_compress_length) if opts.infer_compress_length else df
    seen = some.agg(F.count(F.lit(1)).alias("rows"), *asks).first()
    out = {}
    for k, f in enumerate(fields):
        kind, text = f.dataType, isinstance(f.dataType, T.StringType)
        if isinstance(kind, T.TimestampNTZType | T.TimestampType) and opts.datetime_to_date and seen[f"midnight{k}"]:
            out[f.name] = ("date", False)
        elif text and not (opts.string_to_numeric and seen[f"full{k}"] and not seen[f"bad{k}"]):
            if seen["rows"] and not seen[f"n{k}"]:
                out[f.name] = ("boolean", False)
        elif seen["rows"] and not seen[f"n{k}"]:
            out[f.name] = ("boolean", False)
        elif text or opts.compress_numeric and isinstance(kind, (*FRACTIONAL, *INTEGRAL)):
            low, high, whole = (seen[f"{x}{k}"] for x in ("low", "high", "whole"))
            if text and not opts.compress_numeric:
                out[f.name] = ("double", True)
            elif whole and low is not None:
                if 0 <= low and high <= 1:
                    out[f.name] = ("boolean", text)
                else:
                    fit = next((t for t, a, b in (STATA_RANGES if stata else RANGES) if a <= low and high <= b), None)
                    out[f.name] = (fit or ("double" if text or isinstance(kind, FRACTIONAL) else "bigint"), text)
            else:
                out[f.name] = ("double", text)
    return out
