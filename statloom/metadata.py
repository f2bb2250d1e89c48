"""Metadata of statistical files: dictionaries, a frame with one row a variable, and their way into writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "name string, label string, value_label_codes array<string>, value_label_labels array<string>, format string, format_type string, format_width int, format_decimals int, measure string, display_width int, alignment string, string_width_bytes int"
FIELDS = [x.split()[0] for x in FRAME.split(", ")]


def spss_format(text: str | None) -> tuple[str | None, int | None, int | None]:
    """(type, width, decimals) of a format such as A20 or F10.2; nothing for others."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)(?:\.(\d+))?", text or "")
    return (m[1].upper(), int(m[2]), int(m[3]) if m[3] else 0) if m else (None, None, None)


def _code(k) -> str:
    return str(int(k)) if isinstance(k, float) and k == int(k) else str(k)


def _variables(meta: dict) -> list[dict]:
    return meta.get("variables") or meta.get("columns") or []


def rows(meta: dict) -> list[tuple]:
    """The frame's rows; label codes in the order of the codes."""
    out = []
    for v in _variables(meta):
        labels = v.get("value_labels") or {}
        keys = sorted(labels, key=lambda k: (isinstance(k, str), k))
        kind, width, decimals = spss_format(v.get("format"))
        out.append((v["name"], v.get("label"), [_code(k) for k in keys] if keys else None, [labels[k] for k in keys] if keys else None, v.get("format"), kind, width, decimals, v.get("measure"), v.get("display_width"), v.get("alignment"), v.get("string_width_bytes")))
    return out


def frame(spark: SparkSession, meta: dict) -> DataFrame:
    return spark.createDataFrame(rows(meta), FRAME)


def column_info(meta: dict) -> list[dict]:
    return [dict(v) for v in _variables(meta)]


def file_info(meta: dict) -> dict:
    return {k: v for k, v in meta.items() if k not in ("variables", "columns")}


def coerced(labels: dict) -> dict:
    """Label codes as numbers where they are: "1.0" is 1; other keys stay."""
    out = {}
    for k, v in labels.items():
        try:
            n = float(k)
            out[int(n) if n == int(n) else n] = v
        except (TypeError, ValueError, OverflowError):
            out[k] = v
    return out


def from_kwargs(spark: SparkSession, variable_labels=None, value_labels=None, variable_format=None, variable_measure=None, variable_display_width=None, variable_alignment=None) -> DataFrame:
    """A frame of what a writer's arguments say, by name."""
    given = [variable_labels or {}, value_labels or {}, variable_format or {}, variable_measure or {}, variable_display_width or {}, variable_alignment or {}]
    names = sorted(set().union(*given))
    out = []
    for n in names:
        label, own, fmt, measure, width, align = (g.get(n) for g in given)
        own = coerced(own or {})
        kind, w, d = spss_format(fmt)
        out.append((n, label, [_code(k) for k in own] or None, list(own.values()) or None, fmt, kind, w, d, measure, width, align, None))
    return spark.createDataFrame(out, FRAME)


def merged(base: DataFrame, over: DataFrame) -> DataFrame:
    """Both frames by name; where ``over`` says something, it wins. Names are unique in each."""
    a, b = base.alias("a"), over.alias("b")
    both = a.join(b, F.col("a.name") == F.col("b.name"), "full_outer")
    return both.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in FIELDS])


def to_kwargs(table: DataFrame, keep: list[str]) -> dict:
    """Writer arguments from a frame, for the columns ``keep``; one row a variable comes to the driver."""
    out: dict[str, dict] = {k: {} for k in ("variable_labels", "value_labels", "variable_format", "variable_measure", "variable_display_width", "variable_alignment")}
    for r in table.filter(F.col("name").isin(keep)).collect():
        n = r["name"]
        for key, value in (("variable_labels", r["label"]), ("variable_format", r["format"]), ("variable_measure", r["measure"]), ("variable_display_width", r["display_width"]), ("variable_alignment", r["alignment"])):
            if value is not None:
                out[key][n] = value
        if r["value_label_codes"]:
            out["value_labels"][n] = coerced(dict(zip(r["value_label_codes"], r["value_label_labels"], strict=True)))
    return out
