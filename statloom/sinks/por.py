"""Writing SPSS portable files. Lines break after 80 characters wherever a value stands, so one task writes a file's rows."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.base import SPSS_SECONDS
from ..sources.por import CHARACTERS, to_base30
from .encode import fitted, numbers, plain, stats
from .parts import save

VANITY = ("ASCII SPSS PORT FILE".ljust(40) * 5)[:200]


def _string(s: str) -> str:
    s = s.encode().decode("latin-1") or " "
    return to_base30(len(s)) + s


def _values(a: pa.Array, kind: T.DataType) -> list[str]:
    if isinstance(kind, T.StringType):
        return [_string(s or "") for s in a.to_pylist()]
    v, null = numbers(a)
    if isinstance(kind, T.DateType):
        v = v.astype(np.int64) * 86_400 + SPSS_SECONDS
    elif isinstance(kind, T.TimestampNTZType):
        v = v / 1e6 + SPSS_SECONDS
    elif isinstance(kind, T.TimeType):
        v = v / 1e6
    return ["*." if n else to_base30(x) for x, n in zip(v.astype(float).tolist(), null.tolist(), strict=True)]


def write_por(df: DataFrame, path: str, file_label: str = "", variable_labels: dict | None = None, each: str | None = None) -> None:
    """Write ``df``, in its order; names are upper-cased, over 8 characters or equal but for case is an error."""
    df = plain(df)
    for n in df.columns:
        if len(n) > 8:
            raise ValueError(f"{n!r} has more than 8 characters")
    if len({n.upper() for n in df.columns}) < len(df.columns):
        raise ValueError("names differ only in case")
    seen, kinds = stats(df), [f.dataType for f in df.schema.fields]
    head = "A" + _string("20000101") + _string("000000") + "1" + _string("statloom") + "4" + to_base30(len(kinds)) + "5" + to_base30(11)
    for f in df.schema.fields:
        width = max(1, min(255, seen[f.name][0] or 1)) if isinstance(f.dataType, T.StringType) else 0
        fmt = (1, width, 0) if width else (20, 11, 0) if isinstance(f.dataType, T.DateType) else (22, 20, 0) if isinstance(f.dataType, T.TimestampNTZType) else (21, 8, 0) if isinstance(f.dataType, T.TimeType) else (5, 8, 2)
        head += "7" + to_base30(width) + _string(f.name.upper()) + "".join(to_base30(x) for x in fmt * 2)
        if label := (variable_labels or {}).get(f.name):
            head += "C" + _string(label)
    table = "\0" * 64 + CHARACTERS
    first = VANITY[:60] + fitted(file_label, 20, "the file label").decode().ljust(20) + VANITY[80:] + "".join(c if c != "\0" else "0" for c in table).ljust(256, "0") + "SPSSPORT" + head + "F"

    def encode(batch, state):
        cols = [_values(batch.column(k), kind) for k, kind in enumerate(kinds)]
        text = state.pop("rest", first) + "".join(x for row in zip(*cols, strict=True) for x in row)
        cut = len(text) // 80 * 80
        state["rest"] = text[cut:]
        return "".join(text[a : a + 80] + "\r\n" for a in range(0, cut, 80)).encode("latin-1")

    def finish(parts, out) -> None:
        name = parts.found[0][1] if parts.found else None
        rest = first
        if name and parts.rows:
            parts.into(out)
            with open(os.path.join(parts.folder, name + ".more"), "rb") as f:
                tail = f.read().decode("latin-1")
            rest = tail[tail.rindex("\1") + 1 :]
        text = rest + "Z" * (80 - len(rest) % 80)
        out.write("".join(text[a : a + 80] + "\r\n" for a in range(0, len(text), 80)).encode("latin-1"))

    save(df if each else df.coalesce(1), path, _closing(encode), finish, each)


def _closing(run):
    """What a batch leaves unfinished goes to the side file behind a mark; the last one counts."""

    def encode(batch, state):
        out = run(batch, state)
        return out, ("\1" + state["rest"]).encode("latin-1")

    return encode
