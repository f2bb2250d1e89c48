"""Writing Stata .dta files, release 118, or 119 for more than 32,767 variables."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import options
from ..functions.text import INTEGRAL
from ..operators.transforms import STATA_RANGES, compressed
from .encode import fitted, numbers, padded, plain, stats, unique_names
from .parts import save

DAYS, MS = 3_653, 3_653 * 86_400_000
#: Names that Stata keeps for itself.
RESERVED = frozenset("aggregate array boolean break byte case catch class colvector complex const continue default delegate delete do double else eltypedef end enum explicit export external float for friend function global goto if in inline int local long namespace new null pragma protected quad rowvector short strl typedef typename using vector version virtual _all _b _coef _cons _n _pi _pred _rc _skip _se with".split())
CODES = {"byte": (65530, "i1", 101), "int": (65529, "<i2", 32741), "long": (65528, "<i4", 2147483621), "float": (65527, "<f4", None), "double": (65526, "<f8", None)}
FORMATS = {"byte": "%8.0g", "int": "%8.0g", "long": "%12.0g", "float": "%9.0g", "double": "%10.0g"}
MOST_STR = 2045


class Plan:
    """How one column is stored."""

    def __init__(self, field, seen, name: str):
        self.source, self.name, self.kind, self.labels = field.name, name, field.dataType, {}
        self.format, self.storage, self.width = "", "", 8
        if isinstance(self.kind, T.StringType):
            widest, odd = seen[field.name]
            self.storage = "strL" if (widest or 0) > MOST_STR or odd else "str"
            self.width = 8 if self.storage == "strL" else max(1, widest or 0)
            self.format = "%9s" if self.storage == "strL" else f"%{self.width}s"
            return
        if isinstance(self.kind, T.DateType):
            self.storage, self.format = "long", "%td"
        elif isinstance(self.kind, T.TimestampNTZType | T.TimeType):
            self.storage, self.format = "double", "%tc" if isinstance(self.kind, T.TimestampNTZType) else "%tcHH:MM:SS"
        elif isinstance(self.kind, T.BooleanType):
            self.storage = "byte"
        elif isinstance(self.kind, T.FloatType):
            self.storage = "float"
        elif isinstance(self.kind, INTEGRAL):
            low, high = seen[field.name]
            fits = [n for n, (_, a, b) in zip(("byte", "int", "long"), STATA_RANGES, strict=True) if low is None or a <= low and high <= b]
            least = {"byte": 0, "short": 1}.get(self.kind.typeName().replace("tinyint", "byte").replace("smallint", "short"), 2) if low is None else 0
            self.storage = fits[min(least, len(fits) - 1)] if fits else "double"
        else:
            self.storage = "double"
        self.format = self.format or FORMATS[self.storage]
        self.width = np.dtype(CODES[self.storage][1]).itemsize

    @property
    def code(self) -> int:
        return 32768 if self.storage == "strL" else self.width if self.storage == "str" else CODES[self.storage][0]

    def bytes(self, a: pa.Array) -> np.ndarray:
        v, null = numbers(a)
        if isinstance(self.kind, T.DateType):
            v = v.astype(np.int64) + DAYS
        elif isinstance(self.kind, T.TimestampNTZType):
            v = v / 1000 + MS
        elif isinstance(self.kind, T.TimeType):
            v = v / 1000
        _, dtype, missing = CODES[self.storage]
        if missing is None:
            v = v.astype(dtype)
            bad = null | ~np.isfinite(v)
            top = 8.988465674311579e307 if self.storage == "double" else 1.7014117331926443e38
            if (np.abs(v[~bad]) > top).any():
                raise ValueError(f"column {self.source!r} holds a number out of Stata's range")
            v = np.where(bad, np.array(0x7FE0000000000000 if self.storage == "double" else 0x7F000000, "<u8" if self.storage == "double" else "<u4").view(dtype), v)
        else:
            if len(v) and (v[~null] >= missing).any():
                raise ValueError(f"column {self.source!r} holds a number out of Stata's range")
            v = np.where(null, missing, v)
        return np.ascontiguousarray(v.astype(dtype)).view(np.uint8).reshape(len(v), self.width)


def _encoder(plans: list[Plan]):
    def encode(batch: pa.RecordBatch, state: dict) -> tuple[bytes, bytes]:
        columns, more = [], []
        for k, p in enumerate(plans):
            a = batch.column(k)
            if p.storage == "str":
                columns.append(padded(a, p.width, b"\0"))
            elif p.storage == "strL":
                refs = np.zeros(len(a), "<u8")
                for i, b in enumerate(a.cast(pa.binary()).to_pylist()):
                    if b:
                        state["long"] = o = state.get("long", 0) + 1
                        o += state["part"] << 24
                        refs[i] = k + 1 | o << state["bits"]
                        more.append(b"GSO" + struct.pack("<IQBI", k + 1, o, 0x82, len(b) + 1) + b + b"\0")
                columns.append(refs.view(np.uint8).reshape(-1, 8))
            else:
                columns.append(p.bytes(a))
        return np.concatenate(columns, axis=1).tobytes() if columns else b"", b"".join(more)

    return encode


def _text(s: str, n: int) -> bytes:
    return fitted(s, n - 1, f"{(s or '')[:20]!r}...").ljust(n, b"\0")


def _labels(name: str, labels: dict[int, str]) -> bytes:
    texts, at, blob = [], [], b""
    for code in sorted(labels):
        at.append(len(blob))
        texts.append(code)
        blob += fitted(str(labels[code]), 32_000, f"the label of {code} in {name!r}") + b"\0"
    n = len(texts)
    body = struct.pack("<II", n, len(blob)) + np.array(at, "<u4").tobytes() + np.array(texts, "<i4").tobytes() + blob
    return b"<lbl>" + struct.pack("<I", len(body)) + _text(name, 129) + bytes(3) + body + b"</lbl>"


def write_dta(df: DataFrame, path: str, value_labels: dict | None = None, variable_labels: dict | None = None, variable_format: dict | None = None, compress=None, data_label: str = "", threads=None, each: str | None = None) -> None:
    """Write ``df``, in its order. Names are made valid for Stata; integers take the narrowest type that their range
    needs, or double; texts over 2,045 bytes, or with NULs or trailing spaces, become long strings; null texts are empty."""
    for f in (variable_format or {}).values():
        if not f or not f.startswith("%") or len(f) >= 57:
            raise ValueError(f"{f!r} is no Stata format")
    df = plain(df)
    if narrow := options.compress(compress):
        df = compressed(df, narrow, stata=True)
    names = unique_names(df.columns, r"[^A-Za-z0-9_]", 32, "_", RESERVED)
    seen = stats(df)
    plans = [Plan(f, seen, n) for f, n in zip(df.schema.fields, names, strict=True)]
    by = {p.source: p for p in plans}
    for c, own in (value_labels or {}).items():
        if c not in by:
            continue
        if by[c].storage in ("str", "strL"):
            raise ValueError(f"value labels of the text column {c!r} can't be written")
        whole = {}
        for k, v in own.items():
            if float(k) != int(float(k)) or not -2147483647 <= int(float(k)) <= 2147483620:
                raise ValueError(f"value label code {k!r} is no integer that Stata can label")
            whole[int(float(k))] = v
        by[c].labels = whole
    for c, f in (variable_format or {}).items():
        if c in by:
            by[c].format = f
    release = 119 if len(plans) > 32_767 else 118
    bits = 24 if release == 119 else 16
    inner = _encoder(plans)

    def encode(batch, state):
        state["bits"] = bits
        return inner(batch, state)

    def finish(parts, out) -> None:
        head = f"<stata_dta><header><release>{release}</release><byteorder>LSF</byteorder><K>".encode() + struct.pack("<I" if release == 119 else "<H", len(plans)) + b"</K><N>" + struct.pack("<Q", parts.rows) + b"</N><label>"
        label = fitted(data_label, 320, "the data label")
        head += struct.pack("<H", len(label)) + label + b"</label><timestamp>\0</timestamp></header>"
        out.write(head)
        at = [0, out.tell()]
        out.write(b"<map>" + bytes(8 * 14) + b"</map>")

        def section(name: str, body: bytes) -> None:
            at.append(out.tell())
            out.write(f"<{name}>".encode() + body + f"</{name}>".encode())

        section("variable_types", np.array([p.code for p in plans], "<u2").tobytes())
        section("varnames", b"".join(_text(p.name, 129) for p in plans))
        section("sortlist", bytes((4 if release == 119 else 2) * (len(plans) + 1)))
        section("formats", b"".join(_text(p.format, 57) for p in plans))
        section("value_label_names", b"".join(_text(p.name if p.labels else "", 129) for p in plans))
        section("variable_labels", b"".join(_text((variable_labels or {}).get(p.source) or "", 321) for p in plans))
        section("characteristics", b"")
        at.append(out.tell())
        out.write(b"<data>")
        parts.into(out)
        out.write(b"</data>")
        at.append(out.tell())
        out.write(b"<strls>")
        parts.into(out, more=True)
        out.write(b"</strls>")
        section("value_labels", b"".join(_labels(p.name, p.labels) for p in plans if p.labels))
        at.append(out.tell())
        out.write(b"</stata_dta>")
        at.append(out.tell())
        out.seek(at[1] + 5)
        out.write(np.array(at, "<u8").tobytes())

    save(df, path, encode, finish, each)
