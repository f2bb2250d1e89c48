"""Writing SAS transport files, versions 5 and 8."""

from __future__ import annotations

import re
import struct
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.xpt import CARD, ieee_to_ibm
from .encode import fitted, numbers, padded, plain, stats
from .parts import save

DAYS = 3_653


def _card(s: str | bytes) -> bytes:
    b = s.encode() if isinstance(s, str) else s
    if len(b) > CARD:
        raise ValueError("a header card is too long")
    return b.ljust(CARD)


def _fill(b: bytes) -> bytes:
    return b.ljust(-(-len(b) // CARD) * CARD)


def _numbers(a: pa.Array, kind: T.DataType, width: int) -> np.ndarray:
    v, null = numbers(a)
    if isinstance(kind, T.DateType):
        v = v.astype(np.int64) + DAYS
    elif isinstance(kind, T.TimestampNTZType):
        v = v / 1e6 + DAYS * 86_400
    elif isinstance(kind, T.TimeType):
        v = v / 1e6
    return ieee_to_ibm(v, null)[:, :width]


def write_xpt(df: DataFrame, path: str, version: int = 8, table_name: str | None = None, file_label: str = "", variable_labels: dict | None = None, variable_format: dict | None = None, storage_widths: dict | None = None, each: str | None = None) -> None:
    """Write ``df``, in its order. Names over 8 (version 5) or 32 characters, or equal but for case, are an error; numbers
    take 3 to 8 bytes, texts the width of their widest value."""
    if version not in (5, 8):
        raise ValueError("version must be 5 or 8")
    most = 8 if version == 5 else 32
    df = plain(df)
    for n in df.columns:
        if len(n) > most or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n):
            raise ValueError(f"{n!r} is no name for a version {version} transport file")
    if len({n.upper() for n in df.columns}) < len(df.columns):
        raise ValueError("names differ only in case")
    seen, labels, formats = stats(df), variable_labels or {}, variable_format or {}
    fields = []
    for f in df.schema.fields:
        text = isinstance(f.dataType, T.StringType)
        width = max(1, seen[f.name][0] or 0) if text else min(8, max(3, (storage_widths or {}).get(f.name, 8)))
        default = "DATE9." if isinstance(f.dataType, T.DateType) else "DATETIME20." if isinstance(f.dataType, T.TimestampNTZType) else "TIME8." if isinstance(f.dataType, T.TimeType) else ""
        m = re.fullmatch(r"(\$?[A-Za-z_][A-Za-z0-9_]*?|\$?)(\d*)(?:\.(\d*))?", formats.get(f.name) or default)
        if not m:
            raise ValueError(f"{formats[f.name]!r} is no SAS format")
        fields.append((f.name, f.dataType, text, width, m[1].upper(), int(m[2] or 0), int(m[3] or 0)))

    def encode(batch, state):
        cols = [padded(batch.column(k), w, b" ") if text else _numbers(batch.column(k), kind, w) for k, (_, kind, text, w, *_) in enumerate(fields)]
        return np.concatenate(cols, axis=1).tobytes(), b""

    now = time.strftime("%d%b%y:%H:%M:%S", time.gmtime()).upper()
    table = fitted(table_name or "DATASET", most, "the table's name").decode()
    lib, mem, des, obs = ("LIBRARY", "MEMBER ", "DSCRPTR", "OBS    ") if version == 5 else ("LIBV8  ", "MEMBV8 ", "DSCPTV8", "OBSV8  ")
    head = lambda what, tail="0" * 30: _card(f"HEADER RECORD*******{what.ljust(8)}HEADER RECORD!!!!!!!{tail}  ")
    out_head = head(lib) + _card(f"{'SAS':8}{'SAS':8}{'SASLIB':8}{'9.4':8}{'':8}{'':24}{now}") + _card(now)
    out_head += head(mem, "000000000000000001600000000140") + head(des)
    out_head += _card(f"{'SAS':8}{table:{most}}{'SASDATA':8}{'9.4':8}{'':8}{'':{24 if version == 5 else 0}}{now}") + _card(f"{now}{'':16}{fitted(file_label, 40, 'the file label').decode():40}")
    out_head += _card(f"HEADER RECORD*******{('NAMESTR' if version == 5 else 'NAMSTV8').ljust(8)}HEADER RECORD!!!!!!!{len(fields):010d}{'0' * 20}  ")
    body, at, long = b"", 0, []
    for k, (name, _, text, width, fmt, w, d) in enumerate(fields):
        label = fitted(labels.get(name), 40 if version == 5 else 32_000, f"the label of {name!r}")
        b = struct.pack(">hhhh", 2 if text else 1, 0, width, k + 1) + name[:8].ljust(8).encode() + label[:40].ljust(40)
        b += fmt[:8].ljust(8).encode() + struct.pack(">hhh", w, d, 1 if text else 0) + bytes(2) + b" " * 8 + struct.pack(">hh", 0, 0) + struct.pack(">i", at)
        b += name.ljust(32).encode() + struct.pack(">h", len(label)) + bytes(18) if version == 8 else bytes(52)
        body += b
        at += width
        if version == 8 and (len(label) > 40 or len(name) > 8):
            long.append(struct.pack(">hhh", k + 1, len(name), len(label)) + name.encode() + label)
    out_head += _fill(body)
    if long:
        out_head += _card(f"HEADER RECORD*******LABELV8 HEADER RECORD!!!!!!!{len(long):<10d}{'':20}  ") + _fill(b"".join(long))

    def finish(parts, out) -> None:
        out.write(out_head + (head(obs) if version == 5 else _card(f"HEADER RECORD*******OBSV8   HEADER RECORD!!!!!!!{'':15}{parts.rows:<15d}  ")))
        n = parts.into(out)
        out.write(b" " * (-n % CARD))

    save(df, path, encode, finish, each)
