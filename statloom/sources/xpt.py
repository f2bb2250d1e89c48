"""SAS transport files, versions 5 and 8."""

from __future__ import annotations

import re
import struct

import numpy as np

from .base import SAS_DAYS, Column, Source, array, strings, temporal
from .files import SasError, file_size, open_binary

CARD = 80
#: Prefixes of SAS format names that stand for dates, date-times and times.
DATETIME_FORMATS = ("DATETIME", "DATEAMPM", "E8601DT", "B8601DT", "IS8601DT", "NLDATM", "MDYAMPM", "DTDATE", "DTMONYY", "DTWKDATX", "DTYEAR", "TOD")
DATE_FORMATS = ("DATE", "DAY", "DDMMYY", "DOWNAME", "E8601DA", "B8601DA", "IS8601DA", "EURDF", "JULDAY", "JULIAN", "MMDDYY", "MMYY", "MONNAME", "MONTH", "MONYY", "NENGO", "NLDATE", "PDJULG", "PDJULI", "QTR", "WEEKDATE", "WEEKDATX", "WEEKDAY", "WORDDATE", "WORDDATX", "YEAR", "YYMM", "YYMMDD", "YYMON", "YYQ", "YYWEEK", "MINGUO")
TIME_FORMATS = ("TIME", "TIMEAMPM", "HHMM", "HOUR", "MMSS", "E8601TM", "B8601TM", "IS8601TM", "NLTIM")


def sas_kind(fmt: str) -> str:
    """The kind of a SAS numeric column with this format: date-times are tried before dates, dates before times."""
    f = fmt.upper().lstrip("$")
    for kind, names in (("timestamp", DATETIME_FORMATS), ("date", DATE_FORMATS), ("time", TIME_FORMATS)):
        if f.startswith(names):
            return kind
    return "double"


def ibm_to_ieee(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of IBM hexadecimal floats (rows of 8 bytes, big-endian), and which are missing."""
    rest = raw[:, 1:].any(axis=1)
    first = raw[:, 0]
    null = ~rest & ((first == 0x2E) | (first == 0x5F) | ((first >= 0x41) & (first <= 0x5A)))
    x = np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
    fraction = (x & np.uint64(0x00FFFFFFFFFFFFFF)).astype(np.float64)
    power = 4 * (((x >> np.uint64(56)) & np.uint64(0x7F)).astype(np.int64) - 64) - 56
    sign = np.where(x >> np.uint64(63), -1.0, 1.0)
    return np.where(null, np.nan, sign * np.ldexp(fraction, power)), null


def ieee_to_ibm(v: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Rows of 8 bytes; missing and non-finite values are '.', values too small are 0."""
    v = np.asarray(v, np.float64)
    null = null | ~np.isfinite(v)
    mantissa, power = np.frexp(np.where(null, 0.0, np.abs(v)))
    sixteen = -(-power // 4)
    fraction = np.ldexp(mantissa, 56 + power - 4 * sixteen).astype(np.uint64)
    sign = np.where(v < 0, np.uint64(1 << 63), np.uint64(0))
    small = (fraction == 0) | (sixteen + 64 < 0)
    if (sixteen[~null] + 64 > 127).any():
        raise ValueError("a number is too large for a transport file")
    out = np.where(small, np.uint64(0), sign | (np.clip(sixteen + 64, 0, 127).astype(np.uint64) << np.uint64(56)) | fraction)
    out = np.where(null, np.uint64(0x2E << 56), out)
    return out.astype(">u8").view(np.uint8).reshape(-1, 8)


class Xpt(Source):
    def __init__(self, path: str):
        self.path = path
        with open_binary(path) as f:
            card = lambda: f.read(CARD)
            first = card()
            if not re.match(rb"HEADER RECORD\*{7}(LIBRARY|LIBV8  )", first):
                raise SasError(f"{path} is no SAS transport file")
            self.version = 8 if b"LIBV8" in first else 5
            card(), card()
            member, descriptor = card(), card()
            if b"MEMB" not in member or b"DSC" not in descriptor:
                raise SasError(f"{path} has no member header")
            size = int(member[74:78] or b"140")
            one, two = card(), card()
            self.table = one[8 : 40 if self.version == 8 else 16].decode("latin-1").strip(" \0")
            self.label = two[32:72].decode("latin-1").strip(" \0")
            names = card()
            n = int(names[48:58])
            raw = f.read(-(-n * size // CARD) * CARD)
            self.columns, at = [], 0
            for k in range(n):
                at += self._column(raw[k * size : (k + 1) * size], at)
            self.record = at
            head = card()
            while b"OBS" not in head[:32]:
                if m := re.search(rb"LABELV(\d)\s+HEADER RECORD!{7}(\d+)", head):
                    self._long_labels(f, int(m[1]), int(m[2]))
                elif not head:
                    raise SasError(f"{path} has no observations header")
                head = card()
            self.data_at = f.tell()
        self.rows = self._row_count()

    def _column(self, b: bytes, at: int) -> int:
        kind, _, width, _ = struct.unpack(">hhhh", b[:8])
        clean = lambda x: x.decode("utf-8", "replace").strip(" \0")
        name, label, fmt = clean(b[8:16]), clean(b[16:56]), clean(b[56:64])
        size, decimals = struct.unpack(">hh", b[64:68])
        if self.version == 8:
            name = clean(b[88:120]) or name
        text = kind == 2
        self.columns.append(Column(name, "string" if text else sas_kind(fmt), label, fmt, at, width, "string" if text else "number", extra={"format_length": size, "format_decimals": decimals}))
        return width

    def _long_labels(self, f, version: int, n: int) -> None:
        start = f.tell()
        for _ in range(n):
            parts = struct.unpack(">" + "h" * (3 if version == 8 else 5), f.read(6 if version == 8 else 10))
            texts = [f.read(k).decode("utf-8", "replace").rstrip(" \0") for k in parts[1:]]
            c = self.columns[parts[0] - 1]
            c.name, c.label = texts[0] or c.name, texts[1]
            if version == 9 and texts[2] and c.storage != "string":
                c.format, c.kind = texts[2].rstrip("."), sas_kind(texts[2])
        f.seek(start + -(-(f.tell() - start) // CARD) * CARD)

    def _row_count(self) -> int:
        """Rows that fit the file, without the blank ones that pad its last card."""
        if not self.record:
            return 0
        n = (file_size(self.path) - self.data_at) // self.record
        with open_binary(self.path) as f:
            while n:
                k = min(n, max(1, (1 << 20) // self.record))
                f.seek(self.data_at + (n - k) * self.record)
                full = (np.frombuffer(f.read(k * self.record), np.uint8).reshape(k, self.record) != 32).any(axis=1)
                if full.any() or k * self.record > CARD:
                    at = int(np.flatnonzero(full)[-1]) + 1 if full.any() else 0
                    blank = min(k - at, CARD // self.record if CARD >= self.record else 0)
                    return n - k + max(at, k - blank)
                n -= k
        return 0

    def taggable(self):
        return []

    def decode(self, block, column, tags, empty_null):
        c = column
        if c.storage == "string":
            raw = np.ascontiguousarray(block[:, c.offset : c.offset + c.width]).view(f"S{c.width}").ravel().tolist()
            return strings(raw, "utf-8", empty_null, cut_nul=False), None
        raw = np.zeros((len(block), 8), np.uint8)
        raw[:, : c.width] = block[:, c.offset : c.offset + c.width]
        v, null = ibm_to_ieee(raw)
        if c.kind == "date":
            return array(np.trunc(np.where(null, 0, v)) - SAS_DAYS, null, "date"), None
        if c.kind in ("timestamp", "time"):
            v, null = temporal(v, null, c.kind, SAS_DAYS * 86_400, self.clip)
        return array(v, null, c.kind), None

    def metadata(self) -> dict:
        return {
            "xpt_version": self.version,
            "table_name": self.table,
            "file_label": self.label,
            "row_count": self.rows,
            "row_length": self.record,
            "column_count": len(self.columns),
            "columns": [{"name": c.name, "label": c.label or None, "format": c.format or None, "type": "character" if c.storage == "string" else "numeric", "offset": c.offset, "length": c.width} for c in self.columns],
        }

