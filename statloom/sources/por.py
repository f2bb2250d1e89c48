"""SPSS portable files: one stream of text, read from front to back."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from .base import SPSS_SECONDS, Column, Source, array, temporal
from .files import SpssError, file_size, open_binary
from .sav import FORMAT_NAMES, KINDS

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRST"
#: More rows than any file has.
ALL_ROWS = 1 << 62
#: The portable character set from place 64 on.
CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz .<(+|&[]!$*);^-/|,%_>?`:#@'=\""


def to_base30(v: float, precision: int = 50) -> str:
    """A number as a portable file writes it, with its slash; missing is '*.' without one."""
    if v is None or not math.isfinite(v):
        return "*."
    sign, v, exponent = "-" if v < 0 else "", abs(v), 0
    if v and (v >= 30.0**15 or v < 30.0**-8):
        exponent = math.floor(math.log(v, 30)) - 5
        v = v / 30.0**exponent if abs(exponent) < 200 else v / 30.0 ** (exponent // 2) / 30.0 ** (exponent - exponent // 2)
    whole, part = int(v), v - int(v)
    text = ""
    while whole:
        whole, d = divmod(whole, 30)
        text = DIGITS[d] + text
    text = text or "0"
    if part:
        text += "."
        for _ in range(min(precision, 22)):
            part *= 30
            d = int(part)
            text, part = text + DIGITS[d], part - d
            if not part:
                break
    if exponent:
        e, n = "", abs(exponent)
        while n:
            n, d = divmod(n, 30)
            e = DIGITS[d] + e
        text += ("+" if exponent > 0 else "-") + e
    return sign + text + "/"


def from_base30(s: str) -> float:
    sign, s = (-1.0, s[1:]) if s.startswith("-") else (1.0, s)
    exponent = 0
    for mark in "+-":
        if mark in s:
            s, e = s.split(mark, 1)
            exponent = int(e, 30) * (1 if mark == "+" else -1)
    whole, _, part = s.partition(".")
    digits = (whole + part).lstrip("0")
    scale = exponent - len(part)
    v = int(digits, 30) if digits else 0
    try:
        return sign * (float(v * 30**scale) if scale >= 0 else v / 30**-scale)
    except OverflowError:
        return sign * math.inf


class _Stream:
    def __init__(self, text: str):
        self.t, self.at = text, 0

    def char(self) -> str:
        self.at += 1
        return self.t[self.at - 1 : self.at]

    def number(self) -> float | None:
        while self.t[self.at : self.at + 1] == " ":
            self.at += 1
        if self.t[self.at : self.at + 2] == "*.":
            self.at += 2
            return None
        end = self.t.find("/", self.at)
        if end < 0:
            raise SpssError("a number without an end")
        s, self.at = self.t[self.at : end], end + 1
        return from_base30(s)

    def int(self) -> int:
        return int(self.number() or 0)

    def string(self) -> str:
        n = self.int()
        self.at += n
        return self.t[self.at - n : self.at]


class Por(Source):
    def __init__(self, path: str):
        self.path = path
        s = self._open()
        s.char(), s.string(), s.string()
        self.columns, self.label, self.precision = [], self._label, 11
        last: Column | None = None
        while (tag := s.char()) not in ("F", ""):
            if tag in "123":
                s.string()
            elif tag == "4":
                self.n = s.int()
            elif tag == "5":
                self.precision = s.int()
            elif tag == "6":
                s.string()
            elif tag == "7":
                width, name = s.int(), s.string()
                fmt = [s.int() for _ in range(6)]
                kind = fmt[0] - 82 if fmt[0] > 82 else fmt[0]
                last = Column(name, "string" if width else KINDS.get(kind, "double"), "", f"{FORMAT_NAMES.get(kind, kind)}{fmt[1]}" + (f".{fmt[2]}" if fmt[2] else ""), 0, width, "string" if width else "number", extra={"format_type": kind, "format_width": fmt[1], "format_decimals": fmt[2]})
                self.columns.append(last)
            elif tag in "89AB":
                kind = {"8": "values", "9": "low", "A": "high", "B": "range"}[tag]
                one = s.string if last.storage == "string" else s.number
                last.missing.setdefault(kind, []).extend([one()] if kind != "range" else [one(), one()])
            elif tag == "C":
                last.label = s.string()
            elif tag == "D":
                names = [s.string() for _ in range(s.int())]
                own = [c for c in self.columns if c.name in names]
                text = bool(own) and own[0].storage == "string"
                pairs = [(s.string() if text else s.number(), s.string()) for _ in range(s.int())]
                for c in own:
                    c.labels.update(pairs)
            elif tag == "E":
                for _ in range(s.int()):
                    s.string()
            else:
                raise SpssError(f"unknown tag {tag!r} in {path}")
        self.data_at, self.record, self._counted = s.at, 1, None

    @property
    def rows(self) -> int:
        """The header doesn't say: the whole file is read for this, when it is asked for."""
        if self._counted is None:
            s = self._open()
            s.at = self.data_at
            self._counted = sum(len(c) for c in self._rows(s)) // max(1, len(self.columns))
        return self._counted

    def bytes_of_rows(self):
        return file_size(self.path)

    def _open(self) -> _Stream:
        with open_binary(self.path) as f:
            raw = f.read()
        lines = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        flat = b"".join(x.ljust(80) for x in lines)
        if len(flat) < 464:
            raise SpssError(f"{self.path} is no portable file")
        table, mark = flat[200:456], flat[456:464]
        swap = list(range(256))
        for k, ch in enumerate(CHARACTERS):
            if table[64 + k] not in (0, ord(ch)) and table[64 + k] != table[64]:
                swap[table[64 + k]] = ord(ch)
        flat = flat.translate(bytes(swap))
        if mark.translate(bytes(swap)) != b"SPSSPORT":
            raise SpssError(f"{self.path} is no portable file")
        self._label = flat[60:80].decode("utf-8", "replace").strip()
        try:
            text = flat[464:].decode("ascii")
        except UnicodeDecodeError:
            text = flat[464:].decode("latin-1")
        return _Stream(text)

    def _rows(self, s: _Stream, step: int = 8192):
        """Values of ``step`` rows at a time, one after another."""
        out: list = []
        while s.t[s.at : s.at + 1] not in ("Z", ""):
            for c in self.columns:
                out.append(s.string() if c.storage == "string" else s.number())
            if len(out) >= step * len(self.columns):
                yield out
                out = []
        yield out

    def splits(self, n, start=0, count=None):
        return [(start, ALL_ROWS - start if count is None else count)]

    def divisible(self):
        return False

    def batches(self, start, count, names, tagged, empty_null, step):
        s = self._open()
        s.at = self.data_at
        at, width = 0, len(self.columns)
        wanted = [(self.columns.index(c), c) for c in self.wanted(names)]
        for flat in self._rows(s, step):
            n = len(flat) // width
            a, b = max(start - at, 0), min(start + count - at, n)
            if a < b:
                yield at + a, {c.name: self._column(flat[k::width][a:b], c, c.name in tagged, empty_null) for k, c in wanted}
            at += n
            if at >= start + count:
                return

    def _column(self, values: list, c: Column, tags: bool, empty_null: bool):
        if c.storage == "string":
            fixed = [v.encode("latin-1").decode("utf-8", "replace").rstrip(" ") for v in values]
            return pa.array([None if empty_null and not v else v for v in fixed], pa.string()), pa.nulls(len(values), pa.string()) if tags else None
        v = np.array([math.nan if x is None else x for x in values], float)
        null = np.isnan(v)
        if c.kind in ("date", "timestamp", "time"):
            v, null = temporal(v, null, c.kind, 0 if c.kind == "time" else SPSS_SECONDS, self.clip)
        return array(v, null, c.kind), pa.nulls(len(values), pa.string()) if tags else None

    def taggable(self):
        return []

    def metadata(self) -> dict:
        return {"file_label": self.label or None, "precision": self.precision, "row_count": self.rows, "variables": [{"name": c.name, "label": c.label or None, "type": c.storage, "format": c.format, "format_type": c.extra["format_type"], "format_width": c.extra["format_width"], "format_decimals": c.extra["format_decimals"], "string_width_bytes": c.width or None, "value_labels": dict(c.labels) or None, "missing": dict(c.missing) or None} for c in self.columns]}
