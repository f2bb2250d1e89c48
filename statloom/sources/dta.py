"""Stata .dta files, releases 102 to 119, either byte order."""

from __future__ import annotations

import re
import struct
from array import array as array_of
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .base import DAY_S, SAS_DAYS, Column, Source, array, cells, strings, text
from .files import StataError, open_binary

NUMERIC = {"byte": ("i1", 1), "int": ("i2", 2), "long": ("i4", 4), "float": ("f4", 4), "double": ("f8", 8)}
KIND = {"byte": "byte", "int": "short", "long": "int", "float": "float", "double": "double"}
MODERN = {65530: "byte", 65529: "int", 65528: "long", 65527: "float", 65526: "double"}
CODES = {251: "byte", 252: "int", 253: "long", 254: "float", 255: "double"}
LETTERS = {"b": "byte", "i": "int", "l": "long", "f": "float", "d": "double"}
#: The first missing code of integers from release 113 on, and the largest value before.
FIRST_MISSING = {"byte": 101, "int": 32741, "long": 2147483621}
#: Bits of a long string's reference that name the variable.
REFERENCE_BITS = {117: 32, 118: 16, 119: 24}
#: Bytes of long strings that are decoded at once.
LONG_BYTES = 16 << 20
LAST_VALID_OLD = {"byte": 126, "int": 32766, "long": 2147483646}


@dataclass
class Widths:
    """Field widths of a release's header."""

    name: int
    format: int
    value_label: int
    label: int

    @classmethod
    def of(cls, release: int) -> Widths:
        if release >= 118:
            return cls(129, 57, 129, 321)
        name = 33 if release >= 110 else 9
        fmt = 49 if release >= 114 else 12 if release > 104 else 7
        return cls(name, fmt, name, 81 if release > 105 else 32)


class _Reader:
    def __init__(self, data, at: int, end: str, encoding: str):
        self.f, self.end, self.encoding = data, end, encoding
        self.f.seek(at)

    def take(self, n: int) -> bytes:
        b = self.f.read(n)
        if len(b) != n:
            raise StataError("the file ends in its header")
        return b

    def num(self, code: str) -> int:
        return struct.unpack(self.end + code, self.take(struct.calcsize(self.end + code)))[0]

    def str(self, n: int) -> str:
        return self.take(n).split(b"\0", 1)[0].decode(self.encoding, "replace").rstrip(" ")

    def tag(self, name: str) -> None:
        if (got := self.take(len(name) + 2)) != b"<" + name.encode() + b">":
            raise StataError(f"expected <{name}>, found {got!r}")


class Dta(Source):
    def __init__(self, path: str, periods: bool = False):
        self.path, self.periods = path, periods
        with open_binary(path) as f:
            first = f.read(28)
            if first.startswith(b"<stata_dta>"):
                self._modern(f)
            elif first and first[0] in {102, 103, 104, 105, 108, 110, 111, 112, 113, 114, 115}:
                self._old(f, first[0])
            else:
                raise StataError(f"{path} is no .dta file of a known release")
        for c in self.columns:
            c.kind = self._kind(c)
            c.labels = self.label_sets.get(c.label_set, {})

    # -- headers -------------------------------------------------------------------------------------------------------

    def _modern(self, f) -> None:
        m = re.match(rb"<stata_dta><header><release>(\d{3})</release><byteorder>(LSF|MSF)</byteorder>", (f.seek(0), f.read(80))[1])
        if not m or int(m[1]) not in (117, 118, 119):
            raise StataError(f"{self.path} is no .dta file of a known release")
        self.release, self.end = int(m[1]), "<" if m[2] == b"LSF" else ">"
        self.encoding = "utf-8" if self.release >= 118 else "cp1252"
        r = _Reader(f, m.end(), self.end, self.encoding)
        r.tag("K")
        n = r.num("I" if self.release == 119 else "H")
        r.tag("/K"), r.tag("N")
        self.rows = r.num("Q" if self.release >= 118 else "I")
        r.tag("/N"), r.tag("label")
        self.label = r.str(r.num("H" if self.release >= 118 else "B"))
        r.tag("/label"), r.tag("timestamp")
        self.timestamp = r.str(r.num("B"))
        r.tag("/timestamp"), r.tag("/header"), r.tag("map")
        at = [r.num("Q") for _ in range(14)]
        w = Widths.of(self.release)
        goto = lambda k, name: (f.seek(at[k]), r.tag(name))
        goto(2, "variable_types")
        types = [r.num("H") for _ in range(n)]
        goto(3, "varnames")
        names = [r.str(w.name) for _ in range(n)]
        goto(5, "formats")
        formats = [r.str(w.format) for _ in range(n)]
        goto(6, "value_label_names")
        sets = [r.str(w.value_label) for _ in range(n)]
        goto(7, "variable_labels")
        labels = [r.str(w.label) for _ in range(n)]
        self.data_at, self.strls_at, self.labels_at = at[9] + 6, at[10], at[11]
        self._columns([MODERN.get(t) or ("strL" if t == 32768 else t) for t in types], names, formats, sets, labels)
        self.label_sets = {}
        f.seek(at[11])
        r.tag("value_labels")
        while r.take(5) == b"<lbl>":
            r.num("I")
            name, codes = r.str(w.value_label), (r.take(3), self._label_table(r))[1]
            self.label_sets[name] = codes
            r.tag("/lbl")

    def _old(self, f, release: int) -> None:
        self.release, self.encoding = release, "cp1252"
        f.seek(1)
        self.end = ">" if f.read(1) == b"\1" else "<"
        r = _Reader(f, 4, self.end, self.encoding)
        n, self.rows = r.num("H"), r.num("I" if release > 102 else "H")
        self.label = r.str(81 if release > 105 else 32)
        self.timestamp = r.str(18) if release > 104 else ""
        w, raw = Widths.of(release), r.take(n)
        if release > 110:
            types = [CODES.get(t, t) for t in raw]
        else:
            types = [LETTERS.get(chr(t)) or t - 127 for t in raw]
        names = [r.str(w.name) for _ in range(n)]
        r.take(2 * (n + 1))
        formats = [r.str(w.format) for _ in range(n)]
        sets = [r.str(w.value_label) for _ in range(n)]
        labels = [r.str(w.label) for _ in range(n)]
        while release > 104:  # expansion fields
            kind, size = r.num("B"), r.num("I" if release > 108 else "H")
            if not kind and not size:
                break
            r.take(size)
        self.data_at, self.strls_at = f.tell(), None
        self._columns(types, names, formats, sets, labels)
        self.labels_at, self.label_sets = self.data_at + self.rows * self.record, {}
        f.seek(self.labels_at)
        while True:
            try:
                size = r.num("I" if release > 104 else "H")
                name = r.str(w.value_label)
                r.take(3 if release > 104 else 1)
                if release > 104:
                    self.label_sets[name] = self._label_table(r)
                else:
                    self.label_sets[name] = {i: s for i in range(size // 8) if (s := r.str(8))}
            except StataError:
                break

    def _label_table(self, r: _Reader) -> dict:
        n, size = r.num("I"), r.num("I")
        at = np.frombuffer(r.take(4 * n), self.end + "u4")
        code = np.frombuffer(r.take(4 * n), self.end + "i4")
        blob = r.take(size)
        return {int(c): blob[a:].split(b"\0", 1)[0].decode(self.encoding, "replace") for a, c in sorted(zip(at.tolist(), code.tolist()), key=lambda x: x[1])}

    def _columns(self, types, names, formats, sets, labels) -> None:
        self.columns, at = [], 0
        for t, name, fmt, s, label in zip(types, names, formats, sets, labels, strict=True):
            width = 8 if t == "strL" else NUMERIC[t][1] if t in NUMERIC else int(t)
            self.columns.append(Column(name, "string", label, fmt, at, width, t if t in NUMERIC else "string", s, extra={"type": t if isinstance(t, str) else f"str{t}"}))
            at += width
        self.record = at

    def _kind(self, c: Column) -> str:
        if c.storage == "string":
            return "string"
        f = c.format.lstrip("%-").lower()
        if re.match(r"t?c", f) and f.startswith("tc"):
            tail = c.format[c.format.lower().find("tc") + 2 :]
            return "time" if tail and not re.search("[CYNDcynd]", tail) else "timestamp"
        if re.match(r"t[dwmqhy]|d", f):
            return "date"
        return KIND[c.storage]

    # -- rows ----------------------------------------------------------------------------------------------------------

    def _missing(self, v: np.ndarray, storage: str) -> tuple[np.ndarray, np.ndarray]:
        """Which values are missing, and which code (0 '.', 1 to 26 '.a' to '.z')."""
        if storage in FIRST_MISSING:
            if self.release < 113:
                return v > LAST_VALID_OLD[storage], np.zeros(len(v), np.int64)
            first = FIRST_MISSING[storage]
            return v >= first, v.astype(np.int64) - first
        bits = np.ascontiguousarray(v).view("u4" if storage == "float" else "u8")
        low, step = (0x7F000000, 11) if storage == "float" else (0x7FE0000000000000, 40)
        top = bits.astype(np.int64) if storage == "float" else np.where(bits >> np.uint64(63), np.uint64(0), bits).astype(np.int64)
        null = (top >= low) & (bits >> np.array(31 if storage == "float" else 63, bits.dtype) == 0) | np.isnan(v)
        return null, (top - low) >> step

    def decode(self, block, column, tags, empty_null):
        c = column
        if c.storage == "string":
            if c.extra["type"] == "strL":
                return self._long(block, c, empty_null), None
            return text(block, c.offset, c.width, self.encoding, empty_null), None
        code, width = NUMERIC[c.storage]
        v = cells(block, c.offset, width, self.end + code).astype(code)
        null, which = self._missing(v, c.storage)
        tag = None
        if tags:
            user = null & (which >= 1) & (which <= 26)
            names = [None] + [f".{chr(96 + k)}" for k in range(1, 27)]
            if c.extra.get("tag_labels"):
                names = [None if t is None else c.extra["tag_labels"].get(t, t) for t in names]
            tag = pa.array([names[k] for k in np.where(user, which, 0).tolist()], pa.string())
        if c.kind in ("date", "timestamp", "time"):
            return self._temporal(v, null, c), tag
        return array(v, null, c.kind), tag

    def _temporal(self, v, null, c):
        whole = np.where(null, 0, v).astype(np.float64)
        if c.kind == "date":
            unit = c.format.lstrip("%-").lower()[:2]
            if self.periods and unit in ("tw", "tm", "tq", "th", "ty"):
                return array(self._period(whole.astype(np.int64), unit), null, "date")
            return array(np.trunc(whole) - SAS_DAYS, null, "date")
        ms = np.trunc(whole)
        if c.kind == "timestamp":
            return array((ms - SAS_DAYS * DAY_S * 1000) * 1000, null, "timestamp")
        return array(np.mod(ms, DAY_S * 1000) * 1_000_000, null, "time")

    @staticmethod
    def _period(v: np.ndarray, unit: str) -> np.ndarray:
        """First days of weeks, months, quarters, half-years or years, in days since 1970."""
        if unit == "tw":
            year, week = 1960 + np.floor_divide(v, 52), np.mod(v, 52)
            return (year - 1970).astype("M8[Y]").astype("M8[D]").astype(np.int64) + 7 * week
        months = {"tm": 1, "tq": 3, "th": 6, "ty": 12}[unit]
        since = v * months - 120 if unit != "ty" else (v - 1970) * 12
        return since.astype("M8[M]").astype("M8[D]").astype(np.int64)

    def batches(self, start, count, names, tagged, empty_null, step):
        """Blocks whose long strings have over ``LONG_BYTES`` are decoded some rows at a time."""
        wanted = self.wanted(names)
        long = [c for c in wanted if c.extra["type"] == "strL"]
        for at, block in self.records(start, count, step):
            for a, b in self._pieces(block, long) if long else [(0, len(block))]:
                part = block[a:b]
                yield at + a, {c.name: self.decode(part, c, c.name in tagged, empty_null) for c in wanted}

    def _pieces(self, block: np.ndarray, long: list[Column]) -> Iterator[tuple[int, int]]:
        """Consecutive ranges of a block's rows with at most ``LONG_BYTES`` of long strings, or of one row."""
        size, total = self._long_strings()[2], np.zeros(len(block), np.int64)
        for c in long:
            which, hit = self._found(block, c)
            if len(size):
                total += np.where(hit, size[which], 0)
        ends, a = np.cumsum(total), 0
        while a < len(block):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + LONG_BYTES, "right")))
            yield a, b
            a = b

    def _found(self, block: np.ndarray, c: Column) -> tuple[np.ndarray, np.ndarray]:
        """Which of the file's long strings the rows of a block have, and whether they have one."""
        big = self.end == ">"
        raw = cells(block, c.offset, 8, self.end + "u8")
        # writers of big-endian files differ in how wide the variable's number is at release 119
        keys = [self._reference(raw, bits, big) for bits in ((24, 16) if big and self.release == 119 else (REFERENCE_BITS[self.release],))]
        known = self._long_strings()[0]
        found = [np.searchsorted(known, k) for k in keys]
        hits = [(f < len(known)) & (known[np.minimum(f, len(known) - 1)] == k) if len(known) else np.zeros(len(k), bool) for f, k in zip(found, keys, strict=True)]
        best = int(np.argmax([h.sum() for h in hits]))
        return np.where(hits[best], found[best], 0), hits[best]

    def _long(self, block, c, empty_null) -> pa.Array:
        _, at, size = self._long_strings()
        which, hit = self._found(block, c)
        texts: dict[int, bytes] = {}
        with open_binary(self.path) as f:
            for k in sorted(set(which[hit].tolist()), key=at.__getitem__):
                f.seek(int(at[k]))
                texts[k] = f.read(int(size[k])).rstrip(b"\0")
        return strings([texts[k] if h else b"" for k, h in zip(which.tolist(), hit.tolist(), strict=True)], self.encoding, empty_null)

    def _reference(self, raw: np.ndarray, bits: int, big: bool) -> np.ndarray:
        """Cells of long strings as keys: the variable's number in the low bits that a release has for it, then the row's."""
        if not big:
            return raw.astype("u8")
        low = np.uint64(64 - bits)
        v, o = raw.astype("u8") >> low, raw.astype("u8") & ((np.uint64(1) << low) - np.uint64(1))
        return v | o << np.uint64(REFERENCE_BITS[self.release])

    def _long_strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the file's long strings, sorted, with places and sizes of their texts; headers are walked once in each
        task that needs them. Texts, which may be most of the file, are read for a batch at a time. Binary ones count as
        empty."""
        if not hasattr(self, "_gso"):
            key, at, size = array_of("Q"), array_of("Q"), array_of("I")
            bits = REFERENCE_BITS[self.release]
            with open_binary(self.path) as f:
                r = _Reader(f, self.strls_at, self.end, self.encoding)
                r.tag("strls")
                while r.take(3) == b"GSO":
                    v, o = r.num("I"), r.num("I" if self.release == 117 else "Q")
                    kind, n = r.num("B"), r.num("I")
                    key.append((v | o << bits) & 0xFFFFFFFFFFFFFFFF)
                    at.append(f.tell())
                    size.append(n if kind == 0x82 else 0)
                    f.seek(n, 1)
            key = np.frombuffer(key, "u8")
            order = np.argsort(key, kind="stable")
            self._gso = key[order], np.frombuffer(at, "u8")[order], np.frombuffer(size, "u4")[order]
        return self._gso

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_gso"}

    def metadata(self) -> dict:
        return {
            "version": self.release,
            "byte_order": "LSF" if self.end == "<" else "MSF",
            "row_count": self.rows,
            "data_label": self.label or None,
            "timestamp": self.timestamp or None,
            "data_offset": self.data_at,
            "strls_offset": self.strls_at,
            "value_labels_offset": self.labels_at,
            "encoding": self.encoding,
            "variables": [{"name": c.name, "type": c.extra["type"], "format": c.format, "label": c.label or None, "value_label_name": c.label_set or None, "value_labels": dict(c.labels) or None} for c in self.columns],
        }
