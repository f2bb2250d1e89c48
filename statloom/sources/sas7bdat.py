"""SAS data sets (.sas7bdat): 32 and 64 bits, either byte order, plain or compressed rows."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa

from .base import SAS_DAYS, Column, Source, array, codec, text
from .files import SasError, open_binary
from .sas_codecs import ross, run_lengths
from .xpt import sas_kind

MAGIC = bytes(12) + bytes.fromhex("c2ea8160b31411cfbd92080009c7318c181f1011")
#: Subheader signatures.
ROW_SIZE, COLUMN_SIZE, COUNTS, FORMAT, ATTRIBUTES, TEXT, LIST, NAME = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFC00, 0xFFFFFBFE, 0xFFFFFFFC, 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFF
KNOWN = {ROW_SIZE, COLUMN_SIZE, COUNTS, FORMAT, ATTRIBUTES, TEXT, LIST, NAME}
SIGNATURES, HIGH, LOW = (np.array(sorted(s), np.uint64) for s in (KNOWN, KNOWN - {NAME}, {ROW_SIZE, COLUMN_SIZE}))
DATA, MIX, META = 0x100, 0x200, 0x000
#: Character sets by the header's encoding byte; the nearest one where Python lacks the set named after it.
CHARSETS = {
    20: "utf-8", 28: "us-ascii", 29: "latin-1", 30: "iso8859-2", 31: "iso8859-3", 32: "iso8859-4", 33: "iso8859-5", 34: "iso8859-6", 35: "iso8859-7", 36: "iso8859-8", 37: "iso8859-9",
    39: "iso8859-11", 40: "iso8859-15", 41: "cp437", 42: "cp850", 43: "cp852", 44: "cp857", 45: "cp858", 46: "cp862", 47: "cp864", 48: "cp865", 49: "cp866", 50: "cp869", 51: "cp874",
    52: "iso8859-13",  # cp921
    53: "cp1252",  # cp922
    54: "cp1258",  # cp1129
    55: "cp720", 56: "cp737", 57: "cp775", 58: "cp860", 59: "cp863", 60: "cp1250", 61: "cp1251", 62: "cp1252", 63: "cp1253", 64: "cp1254", 65: "cp1255", 66: "cp1256", 67: "cp1257", 68: "cp1258",
    69: "mac-roman", 70: "mac-arabic",
    71: "mac-roman",  # Mac Hebrew
    72: "mac-greek",
    73: "tis-620",  # Mac Thai
    75: "mac-turkish",
    76: "mac-cyrillic",  # Mac Ukraine
    118: "cp950",
    119: "big5",  # EUC-TW
    123: "big5hkscs", 125: "gb18030", 126: "cp936",
    128: "gb18030",  # cp1381
    134: "euc-jp", 136: "cp949",
    137: "cp932",  # cp942
    138: "cp932", 140: "euc-kr", 141: "cp949", 142: "cp949", 163: "mac-iceland", 167: "iso2022_jp", 168: "iso2022_kr",
    169: "gb18030",  # ISO-2022-CN
    172: "gb18030",  # ISO-2022-CN-EXT
    205: "gb18030", 227: "iso8859-14", 242: "iso8859-13", 245: "mac-croatian", 246: "mac-cyrillic", 247: "mac-romanian", 248: "shift_jisx0213",
}
#: A date column's number of days since 1960 outside these, which are the years 1600 and 2389, is taken for seconds.
LEAST_DAY, MOST_DAY = -135_080, 156_935
#: Releases of a program that pads rows on metadata pages by four bytes only where these are zeros or blanks.
TRANSFER = re.compile(r"[89]\.0000M0")


class Header:
    """What data sets and catalogs share."""

    def __init__(self, f, path: str):
        head = f.read(288)
        if len(head) < 288:
            raise SasError(f"{path} is too short for a SAS file")
        self.magic = head[:32]
        self.wide = head[32] == 0x33
        a1 = 4 if head[35] == 0x33 else 0
        ta = a1 + (4 if self.wide else 0)
        self.pad = a1
        self.end = "<" if head[37] == 1 else ">"
        self.code = head[70]
        self.encoding = codec(CHARSETS.get(self.code, "cp1252"))
        clean = lambda a, n: head[a : a + n].split(b"\0")[0].decode("latin-1").strip()
        self.table, self.kind = clean(92, 64), clean(156, 8)
        self.size, self.page_size = struct.unpack(self.end + "II", head[196 + a1 : 204 + a1])
        width = 8 if self.wide else 4
        self.pages = int.from_bytes(head[204 + a1 : 204 + a1 + width], "little" if self.end == "<" else "big")
        self.release, self.server, self.os, self.creator = clean(216 + ta, 8), clean(224 + ta, 16), clean(272 + ta, 16) or clean(256 + ta, 16), clean(240 + ta, 16)
        self.integer, self.start = width, 32 if self.wide else 16

    def int(self, b: bytes, at: int, n: int | None = None) -> int:
        return int.from_bytes(b[at : at + (n or self.integer)], "little" if self.end == "<" else "big")


class Sas7bdat(Source):
    def __init__(self, path: str):
        self.path, self.data_at = path, 0
        with open_binary(path) as f:
            self.h = Header(f, path)
            if self.h.magic != MAGIC:
                raise SasError(f"{path} is no SAS data set")
            self.compression, self.texts, self.names, self.attributes, self.formats = None, [], [], [], []
            self.record = self.rows = self.mix_rows = 0
            self.spans: list[tuple[int, int]] = []  # (first row, page)
            self._scan(f)
        self._columns()

    # -- header and page index -----------------------------------------------------------------------------------------

    def _pointers(self, page: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A page's pointers to subheaders (at, n, packed, kind), and the subheaders' signatures, 0 for those of no known kind."""
        w, s = self.h.integer, self.h.start + 8
        number = f"{self.h.end}u{w}"
        n = max(0, min(n, (len(page) - s) // (3 * w)))
        found = np.frombuffer(page, [("at", number), ("n", number), ("packed", "u1"), ("kind", "u1"), ("", f"V{w - 2}")], n, s)
        at = np.minimum(found["at"], max(0, len(page) - w)).astype(np.int64)
        v = np.frombuffer(page, np.uint8)[at[:, None] + np.arange(w)].view(number).ravel().astype(np.uint64)
        low, high = v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)
        first = self.h.wide & np.isin(high, HIGH) & ~np.isin(low, LOW)
        what = np.where(first, high, low)
        return found, np.where(np.isin(what, SIGNATURES), what, 0)

    def _are_rows(self, found: np.ndarray, what: np.ndarray) -> np.ndarray:
        """Which subheaders are rows of a compressed data set: of the rows' type, no longer than one, of no known kind."""
        return (found["n"] > 0) & bool(self.compression) & (found["kind"] == 1) & np.isin(found["packed"], (0, 4)) & (found["n"] <= self.record) & (what == 0)

    def _scan(self, f) -> None:
        row = 0
        for k in range(self.h.pages):
            f.seek(self.h.size + k * self.h.page_size)
            page = f.read(self.h.start + 8)
            if len(page) < self.h.start + 8:
                break
            s = self.h.start
            kind, blocks, subs = (self.h.int(page, s + j, 2) for j in (0, 2, 4))
            full = None
            if kind & 0xF00 != DATA or self.compression:
                f.seek(self.h.size + k * self.h.page_size)
                full = f.read(self.h.page_size)
                full = self._pointers(page := full, subs)
                found, what = full
                for k_sub in np.flatnonzero((what > 0) & (found["n"] > 0) & (found["packed"] != 1)).tolist():
                    at, n = int(found["at"][k_sub]), int(found["n"][k_sub])
                    self._subheader(page[at : at + n], int(what[k_sub]))
            n = self._page_rows(full, kind, blocks, row)
            if n:
                self.spans.append((row, k))
                row += n
            if self.rows and row >= self.rows and self.record:
                break
        if row < self.rows and self.record:
            raise SasError(f"{self.path} has {row} rows, but its header says {self.rows}")

    def _page_rows(self, pointers, kind, blocks, row) -> int:
        left = self.rows - row
        if kind & 0xF00 == DATA:
            return min(blocks, left)
        if self.compression:
            return min(int(self._are_rows(*pointers).sum()), left)
        if kind & 0xF00 == MIX:
            return min(self.mix_rows or self.rows, left)
        return 0

    def _subheader(self, b: bytes, what: int) -> None:
        w, i = self.h.integer, self.h.int
        if what == ROW_SIZE:
            self.record, self.rows, self.mix_rows = i(b, 5 * w), i(b, 6 * w), i(b, 15 * w)
        elif what == TEXT:
            body = b[w:]
            self.texts.append(body)
            if self.compression is None and len(self.texts) == 1:
                self.compression = "rle" if b"SASYZCRL" in body else "rdc" if b"SASYZCR2" in body else None
        elif what == NAME:
            self.names += [(i(b, at, 2), i(b, at + 2, 2), i(b, at + 4, 2)) for at in range(w + 8, len(b) - 12 - w + 1, 8) if at + 8 <= len(b) - w - 4]
        elif what == ATTRIBUTES:
            self.attributes += [(i(b, at), i(b, at + w, 4), b[at + w + 6]) for at in range(w + 8, len(b) - 12 - w + 1, w + 8) if at + w + 8 <= len(b) - w - 4]
        elif what == FORMAT:
            at = 3 * w
            self.formats.append((tuple(i(b, at + j, 2) for j in (22, 24, 26)), tuple(i(b, at + j, 2) for j in (28, 30, 32))))

    def _string(self, ref: tuple[int, int, int]) -> str:
        k, at, n = ref
        if not self.texts or not n:
            return ""
        return self.texts[min(k, len(self.texts) - 1)][at : at + n].decode(self.h.encoding, "replace").strip(" \0")

    def _columns(self) -> None:
        self.columns = []
        for k, (at, width, kind) in enumerate(self.attributes):
            fmt, label = self.formats[k] if k < len(self.formats) else ((0, 0, 0), (0, 0, 0))
            name, f = self._string(self.names[k]) if k < len(self.names) else f"V{k + 1}", self._string(fmt)
            number = kind == 1
            self.columns.append(Column(name, sas_kind(f) if number else "string", self._string(label), f, at, width, "number" if number else "string"))

    # -- rows ----------------------------------------------------------------------------------------------------------

    def _page_records(self, page: bytes) -> np.ndarray:
        s, w = self.h.start, self.h.integer
        kind, blocks, subs = (self.h.int(page, s + j, 2) for j in (0, 2, 4))
        if kind & 0xF00 == DATA:
            at, n = s + 8, blocks
        elif self.compression:
            unpack, out = run_lengths if self.compression == "rle" else ross, []
            found, what = self._pointers(page, subs)
            found = found[self._are_rows(found, what)]
            for at, n in zip(found["at"].tolist(), found["n"].tolist(), strict=True):
                raw = page[at : at + n]
                out.append(unpack(raw, self.record) if len(raw) < self.record else raw[: self.record])
            return np.frombuffer(b"".join(out), np.uint8).reshape(-1, self.record)
        else:
            at, n = s + 8 + subs * 3 * w, self.mix_rows or self.rows
            if at % 8 == 4 and (not self._transfer() or page[at : at + 4] in (bytes(4), b" " * 4)):
                at += 4
        n = min(n, (len(page) - at) // self.record)
        return np.frombuffer(page, np.uint8, n * self.record, at).reshape(n, self.record)

    def _transfer(self) -> bool:
        return bool(TRANSFER.match(self.h.release))

    def records(self, start, count, step):
        stop = min(start + count, self.rows)
        firsts = [r for r, _ in self.spans]
        k, held, at, rows_held = max(bisect_right(firsts, start) - 1, 0), [], start, 0
        with open_binary(self.path) as f:
            while k < len(self.spans) and self.spans[k][0] < stop:
                first, number = self.spans[k]
                f.seek(self.h.size + number * self.h.page_size)
                rows = self._page_records(f.read(self.h.page_size))
                end = self.spans[k + 1][0] if k + 1 < len(self.spans) else self.rows
                held.append(rows[max(start - first, 0) : min(stop, end) - first])
                rows_held += len(held[-1])
                k += 1
                if rows_held >= step or k == len(self.spans) or self.spans[k][0] >= stop:
                    block, held, rows_held = np.concatenate(held), [], 0
                    yield at, block
                    at += len(block)

    def decode(self, block, column, tags, empty_null):
        c = column
        if c.storage == "string":
            return text(block, c.offset, c.width, self.h.encoding, empty_null), None
        raw = np.zeros((len(block), 8), np.uint8)
        if self.h.end == "<":
            raw[:, 8 - c.width :] = block[:, c.offset : c.offset + c.width]
        else:
            raw[:, : c.width] = block[:, c.offset : c.offset + c.width]
            raw = raw[:, ::-1]
        raw = np.ascontiguousarray(raw)
        v = raw.view("<f8").ravel()
        null = ~np.isfinite(v)
        tag = self._tags(raw, null) if tags else None
        v = np.where(null, 0.0, v)
        if c.kind == "date":
            days = np.trunc(v) - SAS_DAYS
            days = np.where((days < LEAST_DAY) | (days > MOST_DAY), np.trunc(v / 86_400) - SAS_DAYS, days)
            return array(days, null, "date"), tag
        if c.kind == "timestamp":
            return array(np.trunc((v - SAS_DAYS * 86_400) * 1e6), null, "timestamp"), tag
        if c.kind == "time":
            ns = np.trunc(v * 1e9)
            return array(ns, null | (ns < 0) | (ns >= 86_400e9) if self.clip else null, "time"), tag
        return array(v, null, "double"), tag

    @staticmethod
    def _tags(raw: np.ndarray, null: np.ndarray) -> pa.Array:
        """'.A' to '.Z' and '._' from the inverted sixth byte; a plain missing value has none."""
        names: list[str | None] = [None] * 256
        names[0] = names[ord("_")] = "._"
        for k in range(26):
            names[k + 2] = names[ord("A") + k] = "." + chr(ord("A") + k)
        code = np.where(null, 255 - raw[:, 5].astype(np.int64), 1).tolist()
        return pa.array([names[k] for k in code], pa.string())

    def metadata(self) -> dict:
        h = self.h
        return {
            "compression": self.compression or "none",
            "row_count": self.rows,
            "row_length": self.record,
            "column_count": len(self.columns),
            "table_name": h.table,
            "file_type": h.kind,
            "sas_release": h.release,
            "sas_server_type": h.server,
            "os_name": h.os,
            "creator_proc": h.creator,
            "encoding_byte": h.code,
            "file_encoding": h.encoding,
            "page_size": h.page_size,
            "page_count": h.pages,
            "header_length": h.size,
            "columns": [{"name": c.name, "label": c.label or None, "format": c.format or None, "type": "numeric" if c.storage == "number" else "character", "offset": c.offset, "length": c.width} for c in self.columns],
        }
