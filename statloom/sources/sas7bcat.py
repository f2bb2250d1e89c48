"""SAS format catalogs (.sas7bcat): value labels by format name."""

from __future__ import annotations

import struct

from .files import SasError, open_binary
from .sas7bdat import Header


class _Catalog:
    def __init__(self, path: str):
        with open_binary(path) as f:
            self.h = Header(f, path)
            if self.h.magic[12:15] != b"\xc2\xea\x81":
                raise SasError(f"{path} is no SAS catalog")
            f.seek(0)
            self.raw = f.read()

    def page(self, n: int) -> bytes:
        at = self.h.size + n * self.h.page_size
        return self.raw[at : at + self.h.page_size]

    def places(self):
        """Where blocks start: (page, position) of the index entries that are in use."""
        h = self.h
        entry, flag = 212 + h.pad + (72 if h.wide else 0), 50 + h.pad + (24 if h.wide else 0)
        first = self.page(1)[856 + 2 * h.pad + (144 if h.wide else 0) - 0 :]
        more = [p[16:] for k in range(2, h.pages) if (p := self.page(k))[16:20] == b"XLSR"]
        for index in (first, *more):
            at = 0
            while at + entry <= len(index):
                if index[at : at + 4] != b"XLSR":
                    at += 8
                    if index[at : at + 4] != b"XLSR":
                        break
                if index[at + flag : at + flag + 1] == b"O":
                    yield (h.int(index, at + 8, 4), h.int(index, at + 16, 2)) if h.wide else (h.int(index, at + 4, 4), h.int(index, at + 8, 2))
                at += entry

    def block(self, page: int, pos: int) -> bytes:
        """A block's bytes, gathered along its chain of links."""
        h, out, seen = self.h, b"", set()
        size = 32 if h.wide else 16
        while page > 0 and (page, pos) not in seen:
            seen.add((page, pos))
            at = h.size + (page - 1) * h.page_size + pos
            link = self.raw[at : at + size]
            n = h.int(link, 10 if h.wide else 6, 2)
            out += self.raw[at + size : at + size + n]
            page, pos = h.int(link, 0, 4), h.int(link, 8 if h.wide else 4, 2)
        return out

    def labels(self, b: bytes) -> tuple[str, dict] | None:
        h = self.h
        if len(b) < 106:
            return None
        room, used = (h.int(b, 42, 8), h.int(b, 50, 8)) if h.wide else (h.int(b, 38, 4), h.int(b, 42, 4))
        name, at, flags = b[8:16], 106 + (32 if h.wide else 0), h.int(b, 2, 2)
        at += 20 if flags & 8 else 0
        if flags & (0x20 if h.wide else 0x80):
            name, at = b[at : at + 32], at + 32
        name = name.decode(h.encoding, "replace").strip(" \0")
        return name, self._pairs(b[at:], used, room, name.startswith("$"))

    def _pairs(self, b: bytes, used: int, room: int, text: bool) -> dict:
        h, at, entries = self.h, 0, {}
        for k in range(room):
            if at + 3 > len(b):
                break
            n = 6 + b[at + 2]
            if k < used:
                entries[h.int(b, at + 10 + h.pad, 4)] = b[at : at + n]
            at += n
        out = {}
        for k in range(used):
            if at + 10 > len(b) or k not in entries:
                break
            n = h.int(b, at + 8, 2)
            label = b[at + 10 : at + 10 + n].decode(h.encoding, "replace").rstrip(" \0")
            at += 11 + n
            value = self._value(entries[k], text)
            if value is not None:
                out[value] = label
        return out

    def _value(self, entry: bytes, text: bool):
        if text:
            return entry[-16:].decode(self.h.encoding, "replace").rstrip(" \0")
        raw = entry[22:30]
        if int.from_bytes(raw, "big") | 0xFF << 40 == 0xFFFFFFFFFFFF:
            return None  # a missing code's label
        v = -struct.unpack(">d", raw)[0]
        return int(v) if v == int(v) and abs(v) < 2**53 else v


def read_sas7bcat(path: str) -> dict[str, dict]:
    """{FORMAT: {code: label}}: names upper-cased and without dots, whole codes as int; labels of missing codes skipped."""
    c, out = _Catalog(str(path)), {}
    for place in c.places():
        if (found := c.labels(c.block(*place))) and found[1]:
            out[found[0].upper().replace(".", "")] = found[1]
    return out
