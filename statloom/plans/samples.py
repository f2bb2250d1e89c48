"""Files assembled byte by byte from the formats' descriptions, not by the library's writers: SAS data sets and catalogs,
which the library doesn't write, and SPSS files with byte codes or zlib blocks. For tables that fit the driver, but for
``sas7bdat_of``."""

import io
import re
import struct
import zlib

import numpy as np

from ..sinks.encode import numbers, padded
from ..sinks.parts import save
from ..sources.sas7bdat import MAGIC

#: Fixed value: the bits of SAS's missing value without a code.
MISSING = 0xFFFFFE0000000000


_RUNS = re.compile(rb"(.)\1{2,16}|.", re.S)


def rle_literal(row: bytes) -> bytes:
    """A row by run lengths: runs of blanks and NULs, the rest copied."""
    out = bytearray()
    for m in _RUNS.finditer(row):
        n, c = m.end() - m.start(), row[m.start()]
        if n < 3:
            out += bytes((0x80, c))
        elif c in b" \0":
            out.append((0xE0 if c == 32 else 0xF0) | n - 2)
        else:
            out += bytes((0xC0 | n - 3, c))
    return bytes(out)


def rdc(row: bytes) -> bytes:
    """A row by Ross data compression: runs, copies of the last bytes, and literals."""
    items, k = [], 0
    while k < len(row):
        n = 1
        while k + n < len(row) and row[k + n] == row[k] and n < 18:
            n += 1
        if n >= 3:
            items.append((1, bytes([n - 3, row[k]])))
            k += n
            continue
        low = max(0, k - 4000)
        m, at = 2, row.rfind(row[k : k + 3], low, k) if k + 3 <= len(row) else -1
        while at >= 0:  # the longest copy, of those the nearest
            m, best = m + 1, at
            at = row.rfind(row[k : k + m + 1], low, k) if m < 15 and k + m < len(row) else -1
        if m > 2:
            back = k - best - 3
            items.append((1, bytes([m << 4 | back & 15, back >> 4])))
            k += m
        else:
            items.append((0, row[k : k + 1]))
            k += 1
    out = b""
    for a in range(0, len(items), 16):
        some = items[a : a + 16]
        out += sum(f << 15 - j for j, (f, _) in enumerate(some)).to_bytes(2, "big") + b"".join(b for _, b in some)
    return out


class SasLayout:
    """A SAS data set's header, metadata page and pages of rows. columns: (name, 'num' or width, format, label). mix: rows on
    the metadata page (plain files)."""

    def __init__(self, columns, wide=True, end="<", compression=None, mix=0, page=4096):
        self.columns, self.wide, self.end, self.compression, self.mix, self.page = columns, wide, end, compression, mix, page
        self.w, self.start = (8, 32) if wide else (4, 16)
        self.length = sum(8 if kind == "num" else kind for _, kind, _, _ in columns)

    def int(self, v, n=None) -> bytes:
        return int(v).to_bytes(n or self.w, "little" if self.end == "<" else "big")

    def packed(self, row) -> bytes:
        b = b""
        for v, (_, kind, _, _) in zip(row, self.columns):
            if kind == "num":
                b += v if isinstance(v, bytes) else struct.pack(self.end + "d", v)
            else:
                b += v.encode().ljust(kind)
        return b

    def packed_batch(self, batch) -> list[bytes]:
        """Rows of an Arrow batch; null numbers are missing, null texts blank."""
        out = []
        for a, (_, kind, _, _) in zip(batch.columns, self.columns, strict=True):
            if kind == "num":
                v, null = numbers(a)
                bits = np.where(null, np.uint64(MISSING), v.astype("f8").view("u8")).astype(self.end + "u8")
                out.append(bits.view(np.uint8).reshape(-1, 8))
            else:
                out.append(padded(a, kind, b" "))
        raw = np.concatenate(out, axis=1).tobytes()
        return [raw[k : k + self.length] for k in range(0, len(raw), self.length)]

    def make(self, kind, pieces, blocks, body=b"", types=None) -> bytes:
        i, w, start, page = self.int, self.w, self.start, self.page
        out = bytearray(page)
        out[start : start + 6] = i(kind, 2) + i(blocks, 2) + i(len(pieces), 2)
        low = page
        for k, s in enumerate(pieces):
            low -= len(s)
            low -= low % 8 if kind != 0x100 and types is None else 0
            out[low : low + len(s)] = s
            pointer = i(low) + i(len(s)) + (types[k] if types else b"\0\0")
            out[start + 8 + k * 3 * w : start + 8 + k * 3 * w + len(pointer)] = pointer
        data = start + 8 + len(pieces) * 3 * w
        data += 4 if data % 8 == 4 and body and kind == 0x200 else 0
        assert data + len(body) <= low, "the page is too small"
        out[data : data + len(body)] = body
        return bytes(out)

    def pages(self, packed: list[bytes]) -> list[bytes]:
        """Whole pages of rows; the last one may have room left."""
        out, pending, length = [], [], self.length
        if not self.compression:
            per = (self.page - self.start - 8) // length
            return [self.make(0x100, [], len(some), b"".join(some)) for a in range(0, len(packed), per) if (some := packed[a : a + per])]
        squeeze, held = {"rle": rle_literal, "rdc": rdc}[self.compression], 0
        for b in packed:
            s = squeeze(b)
            s = s if len(s) < length else b
            pending.append((s, b"\4\1" if len(s) < length else b"\0\1"))
            held += len(s) + 3 * self.w
            if self.page - self.start - 8 - held < 2 * length + 3 * self.w:
                out.append(self.make(0, [x for x, _ in pending], len(pending), types=[t for _, t in pending]))
                pending, held = [], 0
        if pending:
            out.append(self.make(0, [x for x, _ in pending], len(pending), types=[t for _, t in pending]))
        return out

    def head(self, rows: int, pages: int, first: list[bytes]) -> bytes:
        """The header and the metadata page, with the rows ``first`` on it, for so many rows and pages of rows."""
        i, w, wide, end = self.int, self.w, self.wide, self.end
        text, refs = b"\0\0", {}
        if self.compression:
            text += b"\0" * 10 + {"rle": b"SASYZCRL", "rdc": b"SASYZCR2"}[self.compression]
        text = text.ljust(32, b"\0")

        def ref(s):
            nonlocal text
            b = s.encode()
            if s not in refs:
                refs[s] = (0, len(text), len(b))
                text += b + b"\0" * (-len(b) % 4)
            return b"".join(i(x, 2) for x in refs[s])

        names, attributes, formats, at = b"", b"", [], 0
        for name, kind, fmt, label in self.columns:
            names += ref(name) + i(0, 2)
            size = 8 if kind == "num" else kind
            attributes += i(at) + i(size, 4) + i(0, 2) + bytes([1 if kind == "num" else 2, 0])
            formats.append(i(0xFFFFFBFE | (0xFFFFFFFF << 32 if wide else 0)) + bytes(2 * w + 22) + ref(fmt) + ref(label) + bytes(18 if wide else 14))
            at += size
        row_size = bytearray(808 if wide else 480)
        row_size[:w] = i(0xF7F7F7F7)
        for k, v in ((5, self.length), (6, rows), (9, len(self.columns)), (15, self.mix or rows)):
            row_size[k * w : k * w + w] = i(v)
        text_sig = i(0xFFFFFFFD | (0xFFFFFFFF << 32 if wide else 0))
        head = lambda sig: i(sig | (0xFFFFFFFF << 32 if wide and sig >= 0xFFFFFF00 else 0))
        text = i(len(text), 2) + text[2:]
        subs = [bytes(row_size), i(0xF6F6F6F6) + i(len(self.columns)) + i(0), text_sig + text, head(0xFFFFFFFF) + i(len(names) + 8, 2) + bytes(6) + names + bytes(4 + w), head(0xFFFFFFFC) + i(len(attributes) + 8, 2) + bytes(6) + attributes + bytes(4 + w), *formats]
        about = self.make(0, subs, len(subs)) if self.compression else self.make(0x200 if self.mix else 0, subs, len(subs) + self.mix, b"".join(first))
        h = bytearray(1024)
        h[:32] = MAGIC
        h[32], h[35], h[37], h[39], h[70] = (0x33 if wide else 0x22), 0x33, (1 if end == "<" else 0), ord("1"), 20
        h[84:92], h[92:101], h[156:164] = b"SAS FILE", b"TESTTABLE", b"DATA    "
        h[196 + 4 : 200 + 4], h[204:208] = i(1024, 4), i(self.page, 4)
        h[208 : 208 + w] = i(pages + 1)
        ta = 4 + (4 if wide else 0)
        h[216 + ta : 224 + ta] = b"9.0401M1"
        return bytes(h) + about


def sas7bdat(path, columns, rows, wide=True, end="<", compression=None, mix=0, page=4096):
    """A SAS data set of rows that the driver holds; see :class:`SasLayout`."""
    layout = SasLayout(columns, wide, end, compression, 0 if compression else mix, page)
    packed = [layout.packed(r) for r in rows]
    pages = layout.pages(packed[layout.mix :])
    path.write_bytes(layout.head(len(packed), len(pages), packed[: layout.mix]) + b"".join(pages))


def sas7bdat_of(df, path, columns, **kwargs):
    """A SAS data set of a DataFrame: each task makes the pages of its rows, the driver joins them. Each task puts as many
    rows aside as the metadata page may take."""
    layout = SasLayout(columns, **kwargs)

    def encode(batch, state):
        packed = layout.packed_batch(batch)
        aside = max(0, layout.mix - state.get("aside", 0))
        state["aside"] = state.get("aside", 0) + aside
        return b"".join(layout.pages(packed[aside:])), b"".join(packed[:aside])

    def finish(parts, out):
        held = io.BytesIO()
        parts.into(held, more=True)
        held, n = held.getvalue(), layout.length
        aside = [held[k : k + n] for k in range(0, len(held), n)]
        out.write(layout.head(parts.rows, 0, aside[: layout.mix]))
        more = layout.pages(aside[layout.mix :])
        out.write(b"".join(more))
        pages = len(more) + parts.into(out) // layout.page
        out.seek(0)
        out.write(layout.head(parts.rows, pages, aside[: layout.mix]))

    save(df, path, encode, finish)


def sav(path, variables, rows, compression=0, extras=b"", labels=(), end="<", encoding=b"UTF-8", unknown=False):
    """variables: (name, width, format word, n_missing, missing bytes, label); rows: lists of 8-byte cells."""
    body, size = b"", 0
    for name, width, fmt, n_missing, missing, label in variables:
        body += struct.pack(end + "iiiiii", 2, width, int(bool(label)), n_missing, fmt, fmt) + name.encode().ljust(8)
        if label:
            body += struct.pack(end + "i", len(label)) + label.encode().ljust(-(-len(label) // 4) * 4)
        body += missing
        size += 1
        for _ in range(-(-width // 8) - 1 if width > 0 else 0):
            body += struct.pack(end + "iiiiii", 2, -1, 0, 0, 0, 0) + b" " * 8
            size += 1
    for pairs, places in labels:
        body += struct.pack(end + "ii", 3, len(pairs))
        for value, label in pairs:
            body += value + bytes([len(label)]) + label.encode().ljust((len(label) + 8) // 8 * 8 - 1)
        body += struct.pack(end + "ii", 4, len(places)) + struct.pack(end + f"{len(places)}i", *places)
    body += struct.pack(end + "iiii", 7, 20, 1, len(encoding)) + encoding + extras + struct.pack(end + "ii", 999, 0)
    head = (b"$FL3" if compression == 2 else b"$FL2") + b"test".ljust(60) + struct.pack(end + "iiiii", 2, size, compression, 0, -1 if unknown else len(rows)) + struct.pack(end + "d", 100.0) + b"01 Jan 2000:00:00"[:9] + b"00:00:00" + b"label".ljust(64) + bytes(3)
    cells = [c for r in rows for c in r]
    if compression == 0:
        data = b"".join(cells)
    else:
        data, codes, raw = b"", b"", b""
        for c in [*cells, None]:
            if c is None:
                codes += b"\xfc"
            elif c == b" " * 8:
                codes += b"\xfe"
            elif c == struct.pack(end + "Q", 0xFFEFFFFFFFFFFFFF):
                codes += b"\xff"
            elif (v := struct.unpack(end + "d", c)[0]) == v and -99 <= v <= 151 and v == int(v):
                codes += bytes([int(v) + 100])
            else:
                codes += b"\xfd"
                raw += c
            if len(codes) == 8 or c is None:
                data += codes.ljust(8, b"\0") + raw
                codes, raw = b"", b""
    if compression == 2:
        at = len(head) + len(body)
        chunks = [data[a : a + 40] for a in range(0, len(data), 40)]
        packed = [zlib.compress(c) for c in chunks]
        trailer_at = at + 24 + sum(map(len, packed))
        trailer, raw_at, file_at = struct.pack(end + "qqii", -100, 0, 40, len(chunks)), at, at + 24
        for c, p in zip(chunks, packed):
            trailer += struct.pack(end + "qqii", raw_at, file_at, len(c), len(p))
            raw_at, file_at = raw_at + len(c), file_at + len(p)
        data = struct.pack(end + "qqq", at, trailer_at, len(trailer)) + b"".join(packed) + trailer
    path.write_bytes(head + body + data)


def nan(tag):
    """A SAS missing value with a code."""
    return struct.pack("<Q", 0xFFFF000000000000 | (~tag & 0xFF) << 40)


def doubles(*v):
    return [struct.pack("<d", x) for x in v]


def catalog(path, formats):
    """formats: name to [(code, label)]; a 32-bit little-endian catalog with one block for each format."""
    page, h = 8192, bytearray(1024)
    h[:32] = bytes(12) + bytes.fromhex("c2ea8163b31411cfbd92080009c7318c181f1011")
    h[32], h[35], h[37], h[39], h[70] = 0x22, 0x22, 1, ord("1"), 20
    h[196:200], h[200:204], h[204:208] = struct.pack("<I", 1024), struct.pack("<I", page), struct.pack("<I", 3)
    index, blocks, at = bytearray(page), bytearray(page), 16
    for k, (name, pairs) in enumerate(formats.items()):
        entry = bytearray(212)
        entry[:4] = b"XLSR"
        entry[4:8], entry[8:10], entry[50:51] = struct.pack("<I", 3), struct.pack("<H", at), b"O"
        index[856 + k * 212 : 856 + (k + 1) * 212] = entry
        text = name.startswith("$")
        values, labels = b"", b""
        for n, (code, label) in enumerate(pairs):
            body = bytearray(32)
            body[2] = 26
            body[10:14] = struct.pack("<I", n)
            if text:
                body[16:32] = code.encode().ljust(16)
            else:
                body[22:30] = code if isinstance(code, bytes) else struct.pack(">d", -float(code))
            values += bytes(body)
            labels += bytes(8) + struct.pack("<H", len(label)) + label.encode() + b"\0"
        head = bytearray(106)
        head[8:16] = name.encode().ljust(8)
        head[38:42] = head[42:46] = struct.pack("<I", len(pairs))
        block = bytes(head) + values + labels
        half = len(block) // 2
        second = at + 16 + half
        blocks[at : at + 16 + half] = struct.pack("<IHH", 3, second, half) + bytes(8) + block[:half]
        blocks[second : second + 16 + len(block) - half] = struct.pack("<IHH", 0, 0, len(block) - half) + bytes(8) + block[half:]
        at = second + 16 + len(block) - half + 8
    path.write_bytes(bytes(h) + bytes(page) + bytes(index) + bytes(blocks))


def as_cells(a: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in a]
