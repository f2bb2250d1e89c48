"""SPSS system files: .sav, plain or with byte codes, and .zsav."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .base import SPSS_SECONDS, Column, Source, array, cells, codec, strings, temporal
from .files import SpssError, open_binary

#: Kinds of print formats that stand for dates, date-times and times, and names of all.
KINDS = {20: "date", 23: "date", 24: "date", 38: "date", 39: "date", 22: "timestamp", 41: "timestamp", 21: "time", 25: "time"}
FORMAT_NAMES = {1: "A", 2: "AHEX", 3: "COMMA", 4: "DOLLAR", 5: "F", 6: "IB", 7: "PIBHEX", 8: "P", 9: "PIB", 10: "PK", 11: "RB", 12: "RBHEX", 15: "Z", 16: "N", 17: "E", 20: "DATE", 21: "TIME", 22: "DATETIME", 23: "ADATE", 24: "JDATE", 25: "DTIME", 26: "WKDAY", 27: "MONTH", 28: "MOYR", 29: "QYR", 30: "WKYR", 31: "PCT", 32: "DOT", 33: "CCA", 34: "CCB", 35: "CCC", 36: "CCD", 37: "CCE", 38: "EDATE", 39: "SDATE", 40: "MTIME", 41: "YMDHMS"}
CODE_PAGES = {2: "ascii", 3: "cp1252", 65001: "utf-8", 28591: "latin-1", 20127: "ascii"}
MEASURES = {1: "nominal", 2: "ordinal", 3: "scale"}
ALIGNMENTS = {0: "left", 1: "right", 2: "center"}
SYSMIS = 0xFFEFFFFFFFFFFFFF
NOT_VALUES = (SYSMIS, 0xFFEFFFFFFFFFFFFE, 0x7FEFFFFFFFFFFFFF)
WINDOW = 4 << 20


def number_text(v: float) -> str:
    """A number as its shortest text, whole numbers without a point."""
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))


class Sav(Source):
    def __init__(self, path: str):
        self.path = path
        with open_binary(path) as f:
            head = f.read(176)
            if head[:4] not in (b"$FL2", b"$FL3") or len(head) < 176:
                raise SpssError(f"{path} is no SPSS system file")
            self.end = next((e for e in "<>" if struct.unpack(e + "i", head[64:68])[0] in (2, 3)), None)
            if self.end is None:
                raise SpssError(f"{path} has an unknown layout")
            self.compression, self.rows = (struct.unpack(self.end + "i", head[k : k + 4])[0] for k in (72, 80))
            self.bias = struct.unpack(self.end + "d", head[84:92])[0]
            self.version = 3 if head[:4] == b"$FL3" else 2
            self._dictionary(f)
            self.data_at = f.tell()
            self.label = head[109:173].decode(self.encoding, "replace").rstrip(" \0")
        if self.rows < 0:
            self.rows = self.cases if self.cases is not None and self.cases >= 0 else self._counted()

    # -- dictionary ----------------------------------------------------------------------------------------------------

    def _dictionary(self, f) -> None:
        u = lambda code: struct.unpack(self.end + code, f.read(struct.calcsize(code)))
        raw, sets, ext, self.cases = [], [], {}, None
        while True:
            kind = f.read(4)
            if len(kind) < 4:
                raise SpssError(f"{self.path} ends in its dictionary")
            kind = struct.unpack(self.end + "i", kind)[0]
            if kind == 2:
                width, has_label, n_missing, fmt, _ = u("iiiii")
                name, label, missing = f.read(8), b"", []
                if has_label:
                    n = u("i")[0]
                    label = f.read(-(-n // 4) * 4)[:n]
                missing = [f.read(8) for _ in range(abs(n_missing))]
                raw.append((width, fmt, name, label, n_missing, missing))
            elif kind == 3:
                items = []
                for _ in range(u("i")[0]):
                    value, n = f.read(8), f.read(1)[0]
                    items.append((value, f.read((n + 8) // 8 * 8 - 1)[:n]))
                four, n = u("ii")
                if four != 4:
                    raise SpssError("value labels without variables")
                sets.append((items, u("i" * n)))
            elif kind == 6:
                f.read(80 * u("i")[0])
            elif kind == 7:
                sub, size, n = u("iii")
                ext.setdefault(sub, f.read(size * n))
            elif kind == 999:
                u("i")
                break
            else:
                raise SpssError(f"unknown record {kind} in {self.path}")
        self.encoding = "cp1252"
        if 3 in ext and len(ext[3]) >= 32:
            self.encoding = CODE_PAGES.get(page := struct.unpack(self.end + "8i", ext[3][:32])[7], codec(f"cp{page}"))
        if 20 in ext:
            self.encoding = codec(ext[20].decode("ascii", "replace").strip("\0 "), self.encoding)
        if 16 in ext and len(ext[16]) >= 16:
            self.cases = struct.unpack(self.end + "qq", ext[16][:16])[1]
        self._variables(raw, sets, ext)

    def _text(self, b: bytes) -> str:
        return b.decode(self.encoding, "replace").rstrip(" \0")

    def _pairs(self, b: bytes) -> dict[str, str]:
        return dict(p.split("=", 1) for p in self._text(b).split("\t") if "=" in p)

    def _variables(self, raw, sets, ext) -> None:
        longer = {k.upper(): int(re.sub(r"\D", "", v) or 0) for k, v in self._pairs(ext.get(14, b"")).items()}
        names = {k.upper(): v for k, v in self._pairs(ext.get(13, b"")).items()}
        self.columns, by_place, skip, at, heads = [], {}, 0, 0, []
        for place, (width, fmt, name, label, n_missing, missing) in enumerate(raw):
            if width == -1:
                at += 8
                continue
            heads.append(place)
            if skip:
                skip -= 1
                at += 8
                continue
            short = self._text(name)
            total = longer.get(short.upper(), width)
            skip = -(-total // 252) - 1 if width and total > 255 else 0
            kind = "string" if width else KINDS.get(fmt >> 16 & 255, "double")
            c = Column(names.get(short.upper(), short), kind, self._text(label), self._format(fmt, total), at, total, "string" if width else "number")
            c.extra = {"short": short, "format_type": fmt >> 16 & 255, "format_width": fmt >> 8 & 255, "format_decimals": fmt & 255, "measure": None, "display_width": None, "alignment": None}
            self._missing_of(c, n_missing, missing)
            by_place[place] = c
            self.columns.append(c)
            at += 8
        self.record = at
        self._display(ext.get(11, b""), heads, by_place)
        for items, places in sets:
            for c in [by_place[p - 1] for p in places if p - 1 in by_place]:
                for value, label in items:
                    key = self._text(value) if c.storage == "string" else struct.unpack(self.end + "d", value)[0]
                    c.labels[key] = self._text(label)
        self._long_labels(ext.get(21, b""))
        self._long_missing(ext.get(22, b""))

    def _format(self, fmt: int, width: int) -> str:
        kind, w, d = fmt >> 16 & 255, fmt >> 8 & 255, fmt & 255
        return f"{FORMAT_NAMES.get(kind, kind)}{width if kind == 1 and width > 255 else w}" + (f".{d}" if d else "")

    def _missing_of(self, c: Column, n: int, raw: list[bytes]) -> None:
        if c.storage == "string":
            c.missing = {"strings": [self._text(b) for b in raw]} if raw else {}
            return
        v = [struct.unpack(self.end + "d", b)[0] for b in raw]
        if n < 0:
            c.missing = {"range": v[:2], "values": v[2:]}
        elif v:
            c.missing = {"values": v}

    def _display(self, b: bytes, heads: list[int], by_place: dict) -> None:
        v = struct.unpack(self.end + f"{len(b) // 4}i", b[: len(b) // 4 * 4])
        for count, places in ((len(heads), heads), (len(self.columns), list(by_place))):
            if count and len(v) in (2 * count, 3 * count):
                k = len(v) // count
                for j, place in enumerate(places):
                    if place in by_place:
                        own = v[k * j : k * j + k]
                        by_place[place].extra |= {"measure": MEASURES.get(own[0], "unknown"), "display_width": own[1] if k == 3 else None, "alignment": ALIGNMENTS.get(own[-1], "unknown")}
                return

    def _named(self, b: bytes) -> Iterator[tuple]:
        by = {n.upper(): c for c in self.columns for n in (c.name, c.extra["short"])}
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            at += n
            return b[at - n : at]

        num = lambda: struct.unpack(self.end + "i", take(4))[0]
        while at + 4 <= len(b):
            yield by.get(self._text(take(num())).upper()), take, num

    def _long_labels(self, b: bytes) -> None:
        for c, take, num in self._named(b):
            num()
            for _ in range(num()):
                value, label = self._text(take(num())), self._text(take(num()))
                if c:
                    c.labels[value] = label

    def _long_missing(self, b: bytes) -> None:
        for c, take, num in self._named(b):
            n, size = take(1)[0], num()
            values = [self._text(take(size)) for _ in range(n)]
            if c:
                c.missing = {"strings": values}

    # -- rows ----------------------------------------------------------------------------------------------------------

    def splits(self, n, start=0, count=None):
        """Byte codes have no row boundaries that can be found without reading them. One quick pass notes where clusters
        of codes start, and splits begin there; of zlib blocks a split inflates those from its start on."""
        if self.compression and n > 1:
            self.marks = list(self._marked(n))
        return super().splits(n, start, count)

    def divisible(self):
        return self.compression == 0

    def _marked(self, n: int) -> Iterator[tuple[int, int]]:
        """(cells before, place) of the starts of clusters, about four for each of ``n`` splits. A place is one in the file,
        or, with zlib blocks, where it would be if the blocks stood in the file inflated."""
        step = max(1, self.rows * self.record // 8 // (4 * n))
        seen, due = 0, 0
        for cells, at in self._cells(places=True):
            if seen >= due:
                yield seen, at
                due = seen + step
            seen += cells

    def resume_at(self, row):
        marks = getattr(self, "marks", None)
        if not marks:
            return None
        return max((m for m in marks if m[0] <= row * self.record // 8), default=marks[0])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "marks"}

    def _stream(self, window: int = WINDOW) -> Iterator[bytes]:
        start = self.resume[1] if self.resume else self.data_at
        with open_binary(self.path) as f:
            if self.compression != 2:
                f.seek(start)
                while b := f.read(window):
                    yield b
                return
            f.seek(self.data_at)
            _, trailer, _ = struct.unpack(self.end + "qqq", f.read(24))
            f.seek(trailer)
            _, _, _, n = struct.unpack(self.end + "qqii", f.read(24))
            place = self.data_at
            for _, at, full, size in [struct.unpack(self.end + "qqii", f.read(24)) for _ in range(n)]:
                if place + full > start:
                    f.seek(at)
                    block = zlib.decompress(f.read(size))
                    for k in range(max(0, start - place), len(block), window):
                        yield block[k : k + window]
                place += full

    def _cells(self, places: bool = False) -> Iterator:
        """Decoded 8-byte cells, some at a time; or, with ``places``, how many there are and where their codes start. The
        codes of a cluster say how many raw cells follow it."""
        rest, where_at = b"", self.data_at
        number = (np.arange(256, dtype=np.float64) - self.bias).astype(self.end + "f8").view(np.uint64)
        number[254] = np.frombuffer(b" " * 8, np.uint64)[0]
        number[255] = np.frombuffer(struct.pack(self.end + "Q", SYSMIS), np.uint64)[0]
        for chunk in self._stream(WINDOW // 64 if places else WINDOW):
            rest += chunk
            blocks = np.frombuffer(rest, np.uint8, len(rest) // 8 * 8).reshape(-1, 8)
            step, at, heads = ((blocks == 253).sum(1) + 1).tolist(), 0, []
            while at < len(step) and at + step[at] <= len(step):
                heads.append(at)
                at += step[at]
            heads = np.array(heads, np.int64)
            codes = blocks[heads]
            if places:
                full = codes.ravel()
                stop = np.flatnonzero(full == 252)
                end = int(stop[0]) if len(stop) else len(full)
                yield int(np.count_nonzero(full[:end])), where_at
                if len(stop):
                    return
                where_at += at * 8
                rest = rest[at * 8 :]
                continue
            raw = codes == 253
            where = heads[:, None] + np.cumsum(raw, 1)
            flat, where = codes.ravel(), where.ravel()
            out = number[flat]
            is_raw = flat == 253
            out[is_raw] = np.ascontiguousarray(blocks).view(np.uint64).ravel()[where[is_raw]]
            stop = np.flatnonzero(flat == 252)
            end = int(stop[0]) if len(stop) else len(flat)
            keep = flat[:end] != 0
            yield out[:end][keep]
            if len(stop):
                return
            rest = rest[at * 8 :]

    def _counted(self) -> int:
        if self.compression == 0:
            with open_binary(self.path) as f:
                return (f.seek(0, 2) - self.data_at) // max(1, self.record)
        cells = (n for n, _ in self._cells(places=True)) if self.compression == 1 else map(len, self._cells())
        return sum(cells) * 8 // max(1, self.record)

    def records(self, start, count, step):
        if self.compression == 0:
            yield from super().records(start, count, step)
            return
        width, at, held, stop = self.record // 8, 0, np.zeros(0, np.uint64), start + count
        if self.resume:
            at = -(-self.resume[0] // width)
            skip = at * width - self.resume[0]
        else:
            skip = 0
        for some in self._cells():
            some, skip = some[skip:], max(0, skip - len(some))
            held = np.concatenate([held, some])
            n = len(held) // width
            block, held = held[: n * width], held[n * width :]
            a, b = max(start - at, 0), min(stop - at, n)
            for k in range(a, b, step):
                m = min(step, b - k)
                yield at + k, block[k * width : (k + m) * width].view(np.uint8).reshape(m, self.record)
            at += n
            if at >= stop:
                return

    def taggable(self):
        return [c.name for c in self.columns if c.missing]

    def decode(self, block, column, tags, empty_null):
        c = column
        if c.storage == "string":
            return self._strings(block, c, tags, empty_null)
        v = cells(block, c.offset, 8, self.end + "f8").astype("f8")
        bits = v.view(np.uint64)
        null = np.isnan(v) | np.isin(bits, np.array(NOT_VALUES, np.uint64))
        user = np.zeros(len(v), bool)
        low, high = c.missing.get("range", (1.0, 0.0))
        user |= (v >= low) & (v <= high) & ~null
        for m in c.missing.get("values", ()):
            user |= v == m
        tag = None
        if tags:
            names = c.extra.get("tag_labels", c.labels)
            single = c.missing.get("values", ())
            say = lambda x: names.get(x) or (number_text(x) if x in single else "MISSING")
            texts = {x: say(x) for x in set(v[user].tolist())}
            tag = pa.array([texts[x] if u else None for x, u in zip(v.tolist(), user.tolist(), strict=True)], pa.string())
        null = null | user
        if c.kind == "double":
            return array(v, null, "double"), tag
        if c.kind == "time":
            return array(*temporal(v, null, "time", 0, self.clip), "time"), tag
        return array(*temporal(v, null, c.kind, SPSS_SECONDS), c.kind), tag

    def _strings(self, block, c, tags, empty_null):
        parts, at, left = [], c.offset, c.width
        while left > 0:
            n = min(left, 255)
            parts.append(block[:, at : at + n])
            at += 256 if left > 255 else -(-n // 8) * 8
            left -= n
        raw = np.ascontiguousarray(np.concatenate(parts, axis=1))
        items = raw.view(f"S{c.width}").ravel()
        out = strings(items if raw.all() else [b.replace(b"\0", b"") for b in items.tolist()], self.encoding, empty_null, cut_nul=False)
        gone = set(c.missing.get("strings", ()))
        if not gone:
            return out, pa.nulls(len(out), pa.string()) if tags else None
        values = out.to_pylist()
        names = c.extra.get("tag_labels", c.labels)
        tag = pa.array([names.get(s, s) if s in gone else None for s in values], pa.string()) if tags else None
        return pa.array([None if s in gone else s for s in values], pa.string()), tag

    def metadata(self) -> dict:
        def one(c: Column) -> dict:
            m = c.missing
            return {"name": c.name, "short_name": c.extra["short"], "type": c.storage, "label": c.label or None, "format": c.format, **{k: c.extra[k] for k in ("format_type", "format_width", "format_decimals", "measure", "display_width", "alignment")}, "string_width_bytes": c.width if c.storage == "string" else None, "value_labels": dict(c.labels) or None, "missing_range": m.get("range"), "missing_doubles": m.get("values"), "missing_strings": m.get("strings")}

        return {"row_count": self.rows, "file_label": self.label or None, "compression": {0: "none", 1: "rle", 2: "zlib"}.get(self.compression), "version": self.version, "data_offset": self.data_at, "encoding": self.encoding, "variables": [one(c) for c in self.columns]}
