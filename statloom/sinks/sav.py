"""Writing SPSS system files in UTF-8: .sav with fixed 8-byte cells or byte codes, .zsav with byte codes in zlib blocks."""

from __future__ import annotations

import io
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.base import SPSS_SECONDS
from ..sources.sav import ALIGNMENTS, FORMAT_NAMES, MEASURES, SYSMIS
from .encode import fitted, numbers, padded, plain, stats
from .parts import save

MOST_BYTES = 32_767
#: Fixed value: bytes of a zlib block before it is deflated, at most. Bias: what byte codes for whole numbers are raised by.
BLOCK, BIAS = 0x3FF000, 100
#: Fixed value: a cluster whose first code ends the data.
END = bytes([252]) + bytes(7)
TYPES = {v: k for k, v in FORMAT_NAMES.items()}


class Plan:
    def __init__(self, field, seen, short: str):
        self.name, self.kind, self.short = field.name, field.dataType, short
        self.text = isinstance(self.kind, T.StringType)
        self.width = max(1, seen[field.name][0] or 0) if self.text else 0
        if self.width > MOST_BYTES:
            raise ValueError(f"column {self.name!r} holds a text of {self.width} bytes; SPSS files have room for {MOST_BYTES}")
        self.format = (1, min(self.width, 255), 0) if self.text else (20, 11, 0) if isinstance(self.kind, T.DateType) else (22, 20, 0) if isinstance(self.kind, T.TimestampNTZType) else (21, 8, 0) if isinstance(self.kind, T.TimeType) else (5, 8, 2)

    def segments(self) -> list[int]:
        """Declared widths: one, or for very long texts 255 each and the rest."""
        if self.width <= 255:
            return [self.width]
        n = -(-self.width // 252)
        return [255] * (n - 1) + [self.width - 252 * (n - 1)]

    def bytes(self, a: pa.Array) -> np.ndarray:
        if self.text:
            sizes = self.segments()
            room = padded(a, max(self.width, 1), b" ")
            out, at = [], 0
            for w in sizes:
                part = room[:, at : at + min(w, 255)]
                full = -(-w // 8) * 8
                out.append(np.concatenate([part, np.full((len(room), full - part.shape[1]), 32, np.uint8)], axis=1))
                at += min(w, 255)
            return np.concatenate(out, axis=1)
        v, null = numbers(a)
        if isinstance(self.kind, T.DateType):
            v = v.astype(np.float64) * 86_400 + SPSS_SECONDS
        elif isinstance(self.kind, T.TimestampNTZType):
            v = np.floor_divide(v, 1_000_000) + SPSS_SECONDS
        elif isinstance(self.kind, T.TimeType):
            v = np.floor_divide(v, 1_000_000)
        v = v.astype("<f8")
        null = null | ~np.isfinite(v)
        return np.where(null, np.array(SYSMIS, "<u8").view("<f8"), v).astype("<f8").view(np.uint8).reshape(-1, 8)


def short_names(names: list[str]) -> list[str]:
    """Unique upper-case names of at most eight bytes."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[^A-Z0-9_@#$.]", "", n.upper())
        base = base if re.match(r"[A-Z@]", base) else "V" + base
        x, k = base[:8], 0
        while x in out:
            k += 1
            x = base[: 8 - len(str(k)) - 1] + f"_{k}"
        out.append(x)
    return out


def _format(name: str, text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"([A-Za-z]+)(\d+)(?:\.(\d+))?", text)
    if not m or m[1].upper() not in TYPES or int(m[2]) < 1:
        raise ValueError(f"{text!r} of {name!r} is no SPSS format")
    return TYPES[m[1].upper()], min(int(m[2]), 255), int(m[3] or 0)


def _choice(names: dict[int, str], value, what: str) -> int:
    by = {v: k for k, v in names.items()}
    if isinstance(value, str) and value.lower() in by:
        return by[value.lower()]
    if value in names:
        return value
    raise ValueError(f"unknown {what} {value!r}")


def byte_coded(room: np.ndarray, text: np.ndarray) -> bytes:
    """Rows of cells as byte codes: clusters of eight codes, each with the cells after it that no code stands for. ``text``
    says which cells of a row are of texts. The last cluster is filled up by codes that mean nothing."""
    cells = np.ascontiguousarray(room).view("<u8").ravel()
    of_text = np.tile(text, len(room))
    v = cells.view("<f8")
    with np.errstate(invalid="ignore"):
        whole = ~of_text & (v >= 1 - BIAS) & (v <= 251 - BIAS)
    whole[whole] = (v[whole] == np.floor(v[whole])) & ((v[whole] != 0) | (cells[whole] == 0))
    codes = np.full(-(-len(cells) // 8) * 8, 253, np.uint8)
    codes[len(cells) :] = 0
    codes[: len(cells)][whole] = (v[whole] + BIAS).astype(np.uint8)
    codes[: len(cells)][~of_text & (cells == SYSMIS)] = 255
    codes[: len(cells)][of_text & (cells == int.from_bytes(b" " * 8, "little"))] = 254
    raw = codes == 253
    count = raw.reshape(-1, 8).sum(1)
    out = np.empty(len(count) + int(count.sum()), "<u8")
    is_code = np.zeros(len(out), bool)
    is_code[np.arange(len(count)) + np.cumsum(count) - count] = True
    out[is_code] = codes.view("<u8")
    out[~is_code] = cells[raw[: len(cells)]]
    return out.tobytes()


def _blocks(coded: bytes) -> tuple[bytes, bytes]:
    """Deflated blocks, and their sizes before and after."""
    cut = [coded[k : k + BLOCK] for k in range(0, len(coded), BLOCK)]
    small = [zlib.compress(b) for b in cut]
    return b"".join(small), b"".join(struct.pack("<ii", len(b), len(z)) for b, z in zip(cut, small, strict=True))


def _extension(sub: int, size: int, body: bytes) -> bytes:
    return struct.pack("<iiii", 7, sub, size, len(body) // size) + body


def write_sav(df: DataFrame, path: str, value_labels: dict | None = None, variable_labels: dict | None = None, variable_measure: dict | None = None, variable_display_width: dict | None = None, variable_alignment: dict | None = None, variable_format: dict | None = None, file_label: str = "", byte_codes: bool = False, threads=None, each: str | None = None) -> None:
    """Write ``df``, in its order, as a .sav file with plain cells or, with ``byte_codes``, codes for them, or as a .zsav file
    with codes in zlib blocks. Nulls are system-missing or spaces;
    times have whole seconds; texts take the width of their widest value."""
    df = plain(df)
    for n in df.columns:
        if len(n.encode()) > 64:
            raise ValueError(f"the name {n!r} has more than 64 bytes")
    seen = stats(df)
    plans = [Plan(f, seen, s) for f, s in zip(df.schema.fields, short_names(df.columns), strict=True)]
    by = {p.name: p for p in plans}
    for n, f in (variable_format or {}).items():
        if n in by:
            fmt = _format(n, f)
            if (fmt[0] in (1, 2)) != by[n].text:
                raise ValueError(f"the format {f!r} doesn't suit {n!r}")
            by[n].format = (fmt[0], min(by[n].width, 255), 0) if by[n].text else fmt
    for n, w in (variable_display_width or {}).items():
        if not isinstance(w, int) or w < 1:
            raise ValueError(f"the display width of {n!r} must be positive")
    for n in value_labels or {}:
        if n in by and by[n].text:
            raise ValueError(f"value labels of the text column {n!r} can't be written")

    squeezed = f".{each or path}".lower().endswith(".zsav")
    of_text = np.array([p.text for p in plans for w in p.segments() for _ in range(-(-w // 8) if p.text else 1)], bool)

    def encode(batch, state):
        room = np.concatenate([p.bytes(batch.column(k)) for k, p in enumerate(plans)], axis=1)
        if not squeezed:
            return byte_coded(room, of_text) if byte_codes else room.tobytes(), b""
        return _blocks(byte_coded(room, of_text))

    def finish(parts, out) -> None:
        places, heads, at = {}, [], 1
        body, display = b"", []
        for p in plans:
            places[p.name] = at
            label = fitted((variable_labels or {}).get(p.name), 255, f"the label of {p.name!r}")
            for k, w in enumerate(p.segments() if p.text else [0]):
                short = p.short if k == 0 else short_names([q.short for q in plans] + heads + [p.short])[-1]
                heads.append(short)
                kind, width, decimals = p.format if k == 0 else (1, min(w, 255), 0)
                fmt = kind << 16 | (min(w, 255) if p.text else width) << 8 | decimals
                body += struct.pack("<iiiiii", 2, w, int(bool(label) and k == 0), 0, fmt, fmt) + short.encode().ljust(8)
                if label and k == 0:
                    body += struct.pack("<i", len(label)) + label.ljust(-(-len(label) // 4) * 4)
                cells = -(-w // 8) if p.text else 1
                body += (struct.pack("<iiiiii", 2, -1, 0, 0, 0, 0) + b" " * 8) * (cells - 1)
                at += cells
                measure = _choice(MEASURES, (variable_measure or {}).get(p.name, "nominal" if p.text else "scale"), "measure")
                align = _choice(ALIGNMENTS, (variable_alignment or {}).get(p.name, "left" if p.text else "right"), "alignment")
                display += [measure, (variable_display_width or {}).get(p.name, 8), align]
        for n, own in (value_labels or {}).items():
            if n in by and own:
                body += struct.pack("<ii", 3, len(own))
                for code, label in sorted((float(k), str(v)) for k, v in own.items()):
                    b = label.encode()
                    if len(b) > 255:
                        raise ValueError(f"a value label of {n!r} has more than 255 bytes")
                    body += struct.pack("<dB", code, len(b)) + b.ljust((len(b) + 8) // 8 * 8 - 1)
                body += struct.pack("<iii", 4, 1, places[n])
        body += _extension(3, 4, struct.pack("<8i", 1, 0, 0, -1, 1, 1, 2, 65001))
        body += _extension(4, 8, struct.pack("<QQQ", SYSMIS, 0x7FEFFFFFFFFFFFFF, 0xFFEFFFFFFFFFFFFE))
        body += _extension(11, 4, struct.pack(f"<{len(display)}i", *display))
        body += _extension(13, 1, "\t".join(f"{p.short}={p.name}" for p in plans).encode())
        if long := [p for p in plans if p.width > 255]:
            body += _extension(14, 1, b"".join(f"{p.short}={p.width:05d}".encode() + b"\0\t" for p in long))
        body += _extension(16, 8, struct.pack("<qq", 1, parts.rows))
        body += _extension(20, 1, b"UTF-8")
        now = time.gmtime()
        rows = parts.rows if parts.rows < 2**31 else -1
        out.write((b"$FL3" if squeezed else b"$FL2") + b"@(#) SPSS DATA FILE statloom".ljust(60) + struct.pack("<iiiii", 2, at - 1, 2 if squeezed else int(byte_codes), 0, rows) + struct.pack("<d", float(BIAS)))
        out.write(time.strftime("%d %b %y%H:%M:%S", now).encode() + fitted(file_label, 64, "the file label").ljust(64) + bytes(3))
        out.write(body + struct.pack("<ii", 999, 0))
        if not squeezed:
            parts.into(out)
            if byte_codes:
                out.write(END)
            return
        sizes = io.BytesIO()
        parts.into(sizes, more=True)
        sizes, start = list(struct.iter_unpack("<ii", sizes.getvalue())), out.tell()
        trailer = start + 24 + sum(z for _, z in sizes)
        out.write(struct.pack("<qqq", start, trailer, 24 + 24 * len(sizes)))
        parts.into(out)
        out.write(struct.pack("<qqii", -BIAS, 0, BLOCK, len(sizes)))
        full, small = start, start + 24
        for b, z in sizes:
            out.write(struct.pack("<qqii", full, small, b, z))
            full, small = full + b, small + z

    save(df, path, encode, finish, each)
