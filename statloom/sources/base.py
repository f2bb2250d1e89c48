"""What every format's reader offers: columns, rows, splits, and decoded batches of rows."""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .files import open_binary

#: Spark SQL and Arrow types of the kinds of columns.
KINDS = {
    "byte": ("byte", pa.int8()),
    "short": ("short", pa.int16()),
    "int": ("int", pa.int32()),
    "float": ("float", pa.float32()),
    "double": ("double", pa.float64()),
    "string": ("string", pa.string()),
    "date": ("date", pa.date32()),
    "timestamp": ("timestamp_ntz", pa.timestamp("us")),
    "time": ("time(6)", pa.time64("ns")),
}
DAY_S, SAS_DAYS, SPSS_SECONDS = 86_400, 3_653, 12_219_379_200


@dataclass
class Column:
    name: str
    kind: str
    label: str = ""
    format: str = ""
    offset: int = 0
    width: int = 8
    storage: str = ""
    label_set: str = ""
    labels: dict = field(default_factory=dict)
    missing: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def numeric(self) -> bool:
        return self.storage != "string"


class Source:
    """A parsed file header. Small and picklable: it goes to the tasks that decode rows."""

    path: str
    columns: list[Column]
    rows: int
    record: int
    data_at: int
    #: Whether times that no clock shows (negative, a day or more) are null; if not, times must be read as numbers.
    clip = True
    #: Where decoding of a range of rows may begin, from :meth:`resume_at`; None is the first row.
    resume = None

    def resume_at(self, row: int):
        return None

    def divisible(self) -> bool:
        """Whether rows in the middle are found without decoding those before them."""
        return True

    def splits(self, n: int, start: int = 0, count: int | None = None) -> list[tuple[int, int]]:
        """About ``n`` consecutive (start, count) ranges of rows."""
        stop = self.rows if count is None else min(self.rows, start + count)
        if stop <= start:
            return []
        step = max(1, -(-(stop - start) // max(1, n)))
        return [(a, min(step, stop - a)) for a in range(start, stop, step)]

    def bytes_of_rows(self) -> int:
        return self.rows * max(1, self.record)

    def wanted(self, names: list[str] | None) -> list[Column]:
        if names is None:
            return self.columns
        by = {c.name: c for c in self.columns}
        if missing := [n for n in names if n not in by]:
            raise ValueError(f"{self.path} has no column {', '.join(map(repr, missing))}")
        return [by[n] for n in names]

    def records(self, start: int, count: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of fixed-width records as (first row, bytes by row)."""
        with open_binary(self.path) as f:
            f.seek(self.data_at + start * self.record)
            while count > 0:
                n = min(step, count)
                raw = f.read(n * self.record)
                n = len(raw) // self.record
                if not n:
                    return
                yield start, np.frombuffer(raw, np.uint8)[: n * self.record].reshape(n, self.record)
                start, count = start + n, count - n

    def decode(self, block: np.ndarray, column: Column, tags: bool, empty_null: bool) -> tuple[pa.Array, pa.Array | None]:
        raise NotImplementedError

    def batches(self, start: int, count: int, names: list[str] | None, tagged: set[str], empty_null: bool, step: int) -> Iterator[tuple[int, dict]]:
        """(first row, {name: (values, tags or None)}) for rows from ``start`` on."""
        wanted = self.wanted(names)
        for at, block in self.records(start, count, step):
            yield at, {c.name: self.decode(block, c, c.name in tagged, empty_null) for c in wanted}

    def taggable(self) -> list[str]:
        """Columns that can hold user-defined missing codes."""
        return [c.name for c in self.columns if c.numeric]

    def metadata(self) -> dict:
        raise NotImplementedError


def cells(block: np.ndarray, offset: int, width: int, dtype: str) -> np.ndarray:
    """A fixed-width column of a block of records."""
    return np.ascontiguousarray(block[:, offset : offset + width]).view(dtype).ravel()


def array(values: np.ndarray, null: np.ndarray | None, kind: str) -> pa.Array:
    """Values of a kind; dates in days, timestamps in microseconds, times in nanoseconds."""
    plain = {"date": pa.int32(), "timestamp": pa.int64(), "time": pa.int64()}.get(kind)
    want = KINDS[kind][1]
    if plain is None:
        return pa.array(values.astype(want.to_pandas_dtype(), copy=False), want, mask=null)
    with np.errstate(invalid="ignore"):
        safe = np.where(null, 0, values) if null is not None else values
        made = pa.array(safe.astype(plain.to_pandas_dtype()), plain, mask=null)
        return made if kind == "time" else made.cast(want)


def temporal(v: np.ndarray, null: np.ndarray, kind: str, epoch_s: int, clip: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Seconds since an epoch before 1970 by ``epoch_s`` as a date, a timestamp or a time of day."""
    v = np.where(null, 0.0, v)
    if kind == "date":
        return np.trunc((np.trunc(v) - epoch_s) / DAY_S), null
    if kind == "timestamp":
        return np.trunc((v - epoch_s) * 1e6), null
    ns = np.trunc(v * 1e9)
    return ns, null | (ns < 0) | (ns >= DAY_S * 1e9) if clip else null


def text(block: np.ndarray, offset: int, width: int, encoding: str, empty_null: bool, cut_nul: bool = True) -> pa.Array:
    """A fixed-width text column: cut at NUL, without trailing spaces."""
    raw = np.ascontiguousarray(block[:, offset : offset + width])
    items = raw.view(f"S{width}").ravel() if width else [b""] * len(raw)
    return strings(items, encoding, empty_null, cut_nul)


@functools.cache
def _holds_ascii(encoding: str) -> bool:
    """Whether the first 128 bytes mean in a character set what they mean in ASCII, whatever stands before them."""
    every = bytes(range(128))
    return not codecs.lookup(encoding).name.startswith(("iso2022", "hz", "utf-7")) and every.decode(encoding, "replace") == every.decode("ascii")


def strings(items: list[bytes] | np.ndarray, encoding: str, empty_null: bool, cut_nul: bool = True) -> pa.Array:
    """Texts without trailing spaces and NULs, and, with ``cut_nul``, without what follows a NUL. A column of ASCII
    characters without NUL is decoded at once."""
    raw = pa.array(items, pa.binary())
    if isinstance(raw, pa.ChunkedArray):  # of many bytes
        raw = raw.combine_chunks()
    _, ends, held = raw.buffers()
    held = np.frombuffer(held, np.uint8)[: np.frombuffer(ends, np.int32)[len(raw)]] if len(raw) and held.size else np.zeros(0, np.uint8)
    if not len(held) or (held.max() < 128 and held.min() > 0 and _holds_ascii(encoding)):
        out = pc.utf8_rtrim(raw.cast(pa.string()), " ")
        return pc.if_else(pc.equal(out, ""), pa.scalar(None, pa.string()), out) if empty_null else out
    items, out = raw.to_pylist(), []
    known: dict[bytes, str | None] = {}
    for b in items:
        if b not in known:
            s = (b.split(b"\0", 1)[0] if cut_nul else b).rstrip(b" \0")
            t = s.decode(encoding, "replace")
            known[b] = None if empty_null and not t else t
            if len(known) > 100_000:
                out.append(known.pop(b))
                known.clear()
                continue
        out.append(known[b])
    return pa.array(out, pa.string())


#: Names of character sets in files that Python knows by other names.
ENCODINGS = {"windows-1252": "cp1252", "us-ascii": "ascii", "utf8": "utf-8", "macintosh": "mac-roman", "windows-31j": "cp932", "euc-cn": "gb2312"}


def codec(name: str, default: str = "cp1252") -> str:
    """A Python codec for a character set's name."""
    name = ENCODINGS.get(name.strip().lower(), name.strip().lower())
    try:
        return codecs.lookup(name).name
    except LookupError:
        return default
