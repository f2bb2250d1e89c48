"""Spark data sources over the format readers: sas7bdat, xpt, dta, sav (and zsav), por.

Options: ``columns`` (JSON list; nothing else is decoded), ``tagged`` (JSON list of columns whose missing codes come as
``<name>\\x01tag``), ``tagLabels``, ``emptyNull``, ``rowIndex`` (name of a column with the row's place in the file), ``nRows``, ``offset``,
``partitions``, ``batchRows``, ``timeAs``, ``periods``, ``filters`` (JSON list of [column, operator, value]).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .base import KINDS, Source
from .dta import Dta
from .files import file_size
from .por import Por
from .sas7bdat import Sas7bdat
from .sav import Sav
from .xpt import Xpt

READERS = {"sas7bdat": Sas7bdat, "xpt": Xpt, "dta": Dta, "sav": Sav, "por": Por}
TAG = "\x01tag"
CELLS, LEAST_ROWS, MOST_ROWS = 2_000_000, 1_000, 100_000
#: Bytes that the text columns of a batch have at most, but for a batch of one row.
TEXT_BYTES = 16 << 20
SPLIT_BYTES = 64 << 20
SPARK = {"byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}


def open_source(path: str, fmt: str, periods: bool = False) -> Source:
    return Dta(path, periods) if fmt == "dta" else READERS[fmt](path)


def batch_rows(columns: int, asked: int | None = None, text: int = 0) -> int:
    """Rows of a batch: about two million cells, between a thousand and a hundred thousand rows, fewer where the ``text``
    bytes of a row are many."""
    return asked or max(1, min(max(LEAST_ROWS, min(MOST_ROWS, CELLS // max(1, columns))), TEXT_BYTES // max(1, text)))


def schema_of(source: Source, names: list[str] | None, tagged: list[str], index: str | None, time_as: str) -> T.StructType:
    out = T.StructType()
    for c in source.wanted(names):
        kind = T.LongType() if c.kind == "time" and time_as != "time" else T.TimeType(6) if c.kind == "time" else SPARK[c.kind]
        about = {k: v for k, v in (("label", c.label), ("format", c.format)) if v}
        if c.labels:
            about["value_labels"] = json.dumps({str(k): v for k, v in c.labels.items()})
        out.add(T.StructField(c.name, kind, True, about))
        if c.name in tagged:
            out.add(c.name + TAG, T.StringType())
    if index:
        out.add(index, T.LongType())
    return out


class Rows(InputPartition):
    """Rows of a file; ``resume`` is where decoding may begin. With ``share`` (k, n), rows are the k-th of n parts, and the
    task reads the file's header itself."""

    def __init__(self, start: int, count: int, path: str | None = None, resume=None, share: tuple[int, int] | None = None):
        self.start, self.count, self.path, self.resume, self.share = start, count, path, resume, share


class _Options:
    def __init__(self, fmt: str, options):
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        number = lambda k: int(options[k]) if options.get(k) not in (None, "") else None
        self.fmt, self.path = fmt, options.get("path")
        self.files = json.loads(options.get("files") or "[]")
        self.columns = json.loads(options["columns"]) if options.get("columns") else None
        self.tagged = json.loads(options.get("tagged") or "[]")
        self.tag_labels = flag("tagLabels")
        self.empty_null, self.periods = flag("emptyNull"), flag("periods")
        self.tests = [Test(*f) for f in json.loads(options.get("filters") or "[]")]
        self.index, self.time_as = options.get("rowIndex") or None, options.get("timeAs") or "time"
        self.rows, self.offset, self.partitions, self.batch = number("nRows"), number("offset") or 0, number("partitions"), number("batchRows")

    def source(self, path: str | None = None) -> Source:
        s = open_source(path or self.path, self.fmt, self.periods)
        s.clip = self.time_as == "time"
        for c in s.columns:
            if c.name in self.tagged:
                c.extra["tag_labels"] = _tag_names(c) if self.tag_labels else {}
        return s


def _tag_names(c) -> dict:
    """Labels of missing codes: those of a column's label set whose codes are tags, and, for SPSS, of its missing values."""
    first = {"byte": 101, "int": 32741, "long": 2147483621}.get(c.storage)
    if c.storage in ("number", "string"):
        return dict(c.labels)
    own = {}
    for code, label in c.labels.items():
        for base in {first, 2147483621} - {None}:
            if isinstance(code, int) and 1 <= code - base <= 26:
                own[f".{chr(96 + code - base)}"] = label
    return own


class Reader(DataSourceReader):
    def __init__(self, options: _Options, schema: T.StructType):
        self.o = options
        self.source = options.source()
        self.names = [f.name for f in schema.fields if f.name != options.index and not f.name.endswith(TAG)]
        self.fields = [(f.name, f.dataType) for f in schema.fields]

    def partitions(self):
        if self.o.files:
            # a file whose rows can only be found by decoding what is before them is one task's
            sizes = [(f, max(1, -(-file_size(f) // SPLIT_BYTES)) if self.source.divisible() else 1) for f in self.o.files]
            return [Rows(0, 0, f, share=(k, n)) for f, n in sizes for k in range(n)]
        n = self.o.partitions or max(8, -(-self.source.bytes_of_rows() // SPLIT_BYTES))
        found = self.source.splits(n, self.o.offset, self.o.rows)
        return [Rows(a, k, resume=self.source.resume_at(a)) for a, k in found] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        source, start, count = self.source, partition.start, partition.count
        if partition.share:
            source, (k, n) = self.o.source(partition.path), partition.share
            if source.divisible():
                a, b = source.rows * k // n, source.rows * (k + 1) // n
                start, count = a, b - a
            else:
                (start, count), = source.splits(1) or [(0, 0)]
            _same(self.source, source, self.names)
        source.resume = partition.resume
        yield from decode(source, self.o, self.fields, self.names, start, count)


def _same(first: Source, other: Source, names: list[str]) -> None:
    """Files read together must hold the same columns, of the same kinds."""
    kinds = {c.name: c.kind for c in other.wanted(names)}
    for c in first.wanted(names):
        if kinds[c.name] != c.kind:
            raise ValueError(f"{other.path}: {c.name!r} is of kind {kinds[c.name]}, in {first.path} of kind {c.kind}")


def decode(source: Source, o: _Options, fields, names, start: int, count: int) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows that pass the filters."""
    if count <= 0:
        return
    kinds = {c.name: c.kind for c in source.columns}
    wanted = names or [c.name for c in source.columns[:1]]
    tagged, text = {n for n, _ in fields if n.endswith(TAG)}, sum(c.width for c in source.wanted(wanted) if c.storage == "string")
    step = batch_rows(len(names), o.batch, text)
    for at, got in source.batches(start, count, wanted, {n.removesuffix(TAG) for n in tagged}, o.empty_null, step):
        rows = len(next(iter(got.values()))[0]) if got else 0
        arrays = []
        for name, kind in fields:
            if name == o.index and name not in kinds:
                arrays.append(pa.array(np.arange(at, at + rows, dtype=np.int64)))
            elif name in tagged:
                tags = got[name.removesuffix(TAG)][1]
                arrays.append(tags if tags is not None else pa.nulls(rows, pa.string()))
            else:
                a = got[name][0]
                if kinds[name] == "time":
                    a = pc.divide(a, 1000) if o.time_as != "time" else a.cast(KINDS["time"][1])
                arrays.append(a)
        batch = pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])
        for test in o.tests:
            batch = batch.filter(test(batch))
        if batch.num_rows:
            yield batch


COMPARE = {"=": pc.equal, "==": pc.equal, "!=": pc.not_equal, "<>": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}


class Test:
    """A condition on a column as a function of a batch; as in SQL, one that is null doesn't hold. Values may be given as text."""

    def __init__(self, name: str, op: str, value=None):
        self.name, self.op, self.value = name, op.lower().strip(), value
        if self.op not in COMPARE and self.op not in ("in", "not in", "is null", "is not null"):
            raise ValueError(f"unknown operator {op!r} in a filter")
        if (value is None) != self.op.startswith("is ") or self.op.endswith("in") and any(v is None for v in value):
            raise ValueError(f"the filter {name!r} {op} needs {'no value' if self.op.startswith('is ') else 'values that are not null'}")

    def __call__(self, batch: pa.RecordBatch) -> pa.Array:
        col = batch.column(self.name)
        if self.op.startswith("is "):
            return pc.is_null(col) if self.op == "is null" else pc.is_valid(col)
        if self.op in COMPARE:
            return COMPARE[self.op](col, _cast([self.value], col.type)[0])
        found = pc.is_in(col, _cast(self.value, col.type))
        return pc.and_(pc.is_valid(col), found if self.op == "in" else pc.invert(found))


def _cast(values: list, kind: pa.DataType) -> pa.Array:
    """The values in a column's type, or in a wider one where they don't fit it."""
    made = pa.array(values)
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        return made.cast(pa.float64()) if pa.types.is_floating(made.type) else made
    return made.cast(kind)


class _Statistical(DataSource):
    fmt = ""

    @classmethod
    def name(cls):
        return cls.fmt

    def schema(self):
        o = _Options(self.fmt, self.options)
        path = o.path
        if os.path.isdir(path):  # a stream's folder: the first file tells
            found = _listed(path, self.fmt)
            if not found:
                raise ValueError(f"{path} holds no .{self.fmt} file that could tell the schema")
            path = found[0]
        return schema_of(o.source(path), o.columns, o.tagged, o.index, o.time_as)

    def reader(self, schema):
        o = _Options(self.fmt, self.options)
        return Reader(o, schema)

    def streamReader(self, schema):
        return FolderReader(_Options(self.fmt, self.options), schema)


def _listed(folder: str, fmt: str) -> list[str]:
    """Files of a format, oldest first."""
    endings = (".sav", ".zsav") if fmt == "sav" else (".xpt", ".xport") if fmt == "xpt" else (f".{fmt}",)
    with os.scandir(folder) as found:
        return [p for _, p in sorted((e.stat().st_mtime_ns, e.path) for e in found if e.is_file() and e.name.endswith(endings) and not e.name.startswith("."))]


class FolderReader(DataSourceStreamReader):
    """New files of a folder as micro-batches, in the order of their times. An offset holds the names of all files seen, so
    each is read once, whatever its time. Files mustn't be removed or changed."""

    def __init__(self, options: _Options, schema: T.StructType):
        self.o, self.fields = options, [(f.name, f.dataType) for f in schema.fields]
        self.names = [n for n, _ in self.fields if n != options.index and not n.endswith(TAG)]

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": [os.path.basename(p) for p in _listed(self.o.path, self.o.fmt)]}

    def partitions(self, start, end):
        out, before = [], set(start["files"])
        for path in (os.path.join(self.o.path, n) for n in end["files"] if n not in before):
            s = self.o.source(path)
            found = s.splits(self.o.partitions or max(1, s.bytes_of_rows() // SPLIT_BYTES))
            out += [Rows(a, k, path, s.resume_at(a)) for a, k in found]
        return out

    def read(self, partition: Rows):
        source = self.o.source(partition.path)
        source.resume = partition.resume
        yield from decode(source, self.o, self.fields, self.names, partition.start, partition.count)


SOURCES = [type(f.capitalize() + "DataSource", (_Statistical,), {"fmt": f, "__module__": __name__}) for f in READERS]
globals().update({c.__name__: c for c in SOURCES})


def register(spark: SparkSession) -> None:
    for c in SOURCES:
        spark.dataSource.register(c)
