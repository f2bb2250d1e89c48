"""Scanning and writing statistical files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metadata as meta
from . import options as opt
from .functions.text import clock_text
from .operators import transforms as tr
from .sources import datasource as ds
from .sources.files import listed
from .sources.sas7bcat import read_sas7bcat

TIME = "spark.sql.timeType.enabled"


def normalized_catalog(catalog) -> dict[str, dict] | None:
    """A catalog (a path or {format: {code: label}}) by upper-case format name without a dot at its end."""
    if catalog is None:
        return None
    own = catalog if isinstance(catalog, dict) else read_sas7bcat(catalog)
    return {k.rstrip(".").upper(): v for k, v in own.items()}


def _catalog_labels(source, catalog: dict[str, dict]) -> dict[str, dict]:
    return {c.name: catalog[key] for c in source.columns if (key := c.format.rstrip(".").upper()) and key in catalog}


def scan(
    spark: SparkSession,
    path: str | list[str],
    *,
    threads=None,
    missing_string_as_null: bool = False,
    value_labels_as_strings: bool = False,
    preserve_order=False,
    compress=None,
    reader: StatReader | None = None,
    schema_overrides: dict | None = None,
    strict_schema: bool = True,
    batch_size: int | None = None,
    informative_nulls=None,
    catalog=None,
    columns: list[str] | None = None,
    n_rows: int | None = None,
    offset: int | None = None,
    time_as: str = "time",
    num_partitions: int | None = None,
    true_periods: bool = False,
    filters: list[tuple] | None = None,
) -> DataFrame:
    """A lazy DataFrame over a statistical file; the extension says which format.

    ``columns`` are all that is decoded (Spark can't prune a Python source by itself). ``filters`` are conditions that all
    hold, such as ``[("age", ">", 30), ("sex", "in", ["f"]), ("income", "is not null")]``, on the file's own values; the
    source evaluates them before batches are made. They are part of the frame, so it may be used any number of times.
    Rows come in the file's order unless something reorders them.
    A list of paths, or a pattern with ``*`` or ``?``, is read as one frame: the first file (by name) gives schema and
    labels, tasks read the headers of their own files. ``preserve_order`` adds their place in the file (``row_index``, the last column) or sorts by it (``sort``).
    ``informative_nulls`` keeps user-defined missing codes beside, within or instead of the values. ``time_as``: times of
    day as Spark's TIME, as text, or as microseconds. ``threads`` is accepted and ignored: partitions run in parallel.
    """
    nulls, squeeze, order = opt.informative_nulls(informative_nulls), opt.compress(compress), opt.preserve_order(preserve_order)
    if time_as not in ("time", "string", "micros"):
        raise ValueError("time_as must be 'time', 'string' or 'micros'")
    overrides = schema_overrides if schema_overrides is not None else (reader.schema_overrides if reader else None)
    files = _several(path)
    if files:
        if n_rows is not None or offset is not None or (order and order.mode != "buffered"):
            raise ValueError("rows of several files have no common order: n_rows, offset and row indexes are for one file")
        path = files[0]
        if len({opt.format_of(f) for f in files}) > 1:
            raise ValueError("files that are read together must be of one format")
    fmt = opt.format_of(path)
    if str(path).endswith(".sas7bcat"):
        raise ValueError("a catalog holds labels, not rows: read it with read_sas7bcat or pass it as catalog=")
    ds.register(spark)
    source = reader.source if reader and reader.path == path else ds.open_source(path, fmt, true_periods)
    names = _base_columns(source, columns, nulls, order)
    tests = [list(f) for f in filters or []]
    if unknown := {f[0] for f in tests} - {c.name for c in source.columns}:
        raise ValueError(f"{path} has no column {', '.join(sorted(unknown))}")
    for f in tests:
        ds.Test(*f)
    if names is not None:
        names += [n for n in dict.fromkeys(f[0] for f in tests) if n not in names]
    tagged = []
    if nulls:
        asked = None if nulls.columns == "all" else set(nulls.columns)
        if asked and (unknown := asked - {c.name for c in source.columns}):
            raise ValueError(f"{path} has no column {', '.join(sorted(unknown))}")
        tagged = [n for n in source.taggable() if (asked is None or n in asked) and (names is None or n in names)]
        _no_clashes(source, nulls, tagged, order)
    index = order.row_index_name if order and order.mode != "buffered" else None
    if index and any(c.name == index for c in source.columns):
        raise ValueError(f"the file has a column {index!r}; choose another row_index_name")
    if time_as == "time" and any(c.kind == "time" for c in source.wanted(names)):
        spark.conf.set(TIME, "true")
    given = {"columns": json.dumps(names) if names is not None else None, "tagged": json.dumps(tagged), "tagLabels": str(bool(nulls and nulls.use_value_labels)).lower(), "emptyNull": str(missing_string_as_null).lower(), "rowIndex": index, "nRows": n_rows, "offset": offset, "partitions": num_partitions or _partitions(spark, source), "batchRows": batch_size, "timeAs": time_as, "periods": str(true_periods).lower(), "filters": json.dumps(tests, default=str) if tests else None, "files": json.dumps(files) if files else None}
    df = spark.read.format(fmt).options(**{k: v for k, v in given.items() if v is not None}).load(path)
    if time_as == "string":
        df = df.select(*[clock_text(F.col(f"`{f.name}`")).alias(f.name) if any(c.name == f.name and c.kind == "time" for c in source.columns) else F.col(f"`{f.name}`") for f in df.schema.fields])
    if value_labels_as_strings:
        if fmt in ("dta", "sav", "por"):
            df = tr.labelled(df, {c.name: c.labels for c in source.columns if c.labels})
        elif catalog is not None:
            df = tr.labelled(df, _catalog_labels(source, normalized_catalog(catalog)), host_text=True)
    if nulls:
        df = tr.informative(df, nulls, {n: n + ds.TAG for n in tagged})
    if squeeze:
        df = tr.compressed(df, squeeze)
    if overrides:
        df = tr.overridden(df, overrides, strict_schema)
    if order and order.mode == "sort":
        df = df.orderBy(index).drop(index)
    if columns is not None:
        df = df.select(*[f"`{c}`" for c in columns], *([f"`{index}`"] if index and index in df.columns and index not in columns else []))
    return df


def _several(path) -> list[str]:
    """The files that a list or a pattern names, in the order of their names; nothing for a single path."""
    if isinstance(path, list | tuple):
        found = sorted(map(str, path))
    elif re.search(r"[*?]", str(path)):
        found = listed(str(path))
    else:
        return []
    if not found:
        raise ValueError(f"no file matches {path!r}")
    return found


def _partitions(spark: SparkSession, source) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-source.bytes_of_rows() // ds.SPLIT_BYTES))


def _base_columns(source, columns, nulls, order) -> list[str] | None:
    """The file's columns behind requested ones: a missing code's column stands for the column it is of."""
    if columns is None:
        return None
    have, out = {c.name for c in source.columns}, []
    for c in columns:
        if order and order.mode == "row_index" and c == order.row_index_name:
            continue
        base = c
        if c not in have and nulls and nulls.mode == "separate_column" and c.endswith(nulls.suffix):
            base = c[: -len(nulls.suffix)]
        if base not in have:
            raise ValueError(f"{source.path} has no column {c!r}")
        if base not in out:
            out.append(base)
    return out


def _no_clashes(source, nulls, tagged, order) -> None:
    have = {c.name for c in source.columns}
    if nulls.mode == "separate_column":
        for n in tagged:
            if n + nulls.suffix in have:
                raise ValueError(f"the column {n + nulls.suffix!r} for missing codes exists already")
            if order and order.mode != "buffered" and n + nulls.suffix == order.row_index_name:
                raise ValueError(f"{order.row_index_name!r} is the name of a column for missing codes")


def read(spark: SparkSession, path: str, *, columns: list[str] | None = None, **options) -> DataFrame:
    """:func:`scan` for all that takes no catalog; still lazy."""
    if "catalog" in options:
        raise TypeError("read() takes no catalog; use scan()")
    return scan(spark, path, columns=columns, **options)


def batches(df: DataFrame, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """A DataFrame's rows, in its order, as record batches, which no task or driver turns into rows; the driver holds one
    partition at a time."""
    size, held = ds.batch_rows(len(df.columns), rows), []

    def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as stream:
                stream.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])

    def made(least: int) -> Iterator[pa.RecordBatch]:
        while (n := sum(t.num_rows for t in held)) >= least and n:
            whole = pa.concat_tables(held)
            yield whole.slice(0, size).combine_chunks().to_batches()[0]
            held[:] = [whole.slice(size)]

    for r in df.mapInArrow(packed, "batch binary").toLocalIterator():
        held.append(pa.ipc.open_stream(bytes(r["batch"])).read_all())
        yield from made(size)
    yield from made(1)


def foreach_batch(df: DataFrame, handle: Callable[[pa.RecordBatch], None]) -> int:
    """Call ``handle`` with each record batch, in the tasks that hold them; the number of rows. A task that is run again
    calls it again."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            handle(b)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return sum(r["n"] for r in df.mapInArrow(run, "n long").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r["n"])


class StatReader:
    """A file with its schema, metadata and data; the header is parsed once."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.path, self.options = spark, path, options
        self.format = opt.format_of(path)
        self.schema_overrides = options.get("schema_overrides")
        self._source = None

    @property
    def source(self):
        if self._source is None:
            self._source = ds.open_source(self.path, self.format, self.options.get("true_periods", False))
        return self._source

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def metadata(self) -> dict:
        return self.source.metadata()

    @property
    def metadata_df(self) -> DataFrame:
        return meta.frame(self.spark, self.metadata)

    @property
    def catalog_labels(self) -> dict[str, dict] | None:
        """Labels by column, from the catalog that the reader was given."""
        catalog = normalized_catalog(self.options.get("catalog"))
        return None if catalog is None else _catalog_labels(self.source, catalog)

    @property
    def column_info(self) -> list[dict]:
        return meta.column_info(self.metadata)

    @property
    def file_info(self) -> dict:
        return meta.file_info(self.metadata)

    @property
    def df(self) -> DataFrame:
        return scan(self.spark, self.path, reader=self, **self.options)


def schema(spark: SparkSession, path: str) -> T.StructType:
    return StatReader(spark, path).schema


def metadata_json(path: str) -> str:
    return json.dumps(ds.open_source(path, opt.format_of(path)).metadata(), default=str)


_ALLOWED = {
    "dta": {"value_labels", "variable_labels", "variable_format", "compress", "data_label", "threads"},
    "sav": {"value_labels", "variable_labels", "variable_measure", "variable_display_width", "variable_alignment", "variable_format", "file_label", "byte_codes", "threads"},
    "xpt": {"version", "table_name", "file_label", "variable_labels", "variable_format", "storage_widths"},
    "por": {"file_label", "variable_labels"},
}


def write(df: DataFrame, path: str, *, format: str | None = None, metadata=None, **kwargs) -> None:
    """Write a DataFrame as .dta, .sav, .zsav, .xpt or .por; the extension or ``format`` says which.

    ``metadata`` (a reader's dictionary or frame) gives labels and formats for the columns that are there; keyword
    arguments win over it.
    """
    fmt = (format or str(path).rsplit(".", 1)[-1]).lower().lstrip(".")
    if fmt in ("sas7bdat", "sas"):
        raise NotImplementedError("SAS data sets can't be written; use write_xpt or write_sas_bundle")
    fmt = {"zsav": "sav", "xport": "xpt"}.get(fmt, fmt)
    if fmt not in _ALLOWED:
        raise ValueError(f"can't write {fmt!r} files; formats: dta, sav, zsav, xpt, por")
    suffix = str(path).rsplit(".", 1)[-1].lower()
    fits = {"dta": ("dta",), "sav": ("sav", "zsav"), "xpt": ("xpt", "xport"), "por": ("por",)}[fmt]
    if suffix not in fits:
        raise ValueError(f"a {fmt} file must end in {' or '.join('.' + s for s in fits)}")
    _write(df, path, fmt, metadata, kwargs)


def write_parts(df: DataFrame, folder: str, format: str, *, metadata=None, **kwargs) -> None:
    """Write each partition of a DataFrame, in its task, to a file of its own in a new or empty folder, all of one schema;
    names follow the partitions' order, so that ``scan(spark, folder + "/*.dta")`` reads them back. Partitions without
    rows get none, but for the first. Options are those of :func:`write`."""
    suffix = format.lower().lstrip(".")
    fmt = {"zsav": "sav", "xport": "xpt"}.get(suffix, suffix)
    if fmt not in _ALLOWED:
        raise ValueError(f"can't write {format!r} files; formats: dta, sav, zsav, xpt, por")
    _write(df, folder, fmt, metadata, kwargs, each=suffix)


def _write(df: DataFrame, path: str, fmt: str, metadata, kwargs: dict, each: str | None = None) -> None:
    if unknown := set(kwargs) - _ALLOWED[fmt]:
        raise TypeError(f"unknown arguments for {fmt}: {', '.join(sorted(unknown))}")
    if metadata is not None:
        kwargs = _with_metadata(df, fmt, metadata, kwargs)
    from .sinks.dta import write_dta
    from .sinks.por import write_por
    from .sinks.sav import write_sav
    from .sinks.xpt import write_xpt

    {"dta": write_dta, "sav": write_sav, "xpt": write_xpt, "por": write_por}[fmt](df, path, each=each, **kwargs)


def _with_metadata(df: DataFrame, fmt: str, metadata, kwargs: dict) -> dict:
    spark = df.sparkSession
    base = metadata if isinstance(metadata, DataFrame) else meta.frame(spark, metadata)
    named = {"variable_labels", "value_labels", "variable_format", "variable_measure", "variable_display_width", "variable_alignment"}
    over = meta.from_kwargs(spark, **{k: v for k, v in kwargs.items() if k in named})
    found = meta.to_kwargs(meta.merged(base, over), df.columns)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    found["value_labels"] = {k: v for k, v in found["value_labels"].items() if k not in texts}
    if fmt == "dta":
        found["variable_format"] = {k: v for k, v in found["variable_format"].items() if v.startswith("%")}
    elif fmt == "sav":
        ok = {k: v for k, v in found["variable_format"].items() if meta.spss_format(v)[0]}
        found["variable_format"] = {k: v for k, v in ok.items() if (meta.spss_format(v)[0] in ("A", "AHEX")) == (k in texts)}
        found["variable_measure"] = {k: v for k, v in found["variable_measure"].items() if v != "unknown"}
    given = {k: v for k, v in found.items() if v and k in _ALLOWED[fmt]}
    label = None if isinstance(metadata, DataFrame) else metadata.get("file_label") or metadata.get("data_label")
    key = "data_label" if fmt == "dta" else "file_label"
    return {**({key: label} if label else {}), **{k: v for k, v in kwargs.items() if k not in named}, **given}


def write_xpt(df: DataFrame, path: str, **kwargs) -> None:
    write(df, path, format="xpt", **kwargs)


def write_por(df: DataFrame, path: str, **kwargs) -> None:
    write(df, path, format="por", **kwargs)


def write_sas_bundle(df: DataFrame, path: str, **kwargs) -> tuple[str, str]:
    from .sinks.sas_bundle import write_sas_bundle as go

    return go(df, path, **kwargs)
