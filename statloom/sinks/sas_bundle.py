"""A CSV file and a SAS program that imports it with formats and labels."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sas_days, sas_seconds
from .encode import plain, stats, unique_names
from .parts import Parts


def sas_values(df: DataFrame) -> DataFrame:
    """Dates as days, timestamps as seconds since 1960, times as seconds of the day, flags as 0 and 1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = sas_days(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = sas_seconds(c)
        elif isinstance(f.dataType, T.TimeType):
            s = c.cast("string")
            c = F.split(s, ":")[0].cast("double") * 3600 + F.split(s, ":")[1].cast("double") * 60 + F.split(s, ":")[2].cast("double")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def _quoted(s: str) -> str:
    return '"' + str(s).replace('"', '""') + '"'


def write_sas_bundle(df: DataFrame, path: str, dataset_name: str = "dataset", value_labels: dict | None = None, variable_labels: dict | None = None, library: str = "work", delete_csv_on_import: bool = False) -> tuple[str, str]:
    """Write ``<path>.csv`` and ``<path>.sas``; both paths are returned."""
    base = os.path.splitext(str(path))[0]
    names = unique_names(df.columns, r"[^A-Za-z0-9_]", 32, "d", fold=True)
    rename = dict(zip(df.columns, names, strict=True))
    df = plain(df).toDF(*names)
    kinds, seen, values = {f.name: f.dataType for f in df.schema.fields}, stats(df), sas_values(df)

    def encode(batch, state):
        sink = pa.BufferOutputStream()
        pacsv.write_csv(batch, sink, pacsv.WriteOptions(include_header=False, quoting_style="needed"))
        return sink.getvalue().to_pybytes(), b""

    with Parts(values, base + ".csv", encode) as parts, open(parts.path, "wb") as out:
        out.write((",".join(names) + "\n").encode())
        parts.into(out)
    labels = {rename.get(k, k): v for k, v in (value_labels or {}).items() if rename.get(k, k) in kinds}
    lines, used = [], {}
    if labels:
        lines.append("proc format;")
        for n, own in labels.items():
            text = isinstance(kinds[n], T.StringType)
            used[n] = f"{'$' if text else ''}{n[:30]}_f"
            lines.append(f"  value {used[n]}")
            lines += [f"    {_quoted(k) if text else k} = {_quoted(v)}" for k, v in own.items()] + ["  ;"]
        lines.append("run;")
    lines += [f"data {library}.{unique_names([dataset_name], r'[^A-Za-z0-9_]', 32, 'd')[0]};", f"  infile {_quoted(os.path.basename(base) + '.csv')} dsd dlm=',' firstobs=2 lrecl=32767 truncover;"]
    for n, kind in kinds.items():
        lines.append(f"  length {n} {'$' + str(max(1, seen[n][0] or 1)) if isinstance(kind, T.StringType) else 8};")
    for n, kind in kinds.items():
        fmt = used.get(n) or ("date9" if isinstance(kind, T.DateType) else "datetime20" if isinstance(kind, T.TimestampNTZType) else "time8" if isinstance(kind, T.TimeType) else None)
        if fmt:
            lines.append(f"  format {n} {fmt}.;")
    for k, v in (variable_labels or {}).items():
        if rename.get(k, k) in kinds and v:
            lines.append(f"  label {rename.get(k, k)} = {_quoted(v)};")
    lines += ["  input", *[f"    {n}{' $' if isinstance(kind, T.StringType) else ''}" for n, kind in kinds.items()], "  ;", "run;"]
    if delete_csv_on_import:
        lines += [f"filename gone {_quoted(os.path.basename(base) + '.csv')};", "data _null_;", '  rc = fdelete("gone");', "run;"]
    with open(base + ".sas", "w") as out:
        out.write("\n".join(lines) + "\n")
    return base + ".csv", base + ".sas"
