"""Option semantics over formats: label tables, periods, date-time tails, large label sets, struct overrides."""

import datetime as dt
import struct

import numpy as np
import pandas as pd
import pytest

import statloom
from statloom import options
from statloom.sources.dta import Dta
from statloom.sources.xpt import sas_kind

from . import build


def rows(df):
    return [tuple(r) for r in df.collect()]


def with_formats(tmp_path, values, fmt):
    """A .dta file of doubles whose display format is overwritten."""
    path = tmp_path / "f.dta"
    pd.DataFrame({"v": np.array(values, float)}).to_stata(path, write_index=False, version=118)
    raw = path.read_bytes()
    path.write_bytes(raw.replace(b"%10.0g".ljust(57, b"\0"), fmt.encode().ljust(57, b"\0"), 1))
    return str(path)


@pytest.mark.parametrize(
    "fmt, value, plain, true",
    [
        ("%td", 21915, dt.date(2020, 1, 1), dt.date(2020, 1, 1)),
        ("%tm", 723, dt.date(1961, 12, 24), dt.date(2020, 4, 1)),
        ("%tq", 241, dt.date(1960, 8, 29), dt.date(2020, 4, 1)),
        ("%th", 121, dt.date(1960, 5, 1), dt.date(2020, 7, 1)),
        ("%tw", 3121, dt.date(1968, 7, 18), dt.date(2020, 1, 8)),
        ("%ty", 2020, dt.date(1965, 7, 13), dt.date(2020, 1, 1)),
        ("%tc", 1893456000000, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1)),
        ("%tcDDmonCCYY_HH:MM:SS", 1893456000000, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1)),
        ("%tcHH:MM:SS", 3661000, dt.time(1, 1, 1), dt.time(1, 1, 1)),
        ("%tcHH:MM:SS", -1000, dt.time(23, 59, 59), dt.time(23, 59, 59)),
    ],
)
def test_stata_times(spark, tmp_path, fmt, value, plain, true):
    path = with_formats(tmp_path, [value, np.nan], fmt)
    assert rows(statloom.scan(spark, path)) == [(plain,), (None,)]
    assert rows(statloom.scan(spark, path, true_periods=True)) == [(true,), (None,)]


def test_sas_kinds():
    for fmt, kind in {"DATETIME20": "timestamp", "date9": "date", "MMDDYY": "date", "TIME8": "time", "HHMM": "time", "DAY": "date", "QTR": "date", "BEST12": "double", "": "double", "E8601DT": "timestamp", "YYMMDD": "date"}.items():
        assert sas_kind(fmt) == kind


def test_many_labels_are_joined(spark, tmp_path):
    path = str(tmp_path / "m.dta")
    statloom.write(spark.range(3000).selectExpr("cast(id as int) as c").coalesce(1), path, value_labels={"c": {k: f"label {k}" for k in range(2500)}})
    got = rows(statloom.scan(spark, path, value_labels_as_strings=True).orderBy("c"))
    assert len(got) == 3000 and ("label 2499",) in got and ("2500",) in got


def test_missing_code_labels(spark, tmp_path):
    path = str(tmp_path / "l.dta")
    statloom.write(spark.createDataFrame([(1,), (2,), (3,)], "c int").coalesce(1), path, value_labels={"c": {1: "one"}})
    s, raw = Dta(path), bytearray(open(path, "rb").read())
    raw[s.data_at + 1] = 102
    at = raw.index(b"<lbl>") + 5 + 4 + 129 + 3 + 8 + 4
    raw[at : at + 4] = struct.pack("<i", 2147483622)  # the label is now .a's
    open(path, "wb").write(raw)
    assert rows(statloom.scan(spark, path, informative_nulls=True)) == [(1, None), (None, "one"), (3, None)]
    assert rows(statloom.scan(spark, path, informative_nulls={"use_value_labels": False})) == [(1, None), (None, ".a"), (3, None)]
    assert statloom.scan(spark, path, informative_nulls={"mode": "struct"}, schema_overrides={"c": "double"}).dtypes == [("c", "struct<c:double,null_indicator:string>")]
    with pytest.raises(ValueError):
        statloom.scan(spark, path, informative_nulls=True, preserve_order={"mode": "row_index", "row_index_name": "c_null"})


def test_spss_string_missing_and_long_labels(spark, tmp_path):
    path = tmp_path / "s.sav"
    word = struct.pack("<i", 6) + b"LONGST" + struct.pack("<i", 300) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"abc" + struct.pack("<i", 5) + b"Label"
    wide = struct.pack("<iiii", 7, 14, 1, 13) + b"LONGST=00300\0"
    ext = wide + struct.pack("<iiii", 7, 21, 1, len(word)) + word
    variables = [("T", 8, 1 << 16 | 8 << 8, 1, b"NA      ", ""), ("LONGST", 255, 1 << 16 | 255 << 8, 0, b"", ""), ("LONG1", 48, 1 << 16 | 48 << 8, 0, b"", "")]
    full = b"x" * 255 + b" " + b"y" * 45 + b" " * 3
    cells = lambda t, b: [t.ljust(8), *[b.ljust(304)[k : k + 8] for k in range(0, 304, 8)]]
    build.sav(path, variables, [cells(b"NA", b"abc"), cells(b"ok", full)], 0, ext)
    got = rows(statloom.scan(spark, str(path), informative_nulls=True))
    assert got == [(None, "NA", "abc"), ("ok", None, "x" * 255 + "y" * 45)]
    assert rows(statloom.scan(spark, str(path), value_labels_as_strings=True, columns=["LONGST"]))[0] == ("Label",)
    frame = {r["name"]: r for r in statloom.StatReader(spark, str(path)).metadata_df.collect()}
    assert frame["LONGST"]["string_width_bytes"] == 300 and frame["LONGST"]["value_label_labels"] == ["Label"] and frame["T"]["format_type"] == "A"


def test_options_are_checked():
    assert options.compress(True).enabled and options.compress(False) is None and options.compress({"enabled": False}) is None and options.preserve_order("sort").mode == "sort"
    for make in (lambda: options.preserve_order("x"), lambda: options.preserve_order({"row_index_name": ""}), lambda: options.informative_nulls({"columns": "some"}), lambda: options.informative_nulls({"nothing": 1}), lambda: options.format_of("x.csv")):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        options.compress(3)


def test_texts_of_a_column():
    """Columns of ASCII characters, decoded at once, give what their values give one by one."""
    import numpy as np

    from statloom.sources.base import strings

    def one(b, encoding, empty_null, cut):
        t = (b.split(b"\0")[0] if cut else b).rstrip(b" \0").decode(encoding, "replace")
        return None if empty_null and not t else t

    plain = [b"", b"a", b" a b  ", b"tab\t", b"~", b"   "]
    for items in ([], [b""], plain, [*plain, b"a\0b", b"\0 "], [*plain, "é".encode(), b"\xff"], [*plain, b"+AGE-", b"\x1b$B0!", b"~{VP~}", b"\x1b$)C\x0e0!\x0f"]):
        for encoding in ("utf-8", "cp1252", "ascii", "cp932", "cp037", "utf-7", "iso2022_jp", "iso2022_kr", "hz"):
            for empty_null in (False, True):
                for cut in (False, True):
                    assert strings(items, encoding, empty_null, cut).to_pylist() == [one(b, encoding, empty_null, cut) for b in items]
    assert strings(np.array(plain, "S6"), "utf-8", False).to_pylist() == ["", "a", " a b", "tab\t", "~", ""]
