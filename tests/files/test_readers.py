"""Readers against files by other writers and against bytes built from the formats' descriptions."""

import datetime as dt
import json
import struct

import numpy as np
import pandas as pd
import pytest

import statloom
from statloom.sources.dta import Dta
from statloom.sources.files import SasError, SpssError, StataError
from statloom.sources.sas7bdat import Sas7bdat
from statloom.sources.sas_codecs import ross, run_lengths
from statloom.sources.xpt import ibm_to_ieee, ieee_to_ibm

from . import build


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- Stata -------------------------------------------------------------------------------------------------------------

FRAME = pd.DataFrame({"b": np.array([1, -5, 100], "i1"), "i": np.array([1000, -32767, 7], "i2"), "l": np.array([100000, -1, 2147483620], "i4"), "f": np.array([1.5, np.nan, -2.25], "f4"), "d": [0.1, np.nan, 1e300], "s": ["abc", "", "é"], "t": pd.to_datetime(["2020-01-01", "1960-01-01", "1899-12-31"])})


@pytest.mark.parametrize("version", [114, 117, 118, 119])
@pytest.mark.parametrize("order", ["<", ">"])
def test_dta_by_pandas(spark, tmp_path, version, order):
    path = str(tmp_path / "x.dta")
    frame = FRAME.copy() if version >= 118 else FRAME.assign(s=["abc", "", "e"])
    frame["c"] = pd.Categorical(["low", "high", "low"], ["low", "high"])
    frame.to_stata(path, version=version, byteorder=order, write_index=False, convert_dates={"t": "td"}, variable_labels={"b": "a label"}, **({"convert_strl": ["s"]} if version >= 117 and order == "<" else {}))  # pandas writes long strings in this machine's byte order only
    got = rows(statloom.scan(spark, path))
    assert [r[:4] for r in got] == [(1, 1000, 100000, 1.5), (-5, -32767, -1, None), (100, 7, 2147483620, -2.25)]
    assert [r[4] for r in got] == [0.1, None, 1e300] and [r[5] for r in got] == frame["s"].tolist()
    assert [r[6] for r in got] == [dt.date(2020, 1, 1), dt.date(1960, 1, 1), dt.date(1899, 12, 31)] and [r[7] for r in got] == [0, 1, 0]
    assert [r[0] for r in rows(statloom.scan(spark, path, value_labels_as_strings=True, columns=["c"]))] == ["low", "high", "low"]
    m = statloom.StatReader(spark, path).metadata
    assert m["version"] == version and m["row_count"] == 3 and m["variables"][0]["label"] == "a label" and m["variables"][7]["value_labels"] == {0: "low", 1: "high"}
    assert rows(statloom.scan(spark, path, missing_string_as_null=True, columns=["s"]))[1] == (None,)


def patched(tmp_path, codes):
    """A file whose cells are overwritten with missing codes: {column: [bytes]}."""
    path = tmp_path / "p.dta"
    frame = pd.DataFrame({"b": np.zeros(3, "i1"), "i": np.zeros(3, "i2"), "l": np.zeros(3, "i4"), "f": np.zeros(3, "f4"), "d": np.zeros(3)})
    frame.to_stata(path, version=118, write_index=False)
    s, raw = Dta(str(path)), bytearray(path.read_bytes())
    for c in s.columns:
        for k, b in enumerate(codes[c.name]):
            at = s.data_at + k * s.record + c.offset
            raw[at : at + len(b)] = b
    path.write_bytes(raw)
    return str(path)


CODES = {
    "b": [bytes([101]), bytes([102]), bytes([127])],
    "i": [struct.pack("<h", v) for v in (32741, 32742, 32767)],
    "l": [struct.pack("<i", v) for v in (2147483621, 2147483622, 2147483647)],
    "f": [struct.pack("<I", 0x7F000000 + k * 0x800) for k in (0, 1, 26)],
    "d": [struct.pack("<Q", 0x7FE0000000000000 + (k << 40)) for k in (0, 1, 26)],
}


def test_stata_missing_codes(spark, tmp_path):
    path = patched(tmp_path, CODES)
    assert rows(statloom.scan(spark, path)) == [(None,) * 5] * 3
    got = rows(statloom.scan(spark, path, informative_nulls=True))
    assert [r[1::2] for r in got] == [(None,) * 5, (".a",) * 5, (".z",) * 5]
    got = rows(statloom.scan(spark, path, informative_nulls={"columns": ["d"], "mode": "struct"}, columns=["d", "b"]))
    assert [tuple(r[0]) for r in got] == [(None, None), (None, ".a"), (None, ".z")]
    assert rows(statloom.scan(spark, path, informative_nulls={"mode": "merged_string"}, columns=["f"])) == [(None,), (".a",), (".z",)]
    assert rows(statloom.scan(spark, path, informative_nulls=True, columns=["d_null"])) == [(None,), (".a",), (".z",)]
    with pytest.raises(ValueError):
        statloom.scan(spark, path, informative_nulls={"suffix": "", "mode": "separate_column"})
    with pytest.raises(ValueError):
        statloom.scan(spark, path, informative_nulls={"mode": "other"})


def test_partitions_projection_limits_and_filters_agree(spark, tmp_path):
    path = str(tmp_path / "n.dta")
    pd.DataFrame({"a": np.arange(5000, dtype="i4"), "b": np.arange(5000) / 7, "s": [f"r{k % 13}" for k in range(5000)]}).to_stata(path, write_index=False, version=118)
    full = rows(statloom.scan(spark, path, num_partitions=1))
    for n in (2, 7):
        assert rows(statloom.scan(spark, path, num_partitions=n, batch_size=100)) == full
    assert rows(statloom.scan(spark, path, columns=["s", "a"])) == [(r[2], r[0]) for r in full]
    assert rows(statloom.scan(spark, path, offset=1234, n_rows=77)) == full[1234:1311] and rows(statloom.scan(spark, path, n_rows=0)) == []
    pushed = statloom.scan(spark, path, filters=[("a", ">", 4000), ("s", "in", ["r1", "r2"]), ("b", "is not null")])
    assert rows(pushed) == [r for r in full if r[0] > 4000 and r[2] in ("r1", "r2")]
    assert rows(statloom.scan(spark, path, columns=["s"], filters=[("a", "<", 10), ("b", "<", "1")[:2] + (1,)])) == [(r[2],) for r in full[:7]]
    # a filtered frame answers every query, narrowed or not, and the session pushes nothing else
    some = statloom.scan(spark, path, filters=[("a", "<", 100)])
    assert some.filter("a < 5").count() == 5 and some.count() == 100 and some.filter("a >= 5").count() == 95
    for bad in ([("a", "~", 1)], [("a", "=", None)], [("nothing", "=", 1)]):
        with pytest.raises(ValueError):
            statloom.scan(spark, path, filters=bad)
    df = statloom.scan(spark, path)
    assert rows(df.filter("a > 4000 and s in ('r1', 'r2') and b is not null")) == [r for r in full if r[0] > 4000 and r[2] in ("r1", "r2")]
    assert rows(df.filter("not (a >= 10)")) == full[:10] and df.filter("s = 'r5'").count() == sum(r[2] == "r5" for r in full)
    assert [r[-1] for r in rows(statloom.scan(spark, path, preserve_order="row_index"))] == list(range(5000))
    assert rows(statloom.scan(spark, path, preserve_order="sort")) == rows(statloom.scan(spark, path, preserve_order=True)) == full
    assert sum(b.num_rows for b in statloom.batches(df, 999)) == 5000
    with pytest.raises(ValueError):
        statloom.scan(spark, path, columns=["nothing"])
    assert json.loads(statloom.metadata_json(path))["row_count"] == 5000


def test_bad_files(spark, tmp_path):
    for name, error in (("x.dta", StataError), ("x.sav", SpssError), ("x.por", SpssError), ("x.xpt", SasError), ("x.sas7bdat", SasError)):
        p = tmp_path / name
        p.write_bytes(b"nonsense" * 100)
        with pytest.raises(error):
            statloom.StatReader(spark, str(p)).metadata
    for name in ("x.txt", "x.DTA", "x"):
        with pytest.raises(ValueError):
            statloom.scan(spark, str(tmp_path / name))


# -- SAS ---------------------------------------------------------------------------------------------------------------

COLUMNS = [("id", "num", "", "the id"), ("name", 12, "$", "a name"), ("day", "num", "DATE", ""), ("at", "num", "DATETIME", ""), ("clock", "num", "TIME", ""), ("x", "num", "BEST", "")]
DATA = [(k, f"n{k % 5}   ", 21915.0 + k, 1.9e9 + k, 3661.0 + k, k / 3) for k in range(200)]


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("kind", ["plain", "mix", "rle", "rdc"])
def test_sas7bdat(spark, tmp_path, wide, end, kind):
    path = tmp_path / "x.sas7bdat"
    build.sas7bdat(path, COLUMNS, DATA, wide, end, kind if kind in ("rle", "rdc") else None, 7 if kind == "mix" else 0)
    got = rows(statloom.scan(spark, str(path), num_partitions=3))
    assert len(got) == 200 and [r[0] for r in got] == [float(k) for k in range(200)]
    k = 41
    assert got[k] == (41.0, "n1", dt.date(2020, 1, 1) + dt.timedelta(days=k), dt.datetime(1960, 1, 1) + dt.timedelta(seconds=1.9e9 + k), dt.time(1, 1, 1 + k), k / 3)
    if kind != "mix" or wide:
        theirs = pd.read_sas(path, encoding="utf-8")
        assert theirs["x"].tolist() == [r[5] for r in got] and theirs["name"].str.strip().tolist() == [r[1] for r in got]
    m = statloom.StatReader(spark, str(path)).metadata
    assert (m["compression"], m["row_count"], m["table_name"], m["sas_release"]) == (kind if kind in ("rle", "rdc") else "none", 200, "TESTTABLE", "9.0401M1")
    assert [c["label"] for c in m["columns"]][:2] == ["the id", "a name"]
    assert rows(statloom.scan(spark, str(path), columns=["x", "id"], offset=150, n_rows=3)) == [(k / 3, float(k)) for k in (150, 151, 152)]


def test_sas_rows_that_are_missing_or_look_like_headers(spark, tmp_path):
    path = tmp_path / "x.sas7bdat"
    build.sas7bdat(path, COLUMNS, DATA, True, "<", None, 0)
    path.write_bytes(path.read_bytes()[:-4096])
    with pytest.raises(SasError, match="its header says"):
        Sas7bdat(str(path))
    # a metadata page's rows start after four bytes of padding, whatever these hold
    for release, ok in ((b"9.0401M1", True), (b"9.0000M0", False)):
        build.sas7bdat(path, COLUMNS, DATA, False, "<", None, 7)
        raw = bytearray(path.read_bytes())
        raw[216 + 4 : 224 + 4] = release
        subs = int.from_bytes(raw[1024 + 20 : 1024 + 22], "little")
        at = 16 + 8 + subs * 12
        if at % 8 == 4:
            raw[1024 + at : 1024 + at + 4] = b"\1\2\3\4"
            path.write_bytes(raw)
            assert (rows(statloom.scan(spark, str(path)))[0] == rows_of_data(spark, tmp_path)[0]) == ok


def rows_of_data(spark, tmp_path):
    path = tmp_path / "plain.sas7bdat"
    build.sas7bdat(path, COLUMNS, DATA, True, "<", None, 0)
    return rows(statloom.scan(spark, str(path)))


def test_sas_missing_codes_and_catalog(spark, tmp_path):
    path = tmp_path / "m.sas7bdat"
    tags = [ord("X"), ord("_"), ord("."), 0, 2, 27]
    build.sas7bdat(path, [("y", "num", "YESNO", ""), ("sex", "num", "SEXFMT", "")], [(build.nan(t), 1.0) for t in tags] + [(1.0, 2.0), (5.0, 3.0)])
    assert [r[1] for r in rows(statloom.scan(spark, str(path), informative_nulls={"columns": ["y"]}))] == [".X", "._", None, "._", ".A", ".Z", None, None]
    cat = tmp_path / "formats.sas7bcat"
    build.catalog(cat, {"YESNO": [(0, "No"), (1, "Yes"), (b"\0\0\xfe\xff\xff\xff\xff\xff"[::1], "gone")], "SEXFMT": [(1, "Male"), (2, "Female")], "$TXT": [("a", "Alpha")]})
    found = statloom.read_sas7bcat(cat)
    assert found["SEXFMT"] == {1: "Male", 2: "Female"} and found["$TXT"] == {"a": "Alpha"} and {k: found["YESNO"][k] for k in (0, 1)} == {0: "No", 1: "Yes"}
    got = rows(statloom.scan(spark, str(path), catalog=str(cat), value_labels_as_strings=True))
    assert got[-2:] == [("Yes", "Female"), ("5.0", "3.0")] and got[0] == (None, "Male")
    assert statloom.StatReader(spark, str(path), catalog={"sexfmt.": {1: "M"}}).catalog_labels == {"sex": {1: "M"}}
    with pytest.raises(TypeError):
        statloom.read(spark, str(path), catalog=str(cat))


def test_sas_codecs():
    r = np.random.default_rng(1)
    for _ in range(50):
        row = bytes(r.choice([0, 32, 64, 65, 200], 300, p=[0.4, 0.3, 0.1, 0.1, 0.1]).astype(np.uint8))
        assert run_lengths(build.rle_literal(row), 300) == row and ross(build.rdc(row), 300) == row
    assert run_lengths(bytes([0x40, 1, 7]), 19) == b"\7" * 19 and run_lengths(bytes([0x60, 0]), 17) == b" " * 17 and run_lengths(bytes([0x20]) + b"q" * 96, 96) == b"q" * 96
    assert ross(b"\x80\x00" + bytes([0x10, 1, 9]), 35) == b"\x09" * 35


def test_ibm_floats():
    v = np.array([0.0, 1.0, -1.0, 118.625, -118.625, 0.1, 1e60, 1e-60, 3e-300])
    raw = ieee_to_ibm(v, np.zeros(len(v), bool))
    assert raw[3].tobytes() == bytes.fromhex("4276a00000000000") and raw[4].tobytes() == bytes.fromhex("c276a00000000000")
    back, null = ibm_to_ieee(raw)
    assert not null.any() and np.allclose(back[:-1], v[:-1], rtol=1e-15) and back[-1] == 0
    assert ibm_to_ieee(np.frombuffer(b".\0\0\0\0\0\0\0A\0\0\0\0\0\0\0_\0\0\0\0\0\0\0", np.uint8).reshape(3, 8))[1].all()


# -- SPSS --------------------------------------------------------------------------------------------------------------

NUM, DATE, TIME = 5 << 16 | 8 << 8 | 2, 20 << 16 | 11 << 8, 21 << 16 | 8 << 8
MISSING = struct.pack("<Q", 0xFFEFFFFFFFFFFFFF)


def spss_rows():
    out = []
    for k in range(300):
        cells = build.doubles(k % 10, k * 1.5, 13_000_000_000 + 86_400 * k, 3600 + k)
        if k % 7 == 3:
            cells[1] = MISSING
        out.append(cells + [f"text {k % 4}".encode().ljust(8), b" " * 8])
    return out


VARIABLES = [("Q1", 0, NUM, 2, struct.pack("<dd", 8, 9), "first question"), ("Q2", 0, NUM, -3, struct.pack("<ddd", 100, 110, 3), ""), ("DAY", 0, DATE, 0, b"", ""), ("CLOCK", 0, TIME, 0, b"", ""), ("TXT", 10, 1 << 16 | 10 << 8, 0, b"", "")]


@pytest.mark.parametrize("compression", [0, 1, 2])
@pytest.mark.parametrize("unknown", [False, True])
def test_sav(spark, tmp_path, compression, unknown):
    path = tmp_path / ("x.zsav" if compression == 2 else "x.sav")
    names = b"Q1=Question One\tTXT=Long Text"
    extras = struct.pack("<iiii", 7, 13, 1, len(names)) + names
    build.sav(path, VARIABLES, spss_rows(), compression, extras, [([(struct.pack("<d", 1), "one"), (struct.pack("<d", 9), "refused")], [1])], unknown=unknown)
    got = rows(statloom.scan(spark, str(path), num_partitions=3))
    assert len(got) == 300
    for k, r in enumerate(got):
        q2 = k * 1.5
        assert r[0] == (None if k % 10 in (8, 9) else k % 10) and r[1] == (None if k % 7 == 3 or 100 <= q2 <= 110 or q2 == 3 else q2)
        assert r[2] == dt.date(1582, 10, 14) + dt.timedelta(days=13_000_000_000 // 86_400 + k) and r[3] == dt.time(1, k // 60, k % 60) and r[4] == f"text {k % 4}"
    assert statloom.scan(spark, str(path)).columns == ["Question One", "Q2", "DAY", "CLOCK", "Long Text"]
    coded = rows(statloom.scan(spark, str(path), informative_nulls=True, columns=["Question One", "Question One_null", "Q2", "Q2_null"]))
    assert coded[8][1] == "8" and coded[9][1] == "refused" and coded[68][3] == "MISSING" and coded[2][3] == "3" and coded[3][3] is None
    named = rows(statloom.scan(spark, str(path), value_labels_as_strings=True, columns=["Question One"]))
    assert named[1] == ("one",) and named[2] == ("2",) and named[9] == (None,)
    m = statloom.StatReader(spark, str(path)).metadata
    assert m["compression"] == ("none", "rle", "zlib")[compression] and m["row_count"] == 300 and m["variables"][1]["missing_range"] == [100.0, 110.0]
    assert rows(statloom.scan(spark, str(path), offset=290, n_rows=5, columns=["Q2"])) == [(r[1],) for r in got[290:295]]


@pytest.mark.parametrize("compression", [1, 2])
def test_sav_splits_by_marks(tmp_path, monkeypatch, compression):
    from statloom.sources import sav

    monkeypatch.setattr(sav, "WINDOW", 64 * 64)
    path = tmp_path / "x.sav"
    build.sav(path, VARIABLES, spss_rows(), compression)
    whole = [b for _, block in sav.Sav(str(path)).records(0, 300, 1000) for b in block.tolist()]
    for n in (2, 5, 50):
        s = sav.Sav(str(path))
        got = []
        for a, k in s.splits(n):
            s.resume = s.resume_at(a)
            got += [b for _, block in s.records(a, k, 7) for b in block.tolist()]
        assert got == whole and (n < 5 or len({m for m in s.marks}) > 4)


def test_several_files(spark, tmp_path):
    for k in range(3):
        pd.DataFrame({"k": np.arange(k * 10, k * 10 + 5 + k, dtype="i4")}).to_stata(tmp_path / f"part{k}.dta", write_index=False, version=118)
    want = [(v,) for k in range(3) for v in range(k * 10, k * 10 + 5 + k)]
    assert sorted(rows(statloom.scan(spark, str(tmp_path / "part*.dta")))) == want
    assert sorted(rows(statloom.scan(spark, [str(tmp_path / f"part{k}.dta") for k in range(3)]).filter("k >= 0"))) == want
    with pytest.raises(ValueError):
        statloom.scan(spark, str(tmp_path / "none*.dta"))
    with pytest.raises(ValueError):
        statloom.scan(spark, str(tmp_path / "part*.dta"), n_rows=1)


def test_por_numbers():
    from statloom.sources.por import from_base30, to_base30

    r = np.random.default_rng(2)
    for v in [0.0, 1.0, -1.0, 0.5, 1 / 3, 29.0, 30.0, 1e-9, 1e17, -1e300, 1e-300, 123456.789, *r.normal(size=200), *(r.normal(size=50) * 1e12)]:
        assert from_base30(to_base30(v).rstrip("/")) == pytest.approx(v, rel=1e-14, abs=0)
    assert from_base30("1A.F") == 40.5 and from_base30("-2+1") == -60 and to_base30(None) == "*." and to_base30(29.5) == "T.F/"


def test_batches_pulled_and_pushed(spark, tmp_path):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.range(0, 2500, 1, 3).selectExpr("id", "cast(id as string) s", "timestamp_seconds(id) at", "make_time(1, 2, cast(3 as decimal(8, 6))) t", "if(id % 2 = 0, null, cast(id as double)) d")
    got = list(statloom.batches(df, 1000))
    assert [b.num_rows for b in got] == [1000, 1000, 500] and [x for b in got for x in b.column("id").to_pylist()] == list(range(2500))
    assert got[0].schema.names == df.columns and got[2].column("d").to_pylist()[:2] == [None, 2001.0]
    assert list(statloom.batches(df.limit(0))) == []
    folder = str(tmp_path)

    def handle(batch):
        import pathlib
        import uuid

        pathlib.Path(folder, uuid.uuid4().hex).write_text(str(batch.num_rows))

    assert statloom.foreach_batch(df, handle) == 2500 == sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert statloom.foreach_batch(df.limit(0), handle) == 0


@pytest.mark.parametrize("version,big", [(117, 0), (118, 0), (119, 0), (117, 32), (118, 16), (119, 24), (119, 16)])
def test_long_strings_of_both_byte_orders(spark, tmp_path, version, big):
    path = tmp_path / "l.dta"
    frame = pd.DataFrame({"k": np.arange(40, dtype="i4"), "a": [f"a{i % 7}" * (i % 5) for i in range(40)], "b": [f"b{i}" * 600 for i in range(40)]})
    frame.to_stata(path, version=version, convert_strl=["a", "b"], byteorder=">" if big else "<", write_index=False)
    if big:  # pandas writes the long strings of such files, and their references, with little-endian parts
        raw, bits = path.read_bytes(), {117: 32, 118: 16, 119: 24}[version]
        at, end = raw.index(b"<data>") + 6, raw.index(b"</data>")
        cells = np.frombuffer(raw[at:end], [("k", ">i4"), ("a", ">u8"), ("b", ">u8")]).copy()
        for c in "ab":
            v, o = cells[c] & ((1 << bits) - 1), cells[c] >> bits
            cells[c] = v << (64 - big) | o
        heads, here = b"", raw.index(b"<strls>") + 7
        wide = "Q" if version > 117 else "I"
        while raw[here : here + 3] == b"GSO":
            v, o, kind, n = struct.unpack_from("<I" + wide + "BI", raw, here + 3)
            here += 3 + struct.calcsize("<I" + wide + "BI")
            heads += b"GSO" + struct.pack(">I" + wide + "BI", v, o, kind, n) + raw[here : here + n]
            here += n
        path.write_bytes(raw[:at] + cells.tobytes() + b"</data><strls>" + heads + raw[here:])
    assert rows(statloom.scan(spark, str(path), batch_size=11)) == [tuple(r) for r in frame.itertuples(index=False)]


@pytest.mark.parametrize("name", ["sas7bdat_plain", "sas7bdat_rle", "sas7bdat_rdc"])
def test_sas_customers_never_pass_through_the_driver(spark, monkeypatch, name):
    """tasks make the pages of their rows."""
    from statloom.plans import catalog

    def refused(*a, **k):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refused)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 150


@pytest.mark.parametrize("kwargs", [{}, {"mix": 5}, {"compression": "rle", "wide": False, "end": ">"}, {"compression": "rdc"}])
def test_sas_pages_of_several_tasks(spark, tmp_path, kwargs):
    from statloom.plans.samples import sas7bdat_of

    df = spark.range(0, 700, 1, 5).filter("id < 140 or id >= 282").selectExpr("if(id % 9 = 0, null, id / 7) k", "concat('t', repeat('ab ', int(id % 7)), id) t")
    path = str(tmp_path / "x.sas7bdat")
    sas7bdat_of(df, path, [("k", "num", "", ""), ("t", 30, "", "")], **kwargs)
    got = rows(statloom.scan(spark, path, num_partitions=3))
    assert sorted(got, key=lambda r: r[1]) == sorted(rows(df), key=lambda r: r[1])
    sas7bdat_of(df.limit(2), path, [("k", "num", "", ""), ("t", 30, "", "")], **kwargs)
    assert statloom.scan(spark, path).count() == 2


def test_wide_texts_come_in_small_batches(spark, tmp_path):
    """texts of 64 MB in one column were an error, as Arrow makes several arrays of them."""
    from statloom.sources import base, datasource

    assert len(base.strings(np.full(32_000, b"x" * 2_117, "S2117"), "utf-8", False)) == 32_000
    assert datasource.batch_rows(3, None, 2_117) * 2_117 <= datasource.TEXT_BYTES and datasource.batch_rows(3, 50_000, 2_117) == 50_000
    df = spark.range(0, 32_000, 1, 1).selectExpr("id", "repeat('x', 2100 + int(id % 17)) t")
    path = str(tmp_path / "x.sav")
    statloom.write(df, path)
    back = statloom.scan(spark, path, num_partitions=1)
    assert back.selectExpr("count(1)", "sum(length(t))", "sum(id)").first() == df.selectExpr("count(1)", "sum(length(t))", "double(sum(id))").first()


def test_long_strings_in_small_pieces(spark, tmp_path, monkeypatch):
    """a batch's long strings are decoded some bytes at a time, whatever its number of rows."""
    from statloom.sources import dta

    df = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('x', 2000 + int(id)) a", "if(id % 3 = 0, '', repeat(string(id), 900)) b")
    path = str(tmp_path / "x.dta")
    statloom.write(df, path)
    monkeypatch.setattr(dta, "LONG_BYTES", 50_000)
    s = dta.Dta(path)
    got = list(s.batches(10, 280, ["id", "a", "b"], set(), False, 1000))
    assert len(got) > 10 and [a for a, _ in got] == [10, *np.cumsum([len(g["a"][0]) for _, g in got])[:-1] + 10]
    assert [tuple(r) for _, g in got for r in zip(*(g[c][0].to_pylist() for c in ("id", "a", "b")))] == rows(df)[10:290]
