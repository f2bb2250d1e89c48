"""Writers against independent readers, round trips, and what they reject."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

import statloom
from statloom import metadata as meta
from statloom.sources.dta import Dta

SCHEMA = "flag boolean, small tinyint, mid int, big bigint, f float, d double, s string, day date, at timestamp_ntz"
ROWS = [(True, 1, 100_000, 2**40, 1.5, 0.1, "abc", dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 10, 20, 30, 500_000)), (False, -127, -5, -(2**40), -2.25, 1e300, "é", dt.date(1959, 12, 31), dt.datetime(1950, 6, 7)), (None,) * 9]


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_dta_by_pandas(spark, tmp_path):
    path = str(tmp_path / "x.dta")
    statloom.write(frame(spark), path, value_labels={"mid": {-5: "minus", 100_000: "many"}}, variable_labels={"s": "text"})
    back = pd.read_stata(path, convert_categoricals=False)
    assert back["mid"].tolist()[:2] == [100_000, -5] and back["big"].tolist()[:2] == [2.0**40, -(2.0**40)] and back["s"].tolist() == ["abc", "é", ""]
    assert back["day"].tolist()[:2] == [pd.Timestamp("2020-01-01"), pd.Timestamp("1959-12-31")] and back["at"].tolist()[0] == pd.Timestamp("2020-01-01 10:20:30.5")
    assert back.isna().sum().tolist() == [1, 1, 1, 1, 1, 1, 0, 1, 1]
    with pd.io.stata.StataReader(path) as r:
        assert r.value_labels() == {"mid": {-5: "minus", 100_000: "many"}} and r.variable_labels()["s"] == "text"
    mine = rows(statloom.scan(spark, path))
    assert [r[3] for r in mine] == [2.0**40, -(2.0**40), None] and [r[8] for r in mine] == [ROWS[0][8], ROWS[1][8], None]
    assert [(c.name, c.storage) for c in Dta(path).columns][:6] == [("flag", "byte"), ("small", "byte"), ("mid", "long"), ("big", "double"), ("f", "float"), ("d", "double")]


def test_long_strings(spark, tmp_path):
    path, texts = str(tmp_path / "l.dta"), ["a" * 5000, "", "ends ", "nul\0in", "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(3).sortWithinPartitions("k")
    statloom.write(df, path)
    assert dict(pd.read_stata(path)[["k", "t"]].values.tolist())[0] == texts[0]
    assert dict(rows(statloom.scan(spark, path)))[0] == texts[0] and Dta(path).columns[1].extra["type"] == "strL"
    sav = str(tmp_path / "l.sav")
    long = [("b" * 3000,), ("c" * 255,), ("é" * 200,), ("",)]
    statloom.write(spark.createDataFrame(long, "t string"), sav)
    assert sorted(rows(statloom.scan(spark, sav))) == sorted(long)


@pytest.mark.parametrize("name", ["x.sav", "x.zsav", "x.xpt", "x.por"])
def test_round_trips(spark, tmp_path, name):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    path = str(tmp_path / name)
    df = frame(spark).select("mid", "d", "s", "day", F.date_trunc("second", "at").cast("timestamp_ntz").alias("at"), F.expr("make_time(10, 20, cast(30 as decimal(8,6)))").alias("t"))
    if name == "x.xpt":
        df = df.withColumn("d", F.when(F.abs("d") < 1e60, F.col("d")))
    statloom.write(df, path, **({"file_label": "about"} if name != "x.zsav" else {}), variable_labels={"d": "a double"})
    got, want = rows(statloom.scan(spark, path, missing_string_as_null=True)), rows(df)
    for g, w in zip(got, want):
        assert g[1] == (pytest.approx(w[1], rel=1e-14) if w[1] is not None else None) and (g[2] or "").rstrip() == (w[2] or "") and (g[0], *g[3:]) == (w[0], *w[3:])
    r = statloom.StatReader(spark, path)
    assert len(got) == 3 and (name == "x.zsav" or r.metadata["file_label"] == "about")
    labels = {x["name"].lower(): x["label"] for x in r.metadata_df.collect()}
    assert labels["d"] == "a double"
    assert rows(statloom.scan(spark, path, time_as="string"))[0][5] == "10:20:30" and rows(statloom.scan(spark, path, time_as="micros"))[0][5] == 37_230_000_000


def test_xpt5_by_pandas(spark, tmp_path):
    path = str(tmp_path / "x.xpt")
    data = [(1.0, 1.5, "Alice", dt.date(2020, 1, 1)), (2.0, -2.25, "Bob", dt.date(1960, 1, 1)), (3.0, 0.0, "Charlie", dt.date(2000, 6, 15)), (None, 100.0, None, None)]
    statloom.write(spark.createDataFrame(data, "id double, score double, name string, dt date").coalesce(1), path, version=5, table_name="SYNTH")
    back = pd.read_sas(path, encoding="utf-8")
    assert back["score"].tolist() == pytest.approx([1.5, -2.25, 0.0, 100.0]) and back["name"].fillna("").tolist() == ["Alice", "Bob", "Charlie", ""]
    # pandas leaves dates as days since 1960, and reads a zero as the smallest number
    assert back["dt"].tolist()[:3] == pytest.approx([(d - dt.date(1960, 1, 1)).days for *_, d in data[:3]])
    assert rows(statloom.scan(spark, path, missing_string_as_null=True)) == data and statloom.StatReader(spark, path).metadata["table_name"] == "SYNTH"
    assert rows(statloom.scan(spark, path, columns=["dt", "score"])) == [(r[3], r[1]) for r in data]
    wide = str(tmp_path / "v8.xpt")
    statloom.write(spark.createDataFrame(data, "a_long_identifier double, score double, name string, dt date").coalesce(1), wide, variable_labels={"score": "l" * 60})
    got = statloom.StatReader(spark, wide)
    assert got.metadata["xpt_version"] == 8 and got.metadata["columns"][0]["name"] == "a_long_identifier" and got.metadata["columns"][1]["label"] == "l" * 60


def test_metadata_round_trip(spark, tmp_path):
    first, second = str(tmp_path / "a.sav"), str(tmp_path / "b.sav")
    df = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "sex int, score int, t string")
    statloom.write(df, first, value_labels={"sex": {1: "Male", 2: "Female"}}, variable_labels={"sex": "Sex", "score": "Score"}, variable_measure={"sex": "nominal"}, variable_format={"score": "F5.0"})
    m = statloom.StatReader(spark, first).metadata
    statloom.write(statloom.scan(spark, first).select("sex", "t"), second, metadata=m, variable_labels={"sex": "changed"})
    got = {v["name"]: v for v in statloom.StatReader(spark, second).metadata["variables"]}
    assert set(got) == {"sex", "t"} and got["sex"]["label"] == "changed" and got["sex"]["value_labels"] == {1.0: "Male", 2.0: "Female"} and got["sex"]["measure"] == "nominal"
    statloom.write(statloom.scan(spark, first), str(tmp_path / "c.dta"), metadata=statloom.StatReader(spark, first).metadata_df)
    assert Dta(str(tmp_path / "c.dta")).columns[0].labels == {1: "Male", 2: "Female"}
    assert meta.coerced({"1.0": "a", "x": "b", 2: "c"}) == {1: "a", "x": "b", 2: "c"} and meta.spss_format("F10.2") == ("F", 10, 2) and meta.spss_format("%8.0g") == (None, None, None)


def test_sas_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"x,y', dt.date(1960, 1, 2), dt.datetime(1960, 1, 1, 0, 0, 2)), (2, None, None, None)], "num int, `a b` string, day date, at timestamp_ntz").coalesce(1)
    csv, sas = statloom.write_sas_bundle(df, str(tmp_path / "out"), value_labels={"num": {1: "one"}}, variable_labels={"a b": "text"}, delete_csv_on_import=True)
    assert open(csv).read().splitlines() == ["num,ab,day,at", '1,"q""x,y",1,2', "2,,,"]
    text = open(sas).read()
    assert "value num_f" in text and '1 = "one"' in text and "format day date9.;" in text and 'label ab = "text";' in text and "fdelete" in text


def test_rejections(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, s string")
    p = lambda n: str(tmp_path / n)
    for path, error, kwargs in [
        (p("x.sas7bdat"), NotImplementedError, {}), (p("x.csv"), ValueError, {}), (p("x.sav"), ValueError, {"format": "dta"}), (p("x.dta"), TypeError, {"nothing": 1}), (p("x.dta"), ValueError, {"variable_format": {"a": "8.0g"}}),
        (p("x.dta"), ValueError, {"value_labels": {"a": {2147483647: "x"}}}), (p("x.sav"), ValueError, {"value_labels": {"s": {"x": "y"}}}), (p("x.sav"), ValueError, {"variable_display_width": {"a": 0}}),
    ]:
        with pytest.raises(error):
            statloom.write(df, path, **kwargs)
    long = df.toDF("a_rather_long_name", "s")
    for path, kwargs in [(p("x.xpt"), {"version": 5}), (p("x.por"), {})]:
        with pytest.raises(ValueError):
            statloom.write(long, path, **kwargs)
    with pytest.raises(TypeError):
        statloom.write(df.select(F.array("a").alias("a")), p("x.dta"))


def test_compress(spark, tmp_path):
    path = str(tmp_path / "c.dta")
    data = [(1.0, "1", 2.0**31, 1.5, 0, None, dt.datetime(2020, 1, 1), "q"), (2.0, "2", 0.0, 2.0, 1, None, dt.datetime(2020, 1, 2), ""), (120.0, "120", 1.0, 3.0, 1, None, None, None)]
    statloom.write(spark.createDataFrame(data, "i double, n string, over double, frac double, flag int, none double, at timestamp_ntz, s string").coalesce(1), path)
    df = statloom.scan(spark, path, compress=True)
    assert dict(df.dtypes) == {"i": "tinyint", "n": "tinyint", "over": "double", "frac": "double", "flag": "boolean", "none": "boolean", "at": "date", "s": "string"}
    assert rows(df)[0] == (1, 1, 2.0**31, 1.5, False, None, dt.date(2020, 1, 1), "q")
    odd = str(tmp_path / "o.dta")
    statloom.write(spark.createDataFrame([("1",), ("2",), ("not_a_number",)], "n string").coalesce(1), odd)
    assert rows(statloom.scan(spark, odd, compress={"enabled": True, "string_to_numeric": True, "infer_compress_length": 2})) == [(1,), (2,), (None,)]
    assert statloom.scan(spark, path, compress={"enabled": True}).drop("none").dtypes == statloom.scan(spark, path).drop("none").dtypes
    assert statloom.scan(spark, odd, compress={"enabled": False}).dtypes == [("n", "string")]
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        statloom.scan(spark, path, schema_overrides={"over": "int"}).collect()
    assert rows(statloom.scan(spark, path, schema_overrides={"over": "int"}, strict_schema=False, columns=["over"])) == [(None,), (0,), (1,)]
    assert statloom.scan(spark, path, schema_overrides={"i": "int", "nope": "int"}).dtypes[0] == ("i", "int")
    stata = str(tmp_path / "b.dta")
    statloom.write(spark.createDataFrame([(-2147483647.0, -2147483648.0), (2147483620.0, 2147483647.0)], "inside double, outside double"), stata, compress=True)
    assert [c.storage for c in Dta(stata).columns] == ["long", "double"]


def test_streams(spark, tmp_path):
    from statloom.streaming.folders import read_stream, write_stream

    (tmp_path / "in").mkdir()
    for k in range(2):
        statloom.write(spark.createDataFrame([(k, f"r{k}"), (k + 10, "x")], "a int, s string").coalesce(1), str(tmp_path / "in" / f"f{k}.sav"))
    q = write_stream(read_stream(spark, str(tmp_path / "in"), "sav"), str(tmp_path / "out"), "dta", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    statloom.write(spark.createDataFrame([(5, "late")], "a int, s string"), str(tmp_path / "in" / "f2.sav"))
    q = write_stream(read_stream(spark, str(tmp_path / "in"), "sav"), str(tmp_path / "out"), "dta", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = [r for f in sorted((tmp_path / "out").iterdir()) if f.suffix == ".dta" for r in rows(statloom.scan(spark, str(f)))]
    assert sorted(found) == [(0.0, "r0"), (1.0, "r1"), (5.0, "late"), (10.0, "x"), (11.0, "x")]


def test_labels_that_are_cut_warn(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "A int")
    for name in ("x.dta", "x.sav", "x.xpt"):
        with pytest.warns(UserWarning, match="room for"):
            statloom.write(df, str(tmp_path / name), variable_labels={"A": "é" * 40_000}, **({"version": 5} if name == "x.xpt" else {}))
        assert set(statloom.StatReader(spark, str(tmp_path / name)).metadata_df.first()["label"]) == {"é"}


def test_stream_reads_files_of_older_times(spark, tmp_path):
    import os

    from statloom.sources.datasource import FolderReader, _Options

    for k, name in enumerate(("b.dta", "a.dta")):
        statloom.write(spark.createDataFrame([(k,)], "n int"), str(tmp_path / name))
        os.utime(tmp_path / name, (1000 - k, 1000 - k))
        if k == 0:
            reader = FolderReader(_Options("dta", {"path": str(tmp_path)}), spark.createDataFrame([], "n int").schema)
            first = reader.latestOffset()
    assert [os.path.basename(p.path) for p in reader.partitions(first, reader.latestOffset())] == ["a.dta"]


def test_zsav_blocks(spark, tmp_path, monkeypatch):
    """Byte codes in zlib blocks: every kind of cell, several blocks, and splits that begin within one."""
    from statloom.sinks import sav as sink
    from statloom.sources import sav

    path = str(tmp_path / "x.zsav")
    numbers = [float(k) for k in range(-102, 155)] + [0.0, -0.0, 0.5, 1e300, -1e300, 2.0**53, None]
    data = [(x, None if k % 3 == 0 else "ab " * (k % 9), "x" * (k % 300), k if k % 5 else None) for k, x in enumerate(numbers * 40)]
    df = spark.createDataFrame(data, "d double, s string, long string, k int").coalesce(3)
    statloom.write(df, path)
    raw = open(path, "rb").read()
    assert raw[:4] == b"$FL3" and statloom.StatReader(spark, path).metadata["compression"] == "zlib" and len(raw) < len(data) * 43 * 8 / 10
    want = [(x, (s or "").rstrip(), t, k) for x, s, t, k in data]
    got = rows(statloom.scan(spark, path, num_partitions=7))
    assert got == want and [str(r[0]) for r in got] == [str(r[0]) for r in want]
    assert rows(statloom.scan(spark, path, offset=5000, n_rows=7)) == want[5000:5007]
    monkeypatch.setattr(sav, "WINDOW", 64 * 64)
    s = sav.Sav(path)
    found = s.splits(20)
    assert len({s.resume_at(a) for a, _ in found}) > 10
    once = [b for _, block in sav.Sav(path).records(0, s.rows, 1000) for b in block.tolist()]
    parts = []
    for a, k in found:
        s.resume = s.resume_at(a)
        parts += [b for _, block in s.records(a, k, 100) for b in block.tolist()]
    assert parts == once and len(once) == len(data)
    assert sink.byte_coded(sink.np.zeros((0, 8), "u1"), sink.np.array([False])) == b""
    empty = str(tmp_path / "e.zsav")
    statloom.write(df.limit(0), empty)
    assert rows(statloom.scan(spark, empty)) == []
    assert rows(statloom.scan(spark, [path, path], columns=["k"])) == [(r[3],) for r in want * 2]


@pytest.mark.parametrize("fmt", ["dta", "sav", "zsav", "xpt", "por"])
def test_a_file_for_each_partition(spark, tmp_path, fmt):
    folder = str(tmp_path / fmt)
    df = spark.range(0, 1000, 1, 4).select(F.col("id").cast("double").alias("id"), F.concat(F.lit("t"), F.col("id") % 13).alias("s")).filter("id < 250 or id >= 500")
    statloom.write_parts(df, folder, fmt, variable_labels={"id": "number"})
    suffix = fmt.replace("zsav", "sav") if fmt != "zsav" else "zsav"
    assert sorted(p.name for p in (tmp_path / fmt).iterdir()) == [f"part-{k:06d}.{suffix}" for k in (0, 2, 3)] and [p.name for p in tmp_path.iterdir()] == [fmt]
    back = statloom.scan(spark, f"{folder}/*.{suffix}")
    assert sorted(rows(back)) == sorted(rows(df)) and statloom.scan(spark, f"{folder}/part-000002.{suffix}").count() == 250
    with pytest.raises(FileExistsError):
        statloom.write_parts(df, folder, fmt)


def test_parts_of_an_empty_frame(spark, tmp_path):
    df = spark.range(0, 10, 1, 3).select("id", F.lit("x").alias("s")).filter("id < 0")
    statloom.write_parts(df, str(tmp_path / "none"), "dta")
    assert statloom.scan(spark, str(tmp_path / "none" / "*.dta")).count() == 0
    with pytest.raises(ValueError, match="formats: dta"):
        statloom.write_parts(df, str(tmp_path / "other"), "csv")


def test_long_strings_of_several_parts(spark, tmp_path):
    df = spark.range(0, 300, 1, 3).select("id", F.repeat(F.concat(F.lit("é"), "id"), F.when(F.col("id") % 3 == 0, 1000).otherwise(0)).alias("a"), F.concat(F.lit("b "), F.repeat(F.lit("x"), 2100), "id").alias("b"))
    path = str(tmp_path / "x.dta")
    statloom.write(df, path)
    statloom.write_parts(df, str(tmp_path / "parts"), "dta")
    want = sorted(rows(df))
    assert sorted(rows(statloom.scan(spark, path, batch_size=7))) == want == sorted(rows(statloom.scan(spark, str(tmp_path / "parts" / "*.dta"))))
    assert pd.read_stata(path)["b"].tolist() == [r[2] for r in want]


def test_customers_as_byte_codes_never_pass_through_the_driver(spark, monkeypatch):
    """rows are coded in tasks, several to a block."""
    from statloom.plans import catalog, samples

    def refused(*a, **k):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(samples, "sav", refused)
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refused)
    for name in ("sav_bytecode", "zsav_zlib"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 150


def test_sav_byte_codes(spark, tmp_path):
    path = str(tmp_path / "x.sav")
    numbers = [float(k) for k in range(-102, 155)] + [0.0, -0.0, 0.5, 1e300, -1e300, 2.0**53, None]
    data = [(x, None if k % 3 == 0 else "ab " * (k % 9), "x" * (k % 300), k if k % 5 else None) for k, x in enumerate(numbers * 10)]
    df = spark.createDataFrame(data, "d double, s string, long string, k int").coalesce(3)
    statloom.write(df, path, byte_codes=True)
    want = [(x, (s or "").rstrip(), t, k) for x, s, t, k in data]
    assert statloom.StatReader(spark, path).metadata["compression"] == "rle"
    got = rows(statloom.scan(spark, path, num_partitions=7))
    assert got == want and [str(r[0]) for r in got] == [str(r[0]) for r in want]
    statloom.write_parts(df, str(tmp_path / "parts"), "sav", byte_codes=True)
    assert sorted(map(str, rows(statloom.scan(spark, str(tmp_path / "parts" / "*.sav"))))) == sorted(map(str, got))
    statloom.write(df.limit(0), path, byte_codes=True)
    assert rows(statloom.scan(spark, path)) == []


def test_parts_grow_in_number_with_the_table(spark, monkeypatch):
    """F8: documents were dealt to four tasks, whatever their size."""
    import os

    from statloom.plans import catalog

    documents = catalog._table(spark, "/root/testdata/sf0.001", "documents")
    held = os.path.getsize("/root/testdata/sf0.001/documents.parquet")
    assert catalog._dealt(documents, 4, "doc_id", ["doc_id", "text"]).rdd.getNumPartitions() == 4
    monkeypatch.setattr(catalog, "PART_BYTES", held // 40)
    assert 40 <= catalog._dealt(documents, 4, "doc_id", ["doc_id", "text"]).rdd.getNumPartitions() <= 42
    assert catalog.QUERIES["dta_parts_long_strings"](spark, "/root/testdata/sf0.001").count() == documents.count()
