"""Queries over statistical files made from the tables, and the SQL that gives the same rows from the tables."""

from __future__ import annotations

import os
import pathlib
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import metadata as meta
from ..api import scan, write, write_parts, write_sas_bundle
from . import samples

_FOLDER: list[str] = []
PART_BYTES = 16 << 20


def _file(name: str) -> str:
    """A path in this process's folder of files that queries write and scan. On a cluster it must be one that all
    machines mount: STATLOOM_DIR."""
    if not _FOLDER:
        _FOLDER.append(tempfile.mkdtemp(prefix="statloom-files-", dir=os.environ.get("STATLOOM_DIR")))
    return os.path.join(_FOLDER[0], f"{len(os.listdir(_FOLDER[0]))}-{name}")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stored(spark: SparkSession, df: DataFrame, name: str, **kwargs) -> str:
    path = _file(name)
    write(df, path, **kwargs)
    return path


def _dealt(df: DataFrame, least: int, key: str, columns: list[str]) -> DataFrame:
    """Columns of a table, dealt out by a key to a task for each 16 MB of its files, ``least`` at least."""
    held = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.select(*columns).repartition(max(least, -(-held // PART_BYTES)), key)


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def dta_roundtrip_orders(spark, sf):
    path = _stored(spark, _table(spark, sf, "orders"), "orders.dta")
    df = scan(spark, path)
    return df.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice", _day("o_orderdate").alias("o_orderdate"), "o_orderpriority")


def dta_parts_orders(spark, sf):
    folder = _file("orders-parts")
    orders = _table(spark, sf, "orders")
    write_parts(_dealt(orders, 8, "o_orderkey", orders.columns), folder, "dta", variable_labels={"o_orderkey": "order"})
    return scan(spark, f"{folder}/*.dta").select(F.col("o_orderkey").cast("bigint"), "o_totalprice", _day("o_orderdate").alias("o_orderdate"), "o_orderpriority")


def dta_parts_long_strings(spark, sf):
    folder = _file("documents-parts")
    write_parts(_dealt(_table(spark, sf, "documents"), 4, "doc_id", ["doc_id", "text"]), folder, "dta")
    return scan(spark, f"{folder}/*.dta").select(F.col("doc_id").cast("bigint"), F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def dta_projection_limit_agg(spark, sf):
    path = _stored(spark, _table(spark, sf, "orders"), "orders.dta")
    df = scan(spark, path, columns=["o_orderpriority", "o_totalprice"])
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def dta_pushed_filter(spark, sf):
    path = _stored(spark, _table(spark, sf, "orders"), "orders.dta")
    df = scan(spark, path, columns=["o_orderkey", "o_totalprice"], filters=[("o_totalprice", ">", 200_000), ("o_orderkey", "is not null")])
    return df.select(F.col("o_orderkey").cast("bigint"), "o_totalprice")


def dta_rows_and_offset(spark, sf):
    path = _stored(spark, _table(spark, sf, "orders").orderBy("o_orderkey"), "orders.dta")
    return scan(spark, path, columns=["o_orderkey"], offset=100, n_rows=250).select(F.col("o_orderkey").cast("bigint"))


def dta_value_labels(spark, sf):
    df = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    path = _stored(spark, df, "lines.dta", value_labels={"l_linenumber": {1: "first", 2: "second", 3: "third"}, "l_quantity": {10: "ten"}})
    out = scan(spark, path, value_labels_as_strings=True)
    return out.groupBy("l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("n"))


def _with_codes(spark, sf, name):
    """Line items whose discount is missing by code: the file's bytes are patched, as no writer here makes such codes."""
    import numpy as np

    from ..sources.dta import Dta

    df = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("d")).orderBy("l_orderkey", "l_linenumber")
    path = _stored(spark, df, name)
    s = Dta(path)
    raw = np.memmap(path, np.uint8, "r+", s.data_at, (s.rows, s.record))
    c = next(c for c in s.columns if c.name == "d")
    cell = raw[:, c.offset]
    cell[cell == 1] = 102
    cell[cell == 2] = 103
    cell[cell == 3] = 101
    raw.flush()
    return path


def dta_informative_separate(spark, sf):
    df = scan(spark, _with_codes(spark, sf, "codes.dta"), informative_nulls={"columns": ["d"]})
    return df.groupBy(F.col("d").cast("string").alias("d"), "d_null").agg(F.count(F.lit(1)).alias("n"))


def dta_informative_struct(spark, sf):
    df = scan(spark, _with_codes(spark, sf, "codes.dta"), informative_nulls={"columns": ["d"], "mode": "struct"})
    return df.groupBy(F.col("d.d").cast("string").alias("value"), F.col("d.null_indicator").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def dta_informative_merged(spark, sf):
    df = scan(spark, _with_codes(spark, sf, "codes.dta"), informative_nulls={"columns": ["d"], "mode": "merged_string"})
    return df.groupBy("d").agg(F.count(F.lit(1)).alias("n"))


def dta_compress(spark, sf):
    df = _table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust_text"), F.floor("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 2).cast("double").alias("odd"))
    out = scan(spark, _stored(spark, df, "wide.dta"), compress=True)
    kinds = dict(out.dtypes)
    return out.select(F.col("o_orderkey").cast("bigint"), F.col("cust_text").cast("bigint"), F.col("price").cast("bigint"), "odd", *[F.lit(kinds[c]).alias(f"type_{c}") for c in ("price", "odd")])


def dta_row_index_sort(spark, sf):
    path = _stored(spark, _table(spark, sf, "orders").orderBy("o_orderkey"), "orders.dta")
    return scan(spark, path, columns=["o_orderkey"], preserve_order={"mode": "row_index"}).select(F.col("o_orderkey").cast("bigint"), "row_index")


def dta_sorted_top(spark, sf):
    path = _stored(spark, _table(spark, sf, "orders").orderBy("o_orderkey"), "orders.dta")
    return scan(spark, path, columns=["o_orderkey"], preserve_order="sort").limit(50).select(F.col("o_orderkey").cast("bigint"))


def dta_long_strings(spark, sf):
    path = _stored(spark, _table(spark, sf, "documents").select("doc_id", "text"), "texts.dta")
    return scan(spark, path).select(F.col("doc_id").cast("bigint"), F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def xpt5_roundtrip_customer(spark, sf):
    df = _table(spark, sf, "customer").select(F.col("c_custkey").alias("CUSTKEY"), F.col("c_name").alias("NAME"), F.col("c_nationkey").alias("NATION"), F.col("c_acctbal").alias("ACCTBAL"), F.col("c_mktsegment").alias("SEGMENT"))
    out = scan(spark, _stored(spark, df, "customer.xpt", version=5))
    return out.select(F.col("CUSTKEY").cast("bigint"), "NAME", F.col("NATION").cast("int"), "ACCTBAL", "SEGMENT")


def xpt8_long_names(spark, sf):
    out = scan(spark, _stored(spark, _table(spark, sf, "customer"), "customer.xpt"))
    return out.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


def xpt_projection_nonprefix(spark, sf):
    return scan(spark, _stored(spark, _table(spark, sf, "customer"), "customer.xpt"), columns=["c_mktsegment", "c_nationkey"]).select("c_mktsegment", F.col("c_nationkey").cast("int"))


def sav_roundtrip_events(spark, sf):
    out = scan(spark, _stored(spark, _table(spark, sf, "events"), "events.sav"))
    return out.select(F.col("event_id").cast("bigint"), _day("ts").alias("ts"), F.col("user_id").cast("bigint"), "event_type", "value", "props")


def zsav_roundtrip_part(spark, sf):
    out = scan(spark, _stored(spark, _table(spark, sf, "part"), "part.zsav"))
    return out.select(F.col("p_partkey").cast("bigint"), "p_name", "p_brand", "p_type", F.col("p_size").cast("int"), "p_retailprice")


def sav_value_labels(spark, sf):
    df = _table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    out = scan(spark, _stored(spark, df, "nation.sav", value_labels={"n_regionkey": {0: "zero", 2: "two"}}), value_labels_as_strings=True)
    return out.select(F.col("n_nationkey").cast("int"), "n_regionkey")


def sav_long_strings(spark, sf):
    path = _stored(spark, _table(spark, sf, "conversations").select("conv_id", "turn", "text"), "talk.sav")
    return scan(spark, path).select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.sha2(F.rtrim("text"), 256).alias("digest"))


def por_roundtrip_nation(spark, sf):
    df = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("NATKEY"), F.col("n_name").alias("NAME"), F.col("n_regionkey").alias("REGION"))
    return scan(spark, _stored(spark, df, "nation.por")).select(F.col("NATKEY").cast("int"), "NAME", F.col("REGION").cast("int"))


def por_roundtrip_orders(spark, sf):
    df = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("KEY"), F.col("o_totalprice").alias("PRICE"), F.col("o_orderdate").cast("date").alias("DAY"))
    return scan(spark, _stored(spark, df, "orders.por")).select(F.col("KEY").cast("bigint"), "PRICE", F.col("DAY").cast("string"))


def sas_csv_bundle_lineitem(spark, sf):
    df = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate"), F.col("l_shipdate").alias("l_shiptime"))
    csv, _ = write_sas_bundle(df, _file("lines"))
    return spark.read.schema("l_orderkey bigint, l_linenumber int, l_returnflag string, l_shipdate int, l_shiptime double").csv(csv, header=True)


def metadata_merge(spark, sf):
    base = meta.frame(spark, {"variables": [{"name": "a", "label": "A", "format": "F8.2"}, {"name": "b", "label": "B"}, {"name": "c", "format": "A20", "measure": "nominal"}]})
    over = meta.from_kwargs(spark, variable_labels={"b": "new", "d": "D"}, variable_format={"a": "F10.0"})
    return meta.merged(base, over).select("name", "label", "format", "format_type", F.col("format_width").cast("string"), F.col("format_decimals").cast("string"), "measure")


def catalog_labels(spark, sf):
    df = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("KEY"), F.col("n_regionkey").alias("REGION"))
    path = _stored(spark, df, "nation.xpt", variable_format={"REGION": "REGFMT."})
    out = scan(spark, path, catalog={"regfmt.": {0: "Africa", 1: "America"}}, value_labels_as_strings=True)
    return out.select(F.col("KEY").cast("int"), "REGION")


def schema_override_cast(spark, sf):
    path = _stored(spark, _table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_orderkey"), "lines.dta")
    return scan(spark, path, schema_overrides={"l_quantity": "int", "l_orderkey": "bigint", "nothing": "int"})


def time_of_day(spark, sf):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = _table(spark, sf, "events").select("event_id", F.expr("make_time(cast(event_id % 24 as int), cast(event_id % 60 as int), cast(event_id % 59 as decimal(8,6)))").alias("t"))
    return scan(spark, _stored(spark, df, "times.dta"), time_as="string").select(F.col("event_id").cast("bigint"), "t")


def join_over_scans(spark, sf):
    o = scan(spark, _stored(spark, _table(spark, sf, "orders"), "orders.dta"), columns=["o_custkey", "o_totalprice"])
    c = scan(spark, _stored(spark, _table(spark, sf, "customer"), "customer.xpt"), columns=["c_custkey", "c_mktsegment"])
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def semi_anti_over_scans(spark, sf):
    c = scan(spark, _stored(spark, _table(spark, sf, "customer"), "customer.sav"), columns=["c_custkey"])
    o = scan(spark, _stored(spark, _table(spark, sf, "orders"), "orders.dta"), columns=["o_custkey"])
    has = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").withColumn("kind", F.lit("semi"))
    not_ = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").withColumn("kind", F.lit("anti"))
    return has.unionByName(not_).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").cast("bigint").alias("keys"))


def window_over_scan(spark, sf):
    o = scan(spark, _stored(spark, _table(spark, sf, "orders"), "orders.dta"), columns=["o_orderkey", "o_custkey", "o_totalprice"])
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "rank")


def setops_over_scans(spark, sf):
    n = scan(spark, _stored(spark, _table(spark, sf, "nation"), "nation.dta")).select(F.col("n_regionkey").cast("int").alias("k"))
    r = scan(spark, _stored(spark, _table(spark, sf, "region"), "region.sav")).select(F.col("r_regionkey").cast("int").alias("k"))
    return n.intersect(r).withColumn("op", F.lit("both")).unionByName(n.exceptAll(r).withColumn("op", F.lit("rest")))


def rollup_over_scan(spark, sf):
    df = scan(spark, _stored(spark, _table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "lines.dta"))
    return df.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("quantity"))


def topk_over_scan(spark, sf):
    o = scan(spark, _stored(spark, _table(spark, sf, "orders"), "orders.dta"), columns=["o_orderkey", "o_totalprice"])
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").cast("bigint"), "o_totalprice")


_CUSTOMER = [("c_custkey", "num", "", ""), ("c_name", 25, "", ""), ("c_nationkey", "num", "", ""), ("c_acctbal", "num", "", ""), ("c_mktsegment", 12, "", "")]


def _sas_customer(spark, sf, **kwargs):
    """Customers as a SAS data set, which the library doesn't write: its pages are assembled in tasks."""
    path = _file("customer.sas7bdat")
    df = _table(spark, sf, "customer").select(*[c for c, *_ in _CUSTOMER])
    samples.sas7bdat_of(df.repartition(spark.sparkContext.defaultParallelism), path, _CUSTOMER, **kwargs)
    return scan(spark, path).select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


def sas7bdat_plain(spark, sf):
    return _sas_customer(spark, sf, mix=3)


def sas7bdat_rle(spark, sf):
    return _sas_customer(spark, sf, wide=False, end=">", compression="rle")


def sas7bdat_rdc(spark, sf):
    return _sas_customer(spark, sf, compression="rdc")


def sas7bcat_labels(spark, sf):
    data, labels = _file("nation.sas7bdat"), _file("formats.sas7bcat")
    rows = [(float(r["n_nationkey"]), float(r["n_regionkey"])) for r in _table(spark, sf, "nation").collect()]
    samples.sas7bdat(pathlib.Path(data), [("KEY", "num", "", ""), ("REGION", "num", "REGFMT", "")], rows)
    samples.catalog(pathlib.Path(labels), {"REGFMT": [(0, "Africa"), (1, "America")]})
    out = scan(spark, data, catalog=labels, value_labels_as_strings=True)
    return out.select(F.col("KEY").cast("int"), "REGION")


def _spss_customer(spark, sf, name, **kwargs):
    df = _table(spark, sf, "customer").select(F.col("c_custkey").alias("KEY"), F.col("c_name").alias("NAME"), F.col("c_nationkey").alias("NATION"), F.col("c_acctbal").alias("BALANCE"), F.col("c_mktsegment").alias("SEGMENT"))
    out = scan(spark, _stored(spark, df, name, **kwargs))
    return out.select(F.col("KEY").cast("bigint").alias("c_custkey"), F.col("NAME").alias("c_name"), F.col("NATION").cast("int").alias("c_nationkey"), F.col("BALANCE").alias("c_acctbal"), F.col("SEGMENT").alias("c_mktsegment"))


def sav_bytecode(spark, sf):
    return _spss_customer(spark, sf, "customer.sav", byte_codes=True)


def zsav_zlib(spark, sf):
    return _spss_customer(spark, sf, "customer.zsav")


def sav_user_missing(spark, sf):
    """Regions 3 and 4 are declared missing, 4 with a label: null in the column, told apart beside it."""
    path, number = _file("nation.sav"), 5 << 16 | 8 << 8
    rows = [samples.doubles(r["n_nationkey"], r["n_regionkey"]) for r in _table(spark, sf, "nation").collect()]
    variables = [("KEY", 0, number, 0, b"", ""), ("REGION", 0, number, 2, b"".join(samples.doubles(3, 4)), "")]
    samples.sav(pathlib.Path(path), variables, rows, 1, labels=[([(samples.doubles(4)[0], "refused")], [2])])
    out = scan(spark, path, informative_nulls=True, columns=["KEY", "REGION", "REGION_null"])
    return out.select(F.col("KEY").cast("int"), F.col("REGION").cast("int"), "REGION_null")


QUERIES = {
    f.__name__: f
    for f in (
        dta_roundtrip_orders, dta_projection_limit_agg, dta_pushed_filter, dta_rows_and_offset, dta_value_labels, dta_informative_separate, dta_informative_struct, dta_informative_merged, dta_compress,
        dta_row_index_sort, dta_sorted_top, dta_long_strings, xpt5_roundtrip_customer, xpt8_long_names, xpt_projection_nonprefix, sav_roundtrip_events, zsav_roundtrip_part, sav_value_labels, sav_long_strings,
        por_roundtrip_nation, por_roundtrip_orders, sas_csv_bundle_lineitem, metadata_merge, catalog_labels, schema_override_cast, time_of_day, join_over_scans, semi_anti_over_scans, window_over_scan,
        setops_over_scans, rollup_over_scan, topk_over_scan, dta_parts_orders, dta_parts_long_strings, sas7bdat_plain, sas7bdat_rle, sas7bdat_rdc, sas7bcat_labels, sav_bytecode, zsav_zlib, sav_user_missing,
    )
}

_CODED = "CASE CAST(round(l_discount * 100) AS INT) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) END"
_CODE = "CASE CAST(round(l_discount * 100) AS INT) WHEN 1 THEN '.a' WHEN 2 THEN '.b' END"
ORACLE = {
    "dta_roundtrip_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "dta_parts_orders": "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "dta_parts_long_strings": "SELECT doc_id, CAST(length(text) AS INT) AS chars, sha256(text) AS digest FROM documents",
    "dta_projection_limit_agg": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "dta_pushed_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
    "dta_rows_and_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 100",
    "dta_value_labels": "SELECT CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE CAST(l_linenumber AS VARCHAR) END AS l_linenumber, CASE WHEN l_quantity = 10 THEN 'ten' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "dta_informative_separate": f"SELECT CAST({_CODED} AS VARCHAR) AS d, {_CODE} AS d_null, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "dta_informative_struct": f"SELECT CAST({_CODED} AS VARCHAR) AS value, {_CODE} AS code, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "dta_informative_merged": f"SELECT coalesce(CAST({_CODED} AS VARCHAR), {_CODE}) AS d, count(*) AS n FROM lineitem GROUP BY 1",
    "dta_compress": "SELECT o_orderkey, o_custkey AS cust_text, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 2 = 1 AS odd, 'int' AS type_price, 'boolean' AS type_odd FROM orders",
    "dta_row_index_sort": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
    "dta_sorted_top": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 50",
    "dta_long_strings": "SELECT doc_id, CAST(length(text) AS INT) AS chars, sha256(text) AS digest FROM documents",
    "xpt5_roundtrip_customer": "SELECT c_custkey AS CUSTKEY, c_name AS NAME, c_nationkey AS NATION, c_acctbal AS ACCTBAL, c_mktsegment AS SEGMENT FROM customer",
    "xpt8_long_names": "SELECT * FROM customer",
    "xpt_projection_nonprefix": "SELECT c_mktsegment, c_nationkey FROM customer",
    "sav_roundtrip_events": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props FROM events",
    "zsav_roundtrip_part": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "sav_value_labels": "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 2 THEN 'two' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation",
    "sav_long_strings": "SELECT conv_id, turn, sha256(rtrim(text, ' ')) AS digest FROM conversations",
    "por_roundtrip_nation": "SELECT n_nationkey AS NATKEY, n_name AS NAME, n_regionkey AS REGION FROM nation",
    "por_roundtrip_orders": "SELECT o_orderkey AS KEY, o_totalprice AS PRICE, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS DAY FROM orders",
    "sas_csv_bundle_lineitem": "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(datediff('day', DATE '1960-01-01', CAST(l_shipdate AS DATE)) AS INT) AS l_shipdate, epoch_us(l_shipdate) / 1e6 + 315619200.0 AS l_shiptime FROM lineitem",
    "metadata_merge": "WITH a(name, label, format, format_type, format_width, format_decimals, measure) AS (VALUES ('a', 'A', 'F8.2', 'F', 8, 2, NULL), ('b', 'B', NULL, NULL, NULL, NULL, NULL), ('c', NULL, 'A20', 'A', 20, 0, 'nominal')), b(name, label, format, format_type, format_width, format_decimals, measure) AS (VALUES ('a', NULL, 'F10.0', 'F', 10, 0, NULL), ('b', 'new', NULL, NULL, NULL, NULL, NULL), ('d', 'D', NULL, NULL, NULL, NULL, NULL)) SELECT coalesce(b.name, a.name) AS name, coalesce(b.label, a.label) AS label, coalesce(b.format, a.format) AS format, coalesce(b.format_type, a.format_type) AS format_type, CAST(coalesce(b.format_width, a.format_width) AS VARCHAR) AS format_width, CAST(coalesce(b.format_decimals, a.format_decimals) AS VARCHAR) AS format_decimals, coalesce(b.measure, a.measure) AS measure FROM a FULL JOIN b ON a.name = b.name",
    "catalog_labels": "SELECT n_nationkey AS KEY, CASE n_regionkey WHEN 0 THEN 'Africa' WHEN 1 THEN 'America' ELSE CAST(n_regionkey AS VARCHAR) || '.0' END AS REGION FROM nation",
    "schema_override_cast": "SELECT CAST(l_quantity AS INT) AS l_quantity, l_tax, l_orderkey FROM lineitem",
    "time_of_day": "SELECT event_id, printf('%02d:%02d:%02d', event_id % 24, event_id % 60, event_id % 59) AS t FROM events",
    "join_over_scans": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "semi_anti_over_scans": "SELECT CASE WHEN o.k IS NULL THEN 'anti' ELSE 'semi' END AS kind, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k GROUP BY 1",
    "window_over_scan": "SELECT o_orderkey, o_custkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2",
    "setops_over_scans": "SELECT k, op FROM (SELECT n_regionkey AS k, 'both' AS op FROM nation INTERSECT SELECT r_regionkey, 'both' FROM region) UNION ALL SELECT k, op FROM (SELECT n_regionkey AS k, 'rest' AS op FROM nation EXCEPT ALL SELECT r_regionkey, 'rest' FROM region)",
    "rollup_over_scan": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    **dict.fromkeys(("sas7bdat_plain", "sas7bdat_rle", "sas7bdat_rdc", "sav_bytecode", "zsav_zlib"), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "sas7bcat_labels": "SELECT n_nationkey AS KEY, CASE n_regionkey WHEN 0 THEN 'Africa' WHEN 1 THEN 'America' ELSE CAST(n_regionkey AS VARCHAR) || '.0' END AS REGION FROM nation",
    "sav_user_missing": "SELECT n_nationkey AS KEY, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS REGION, CASE n_regionkey WHEN 3 THEN '3' WHEN 4 THEN 'refused' END AS REGION_null FROM nation",
    "topk_over_scan": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
}
