"""Shared helpers: tables, scratch space that all executors can see, and column-name hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: While a table is written: bytes that a Python worker gets at a time, and bytes of a row group that a reader decodes.
BATCH_BYTES, ROW_GROUP_BYTES = 4 << 20, 16 << 20
_NOTED: ContextVar[list | None] = ContextVar("noted", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``. Where that is unset, a local one with a local
    master; an error on a cluster, whose machines wouldn't see one another's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='statloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/statloom-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within, the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors. Removed when the
    application ends, or earlier by :func:`dropped` or the end of a :func:`scratch` scope; one in a ``folder`` of the
    caller's stays until it is dropped.

    Shuffle files go when the query ends, not when the driver collects garbage; Python workers get small batches; row
    groups are small, because a reader decodes one whole and rows may hold megabytes.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = stored(spark, path, df.schema)
    if folder is None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        if (noted := _NOTED.get()) is not None:
            noted.append(out)
    return out


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that :func:`written` made."""
    out = spark.read.schema(schema).parquet(path)
    out._statloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_statloom_path", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """On leaving, tables written within are deleted, but for those given to the function that this yields."""
    outer, mine, kept = _NOTED.get(), [], []
    token = _NOTED.set(mine)
    try:
        yield lambda *frames: kept.extend(frames)
    finally:
        _NOTED.reset(token)
        dropped(*[df for df in mine if not any(df is k for k in kept)])
        if outer is not None:
            outer.extend(kept)


def give_back() -> None:
    """Free memory that this process's allocators keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """``run``, a function for tasks over batches or a group, that gives back freed memory at its end: Python workers stay
    for later tasks, and what they keep counts against an executor while its JVM needs the room."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def tidy(batches):
            try:
                yield from run(batches)
            finally:
                give_back()
    else:

        @functools.wraps(run)
        def tidy(rows):
            try:
                return run(rows)
            finally:
                give_back()

    return tidy


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as Python values, one at a time, so that a batch of large rows isn't held twice."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], salt: Column, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a key, such that a key's rows are dealt to ``salts`` tasks.

    Facts are repeated only for the salts that a key's rows have: no more rows than ``rows`` has, and at most ``salts`` a
    key. Rows whose key ``facts`` lacks go. Keys aren't null.
    """
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    return salted.join(salted.select(*keys, "_salt").distinct().join(facts, keys), [*keys, "_salt"]).drop("_salt")


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def id_text_hash(doc_id: Column, text: Column) -> Column:
    """A key of a row's content: rows with equal id and text share it."""
    return F.xxhash64(doc_id, text)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
