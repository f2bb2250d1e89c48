"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of ``block_bytes``. Equal blocks get one integer name: the blocks are
hash-partitioned and sorted, and each run of equal blocks is named by the smallest number of its members. Then adjacent
names (0,1), (2,3), ... are named as pairs in the same way, level by level, until every document has one name. Names
come from comparing bytes or exact pairs of integers, so two texts share an identity (level, name) only if they are
equal; no digest decides anything.

Scale: texts are normalised once, and their blocks cross the network once. A task remembers the blocks it has seen, up to
``SEEN_BYTES`` and beyond that the repeated ones, and sends only their names again, so that a naming task gets a hot block
about once from each task; pairs are collapsed by partial aggregation. The rows of a large group are dealt to many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from .common import WHITE, dropped, scratch, spread_join, table, trimmed, written

BLOCK_BYTES, SEEN_BYTES, OUT_BYTES = 2048, 24 << 20, 4 << 20


class Seen:
    """The blocks of a task that it has sent, by their bytes, with their names."""

    def __init__(self):
        self.once: dict[bytes, int] = {}
        self.often: dict[bytes, int] = {}
        self.size = 0

    def name(self, block: bytes, number: int) -> int:
        """The block's name if it is known, else ``number``, which becomes its name."""
        if (known := self.often.get(block)) is not None:
            return known
        if (known := self.once.pop(block, None)) is not None:
            self.often[block] = known
            return known
        if self.size > SEEN_BYTES:
            self.size = sum(map(len, self.often))
            self.once.clear()
            if self.size > SEEN_BYTES // 2:
                self.often.clear()
                self.size = 0
        self.once[block] = number
        self.size += len(block)
        return number


def _blocks(block_bytes: int, out: list[str]):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, seen = TaskContext.get().partitionId() << 36, Seen()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                uid, text = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                digest = hashlib.sha256(text).hexdigest()
                for pos, a in enumerate(range(0, max(len(text), 1), block_bytes)):
                    block = text[a : a + block_bytes]
                    name = seen.name(block, number)
                    rows.append((uid, pos, name, block if name == number else None, None if pos else k, None if pos else digest))
                    held += len(block) if name == number else 0
                    number += 1
                if held > OUT_BYTES:
                    yield _batch(rows, batch.column(1), out)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, batch.column(1), out)

    return run


def _batch(rows: list[tuple], ids: pa.Array, out: list[str]) -> pa.RecordBatch:
    uid, pos, rep, block, at, digest = zip(*rows, strict=True)
    cols = [pa.array(uid, pa.int64()), pa.array(pos, pa.int32()), pa.array(rep, pa.int64()), pa.array(block, pa.binary()), ids.take(pa.array(at, pa.int64())), pa.array(digest, pa.string())]
    return pa.RecordBatch.from_arrays(cols, out)


def identities(numbered: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """From (row_number, doc_id, text), with numbers that differ: (row_number, doc_id, text_sha256) and (row_number, level,
    name).

    (level, name) is the identity of the normalised text: each run of ASCII white space as one space, null as empty.
    Empty texts are one block of no bytes and equal one another. Texts may be of any length. Null ids and repeated rows
    each keep their own row. An empty table gives an empty result.
    """
    norm = F.regexp_replace(F.coalesce(numbered["text"].cast("string"), F.lit("")), WHITE, " ").cast("binary")
    out = StructType().add("uid", LongType()).add("pos", IntegerType()).add("rep", LongType()).add("block", BinaryType()).add("doc_id", numbered.schema["doc_id"].dataType).add("text_sha256", StringType())
    names = ["uid", "pos", "rep", "block", "doc_id", "text_sha256"]
    cut = written(numbered.select("row_number", "doc_id", norm.alias("norm")).mapInArrow(_blocks(block_bytes, names), out), "dedup-blocks")
    # the blocks' names: the smallest number in each run of equal blocks
    same = Window.partitionBy("block")
    named = cut.filter("block is not null").select("rep", F.min("rep").over(same).alias("name"))
    level = written(cut.select("uid", "pos", "rep", "doc_id", "text_sha256").join(named, "rep").drop("rep"), "dedup-level")
    dropped(cut)
    ids = level.filter("pos = 0").select(F.col("uid").alias("row_number"), "doc_id", "text_sha256")
    longest = level.agg(F.max("pos")).first()[0] or 0
    level = level.select("uid", "pos", "name")
    done = level.groupBy("uid").agg(F.max("pos").alias("last"), F.min("name").alias("name")).filter("last = 0").select("uid", F.lit(0).alias("level"), "name")
    work, k = level.withColumn("last", F.max("pos").over(Window.partitionBy("uid"))).filter("last > 0").drop("last"), 0
    while longest > 0:
        k, longest = k + 1, longest // 2
        pair = written(work.groupBy("uid", F.expr("pos div 2").cast("int").alias("pos")).agg(F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), "dedup-pairs")
        names = written(pair.groupBy("a", "b").agg(F.lit(1).alias("one")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), "dedup-names")
        work = written(pair.join(names, ["a", "b"]).select("uid", "pos", "name").withColumn("last", F.max("pos").over(Window.partitionBy("uid"))), "dedup-level")
        done = done.unionByName(work.filter("last = 0").select("uid", F.lit(k).alias("level"), "name"))
        work = work.filter("last > 0").drop("last")
        dropped(pair, names)
    return ids, done.withColumnRenamed("uid", "row_number")


def _grouped(numbered: DataFrame, block_bytes: int) -> DataFrame:
    """For each row of (row_number, doc_id, text): its document's id, that of the row that stays, the group's size and
    which row stays."""
    with scratch() as keep:
        ids, named = identities(numbered, block_bytes)
        ids = written(ids.join(named, "row_number"), "dedup-ids")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row_number").alias("row")))
        groups = ids.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        found = spread_join(ids, groups, ["level", "name"], F.xxhash64("row_number"))
        found = written(found.select("row_number", "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row_number") == F.col("best.row")).alias("kept"), "text_sha256"), "dedup-found")
        keep(found)
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays (null ids come after all others; of several rows with that same
    id, one stays, the first read). ``keep_id`` is null only where all ids of the group are null. Null texts equal empty
    ones. Only the two columns named are read, so others may have any name. An empty table gives an empty result.
    """
    return _grouped(docs.select(F.monotonically_increasing_id().alias("row_number"), docs[id_col].alias("doc_id"), docs[text].alias("text")), block_bytes).drop("row_number")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were, whatever their names; which one, and
    what becomes of nulls, empty texts and repeated rows, is as :func:`exact_dedup` says."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_number"), row), "dedup-rows")
    found = _grouped(rows.select("row_number", F.col("row")[id_col].alias("doc_id"), F.col("row")[text].alias("text")), block_bytes)
    return rows.join(found.filter("kept").select("row_number"), "row_number", "left_semi").select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
}
