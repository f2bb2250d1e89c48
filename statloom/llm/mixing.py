"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

A source's target over its size says how often each document is taken whole (the integer part) and which share of its
words is taken once more. Documents have a fixed hash; the share is met by a threshold: every document of the source
whose hash is below it is taken once more. Thresholds nest, so a larger budget takes a superset. They are found without
sorting: words are summed by source and hash bucket, running sums over the buckets find the bucket in which the budget
is met, and only that bucket is split again, until it holds a single hash value; that last value is taken if it
brings the source nearer to its budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, scratch, table, text_of, written

BITS, STEP = 60, 12
#: Rows, one a source, that are sent to every task.
MOST_SENT = 100_000


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, as any engine can compute them; null ids and texts as empty."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, BITS // 4), 16, 10).cast("long")


def _sent(plan: DataFrame, rows: int) -> DataFrame:
    """One row a source, broadcast while they are few; beyond that Spark joins by shuffling."""
    return F.broadcast(plan) if rows <= MOST_SENT else plan


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """From (source, source_size): (source, source_size, target). One row a source, and only such rows, are ranked.

    Weights 1, 2, 3, repeating, in code-point order, null last. A source gets min(cap * size, level * weight), with the
    level at which all budgets add up to the size of everything: what the capped ones can't take is reshared by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    fill = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(fill), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
    # levels rise up to the first source, by most/weight, that isn't filled, and fall from there: the largest holds for all
    w = w.withColumn("level", F.max("level").over(everything))
    return w.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, threshold): take ``copies`` of all, one more of those with hash <= threshold."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    state = plan.withColumn("copies", whole).withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    state = written(state.select("source", "source_size", "target", "copies", "rest", F.lit(0).cast("long").alias("low"), F.lit(False).alias("over")), "mix-state")
    sources = state.count()
    for shift in range(BITS - STEP, -1, -STEP):
        # state.low: all hashes below it are taken; the boundary lies in [low, low + 2^(shift+STEP))
        inside = sized.join(_sent(state.select(F.col("source").alias("s"), "low"), sources), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << (shift + STEP))))
        bars = inside.groupBy("source", F.shiftright(F.col("hash"), shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        bars = bars.withColumn("upto", F.sum("words").over(run)).select(F.col("source").alias("s"), "bucket", "words", "upto")
        hit = state.join(bars, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("rest")), "left")
        hit = hit.groupBy("source", "source_size", "target", "copies", "rest", "low").agg(F.min(F.struct("bucket", "words", "upto")).alias("b"))
        # without such a bucket the budget takes the whole range
        found = F.col("b").isNotNull()
        nearer = (F.col("rest") - (F.col("b.upto") - F.col("b.words"))) * 2 >= F.col("b.words") if shift == 0 else F.lit(False)
        old = state
        state = written(hit.select("source", "source_size", "target", "copies", F.when(found, F.col("rest") - (F.col("b.upto") - F.col("b.words"))).otherwise(F.col("rest")).alias("rest"), F.when(found, F.shiftleft(F.col("b.bucket"), shift)).otherwise(F.col("low") + F.lit(1 << (shift + STEP))).alias("low"), (found & nearer).alias("over")), "mix-state")
        dropped(old)
    # every hash below low is taken, and low itself where that is nearer to the budget
    return state.select("source", "source_size", "target", "copies", (F.col("low") - F.when(F.col("over"), 0).otherwise(1)).alias("threshold"))


def planned(docs: DataFrame, id_col: str, text: str, source: str, cap: float) -> tuple[DataFrame, DataFrame]:
    """The sizes of all rows, and the thresholds, a row a source."""
    size = F.size(F.regexp_extract_all(text_of(docs, text), F.lit(WORD), F.lit(0))).cast("long")
    sized = written(docs.select(docs[id_col].alias("doc_id"), docs[source].cast("string").alias("source"), hash_of(docs[id_col], docs[text]).alias("hash"), size.alias("size")), "mix-sizes")
    return sized, thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap)).withColumnRenamed("source", "s")


def _copies(value_hash: Column, cap: float) -> Column:
    once_more = F.when((value_hash <= F.col("threshold")) & (F.col("source_size") > 0), 1).otherwise(0)
    return F.least(F.col("copies") + once_more, F.lit(math.ceil(cap))).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", cap: float = 3.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken (and source, copies).

    Null sources form one source, the last. A row's hash is of its id and text, so rows with null or repeated ids are told
    apart by their texts; rows that have both in common are taken or left together. Null and empty texts have size 0.
    Sources without words have target 0. Only the columns named are read. An empty table gives an empty result. The
    number of sources must fit one task: one row a source is ranked there.
    """
    with scratch() as keep:
        sized, found = planned(docs, id_col, text, source, cap)
        n = _copies(F.col("hash"), cap)
        out = sized.join(_sent(found, found.count()), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), "source", n.alias("copies"))
        out = written(out, "mix-found")
        keep(out)
    return out


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", cap: float = 3.0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns as they were, whatever their names.

    Texts don't move: a row's own id, text and source say how often it is taken. Nulls, empty texts, repeated rows and
    empty tables are as :func:`mix` says; a row without words has at most ``cap`` copies like any other.
    """
    with scratch() as keep:
        sized, found = planned(docs, id_col, text, source, cap)
        found = written(found, "mix-plan")
        keep(found)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), hash_of(docs[id_col], docs[text]).alias("hash"), docs[source].cast("string").alias("source"))
    joined = rows.join(_sent(found, found.count()), F.col("source").eqNullSafe(F.col("s"))).select("row", F.explode(F.array_repeat(F.lit(1), _copies(F.col("hash"), cap))).alias("one"))
    return joined.select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: Rounds of resharing that the SQL spells out: one a source at most is ever needed.
_MIX = r"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
      ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS hash FROM {docs}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, 3.0 * source_size AS most, sum(source_size) OVER () AS total FROM s0),
r AS (SELECT 0 AS round, source, CAST(0 AS BOOLEAN) AS capped FROM s1
  UNION ALL
  SELECT round + 1, source, capped OR full_now FROM (
    SELECT r.round, s1.source, r.capped,
      s1.most <= s1.weight * (s1.total - sum(CASE WHEN r.capped THEN s1.most ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN r.capped THEN 0 ELSE s1.weight END) OVER (), 0) AS full_now,
      bool_or(NOT r.capped) OVER () AS open
    FROM r JOIN s1 ON r.source IS NOT DISTINCT FROM s1.source) WHERE open AND round < 40),
last AS (SELECT source, bool_or(capped) AS capped FROM r GROUP BY source),
t AS (SELECT s1.source, source_size, CASE WHEN capped THEN most ELSE weight * (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) END AS target
  FROM s1 JOIN last ON s1.source IS NOT DISTINCT FROM last.source),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS copies FROM t),
e AS (SELECT *, greatest(target - copies * source_size, 0) AS rest FROM c),
h AS (SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
m AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target,
  e.copies + CASE WHEN e.source_size > 0 AND (u.upto <= e.rest OR (u.upto - u.words <= e.rest AND (e.rest - (u.upto - u.words)) * 2 >= u.words)) THEN 1 ELSE 0 END AS copies
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.hash = u.hash)
"""
SQL = {"op10_mixing": "WITH RECURSIVE " + _MIX.format(docs="documents") + "SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target, CAST(size * copies AS BIGINT) AS taken FROM m"}
