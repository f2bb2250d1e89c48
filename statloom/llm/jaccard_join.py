"""N-gram Jaccard join by prefix trees.

Documents with equal shingle sets become one class, and classes are joined:

1. Document frequencies of all shingles are counted exactly: bundles of classes send their sorted distinct hashes by
   range and get back the logarithm of each one's frequency. The frequency orders shingles globally, rare ones first.
2. A class of n shingles links only if it shares one of the first n - ceil(3n/4) + 1 of that order with its partner.
   Shingles that no other class has can't be shared, and a class with fewer than 3/4 of its shingles shared is done.
3. Classes that share such a shingle form clusters (connected components of class numbers). Each cluster's sets go once
   to one task, which stores them in a trie, walks it for each set, and prunes subtrees in which too few elements are
   left for a link or all sets are of the group that the walking set is in.
4. A cluster too large for a task is cut into blocks. Each block first joins itself and a few sets of the cluster that
   go to all blocks; only sets that this leaves outside the cluster's largest group then meet the other blocks.

No pair is emitted but links that connect groups that weren't connected before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import planes, squeeze, unplanes, unsqueeze
from .bundles import bundled, range_bits, ranges
from .common import dropped, fresh, id_text_hash, rows_of, scratch, spread_join, table, text_of, trimmed, written
from .components import components
from .textvec import shingle_sets
from .trie import spanning_links

WORDS, PER_RANGE = 5, 1 << 20
#: Shingles of a block of a cluster, of the work that one task gets at a time, and sets that all blocks share.
BLOCK_SHINGLES, TASK_SHINGLES, SHARED_SETS = 4 << 20, 4 << 20, 64
FREQ_BITS = 48
#: Shingles of the sets that a task returns at a time.
BATCH_SHINGLES = 1 << 17
U = np.uint64


def _lower(texts: list) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]


@trimmed
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_lower(batch.column(2).to_pylist()), WORDS)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "th", "n_shingles", "digest"])


def _entries(texts: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A bundle's sets, its sorted distinct shortened hashes, and how many sets have each."""
    sets = shingle_sets(_lower(texts), WORDS)
    every = np.concatenate(sets) >> U(64 - FREQ_BITS) if sets else np.zeros(0, U)
    return sets, *np.unique(every, return_counts=True)


def _ask(bits: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, _, texts in rows_of(batches):
            _, h, n = _entries(texts)
            n = n.astype(np.uint32)
            out = [(bundle, r, squeeze(h[a:b]), planes(n[a:b])) for r, a, b in ranges(h, FREQ_BITS - bits)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["bundle", "range", "h", "n"])

    return run


@trimmed
def _frequency(rows: pd.DataFrame) -> pd.DataFrame:
    hs = [unsqueeze(b) for b in rows["h"]]
    _, at = np.unique(np.concatenate(hs), return_inverse=True)
    total = np.bincount(at, np.concatenate([unplanes(b, np.uint32) for b in rows["n"]]))
    log = np.minimum(np.log2(total), 60).astype(np.uint8)[at]
    cut = np.cumsum([0] + [len(h) for h in hs])
    return pd.DataFrame({"bundle": rows["bundle"], "range": rows["range"], "h": [planes(log[a:b]) for a, b in zip(cut, cut[1:])]})


def _candidates(bits: int):
    """(class_id, n, keys, tokens): keys are the shared shingles of the prefix, tokens the whole set."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, replies in rows_of(batches):
            sets, h, _ = _entries(texts)
            del texts
            log, at = np.zeros(len(h), np.uint8), {r: (a, b) for r, a, b in ranges(h, FREQ_BITS - bits)}
            for x in replies or []:
                a, b = at[x["range"]]
                log[a:b] = unplanes(x["h"], np.uint8)
            out, held = [], 0
            for i, s in zip(ids, sets, strict=True):
                own = log[np.searchsorted(h, s >> U(64 - FREQ_BITS))]
                if len(s) and 4 * int(np.count_nonzero(own)) >= 3 * len(s):
                    order = np.lexsort((s, own))[: len(s) - (3 * len(s) + 3) // 4 + 1]
                    keys = s[order[own[order] > 0]]
                    if len(keys):
                        out.append((i, len(s), keys.view(np.int64), s.tobytes()))
                        held += len(s)
                if held >= BATCH_SHINGLES:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    i, n, keys, tokens = zip(*out, strict=True)
    cut = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cut, np.concatenate(keys)), pa.array(tokens, pa.binary())], ["class_id", "n", "keys", "tokens"])


@trimmed
def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links inside each unit of work: rows (unit, class_id, tokens, grp, asked)."""
    out = []
    for _, g in rows.groupby("unit"):
        g = g.drop_duplicates("class_id").sort_values("class_id")
        if len(g) > 1:
            ids = g["class_id"].tolist()
            links = spanning_links([np.frombuffer(t, U) for t in g["tokens"]], g["grp"].tolist(), None if g["asked"].all() else g["asked"].tolist())
            out += [(ids[a], ids[b]) for a, b in links]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _work(rows: DataFrame, total: int) -> DataFrame:
    """Links of rows (unit, class_id, tokens, grp, asked); units are dealt to as many groups as their size needs."""
    n = max(1, -(-total // TASK_SHINGLES) * 4)
    return rows.withColumn("_deal", F.pmod(F.xxhash64("unit"), F.lit(n))).groupBy("_deal").applyInPandas(_joined, "u long, v long")


def class_links(classes: DataFrame, shingles: int) -> DataFrame:
    """Links (u, v) that connect classes of sets as their similarities do; classes: (class_id, text), ``shingles`` in all."""
    with scratch() as keep:
        links = _class_links(classes, max(4, (shingles // PER_RANGE).bit_length()))
        keep(links)
    return links


def _class_links(classes: DataFrame, bits: int) -> DataFrame:
    cut = written(bundled(classes, "class_id", "text"), "join-docs")
    asked = cut.mapInArrow(_ask(bits), "bundle long, range int, h binary, n binary")
    replies = written(asked.groupBy("range").applyInPandas(_frequency, "bundle long, range int, h binary"), "join-frequency")
    replies_of = replies.groupBy("bundle").agg(F.collect_list(F.struct("range", "h")).alias("replies"))
    sets = cut.join(replies_of, "bundle", "left").select("ids", "texts", "replies").mapInArrow(_candidates(bits), "class_id long, n long, keys array<long>, tokens binary")
    sets = written(sets, "join-sets")
    dropped(cut, replies)
    keyed = sets.select("class_id", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("class_id").alias("m"), F.max("class_id").alias("most")).filter("m <> most").select("key", "m")
    near = keyed.join(low, "key").filter("class_id <> m").select(F.col("class_id").alias("u"), F.col("m").alias("v"))
    clusters = components(near)
    member = written(sets.select("class_id", "n", "tokens").join(clusters.withColumnRenamed("node", "class_id"), "class_id"), "join-members")
    dropped(sets)
    size = member.groupBy("component").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("sets"))
    size = written(size.select("component", "shingles", "sets", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("long").alias("blocks")), "join-clusters")
    total, most = size.agg(F.sum("shingles"), F.max("blocks")).first()
    member = member.join(size, "component")
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    shared = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class_id", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("sets") / SHARED_SETS))) == 0)
    units = F.when(shared, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))
    first = member.select("component", "class_id", "tokens", F.explode(units).alias("block"), F.col("class_id").alias("grp"), F.lit(True).alias("asked"))
    links = written(_work(first.withColumn("unit", F.concat_ws(":", "component", "block")), total or 0), "join-links")
    if (most or 0) > 1:
        large = member.filter("blocks > 1")
        grouped = large.join(components(links).withColumnRenamed("node", "class_id").withColumnRenamed("component", "g"), "class_id", "left").withColumn("grp", F.coalesce("g", "class_id")).drop("g")
        grouped = written(grouped, "join-grouped")
        counts = grouped.groupBy("component", "grp").agg(F.count(F.lit(1)).alias("k"))
        main = counts.groupBy("component").agg(F.max(F.struct("k", "grp")).alias("top")).select("component", F.col("top.grp").alias("main"))
        tagged = grouped.join(main, "component").withColumn("out", F.col("grp") != F.col("main"))
        outside = tagged.filter("out").groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("parts"))
        tagged = tagged.join(outside, "component")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        mine = tagged.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
        members = mine.withColumn("part", F.explode(upto(F.col("parts")))).withColumn("asked", F.lit(False))
        askers = mine.filter("out").withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(2)), F.col("parts"))).withColumn("block", F.explode(upto(F.col("blocks")))).withColumn("asked", F.lit(True))
        both = askers.unionByName(members).select("class_id", "tokens", "grp", "asked", F.concat_ws(":", "component", "block", "part").alias("unit"))
        total = both.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
        links = written(links.unionByName(_work(both, int(total))), "join-links")
    return links


def _grouped(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows' ids, hashes of id and text, and digests of their sets; and the classes of equal sets, each with its first
    row's id and hash and the component that links put it in."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    ids = written(rows.select("doc_id", id_text_hash(rows["doc_id"], rows["text"]).alias("th"), "text").mapInArrow(_digests, "doc_id long, th long, n_shingles long, digest binary"), "join-ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("first")
    classes = ids.filter("digest is not null").groupBy("digest").agg(first, F.first("n_shingles").alias("n")).select("digest", "n", "first.doc_id", "first.th")
    classes = written(classes.withColumn("class_id", F.monotonically_increasing_id()), "join-classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    texts = rows.withColumn("th", id_text_hash(rows["doc_id"], rows["text"]))
    texts = texts.join(classes.select("th", F.col("doc_id").alias("_first"), "class_id"), "th").filter(F.col("doc_id").eqNullSafe(F.col("_first"))).select("class_id", "text")
    parts = components(class_links(texts, shingles)).withColumnRenamed("node", "class_id")
    return ids, classes.drop("n").join(parts, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Documents whose sets of five-word shingles have a Jaccard similarity of 3/4 or more link; component_id is the smallest
    id that links reach. A text of fewer words is one shingle; one without words (or null) links with nothing. Texts may be
    of any length. Rows with equal sets link, repeated rows too; null ids don't count as smallest unless there is no
    other. class_id numbers the distinct sets, null for empty ones. An empty table gives an empty result. Only the two
    columns named are read, so others may have any name.
    """
    with scratch() as keep:
        ids, joined = _grouped(docs, id_col, text)
        named = joined.select("component", "digest", "class_id").join(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("digest", "class_id", "component_id")
        # a third of all rows may have one digest
        some = spread_join(ids.filter("digest is not null"), named, ["digest"], F.xxhash64("doc_id", "th")).select("doc_id", "n_shingles", "component_id", "class_id")
        none = ids.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
        found = written(some.unionByName(none), "join-found")
        keep(found)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents, that with the smallest id; columns as they were.

    Null ids come after all others; of rows with that same id, that with the smallest hash of id and text stays, and one of
    rows that have both in common. Rows without words link with nothing, so all of them stay. Columns may have any names.
    An empty table stays empty.
    """
    with scratch() as keep:
        ids, classes = _grouped(docs, id_col, text)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("first")
        heads = classes.groupBy("component").agg(first).select(F.col("first.doc_id").alias("k"), F.col("first.th").alias("h"))
        several = ids.filter("digest is not null").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        heads = heads.join(several, (F.col("h") == F.col("th")) & F.col("k").eqNullSafe(F.col("doc_id")), "left").select("k", "h", F.col("n").isNotNull().alias("again"))
        wordless = ids.filter("digest is null").select(F.col("doc_id").alias("k"), F.col("th").alias("h"), F.lit(False).alias("again")).distinct()
        best = written(heads.unionByName(wordless), "join-best")
        keep(best)
    k, h = fresh(docs, "_k"), fresh(docs, "_h")
    own, words = docs[id_col].cast("long"), text_of(docs, text)

    def of(again: bool) -> DataFrame:
        keys = best.filter(F.col("again") == again).select(F.col("k").alias(k), F.col("h").alias(h))
        return docs.join(keys, (id_text_hash(own, words) == F.col(h)) & own.eqNullSafe(F.col(k)), "left_semi")

    if best.filter("again").isEmpty():
        return of(False)
    row = fresh(docs, "_row")
    one = of(True).groupBy(own, words).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias(row)).select(f"{row}.*")
    return of(False).unionByName(one)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT u AS node, u AS seen FROM l UNION SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
}
