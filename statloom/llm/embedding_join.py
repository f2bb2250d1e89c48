"""Embedding near-dedup by an exact metric range join.

Unit vectors within a cosine of at least ``threshold`` are at most r = sqrt(2 - 2 * threshold) apart. Each label has pivots
of its own, as many as its size asks for, and they partition its vectors: a vector's home cell is that of its nearest
pivot. A vector within r of one whose home is another cell lies within r of the plane between the two pivots, and, by the
triangle inequality, within r of the cell's range of distances to its own pivot; it is copied to each cell of which both
hold. So every vector's home cell holds all its partners, and cells join independently, as products of blocks of bounded
size. Both tests compare squares and allow for their rounding: 2 - 2cos says nothing of pivots a few rounding errors
apart, and a root or quotient of it even less.

Equal vectors of a label are one row that counts as many. No pair is emitted: a block returns each vector's number of
partners and links that connect its groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written
from .components import components
from .trie import Union

THRESHOLD, BLOCK, PER_PIVOT = 0.98, 2048, 2048
#: Pivots that are sent to every task, and labels that have any: the largest. Beyond that cells grow, and their blocks' number.
MOST_PIVOTS = 4096
#: More than the rounding errors of a few squared distances 2 - 2cos add up to, in up to a thousand dimensions.
ERROR = 1e-12


def _unit(raw: list) -> np.ndarray:
    m = np.array(raw, np.float64)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _squares(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return 2.0 - 2.0 * (m @ pivots.T)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, squares))


def _by_space(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The spaces (label and length) of a batch's vectors, and their rows."""
    found = batch.column("space").dictionary_encode()
    at = found.indices.to_numpy()
    for k, space in enumerate(found.dictionary.to_pylist()):
        yield space, np.flatnonzero(at == k)


def _homes(pivots):
    """(space, home, low, high): the range of a batch's squared distances, for each pivot that may be nearest to a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, rows in _by_space(batch):
                if space in pivots.value:
                    d = _squares(_unit(batch.column("embedding").take(pa.array(rows)).to_pylist()), pivots.value[space])
                    may = d <= d.min(1)[:, None] + ERROR
                    home = np.flatnonzero(may.any(0))
                    low, high = np.where(may, d, np.inf).min(0), np.where(may, d, -np.inf).max(0)
                    yield pa.RecordBatch.from_arrays([pa.array([space] * len(home)), pa.array(home, pa.int32()), pa.array(low[home]), pa.array(high[home])], ["space", "home", "low", "high"])

    return run


def _cells(pivots, ranges, radius: float):
    """(cid, pivot, home): the cells of each vector; those of a space without pivots are in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart: dict[str, np.ndarray] = {}
        for batch in batches:
            for space, rows in _by_space(batch):
                cid = batch.column("cid").take(pa.array(rows))
                if space not in pivots.value:
                    yield pa.RecordBatch.from_arrays([cid, pa.array(np.zeros(len(rows)), pa.int32()), pa.array(np.ones(len(rows), bool))], ["cid", "pivot", "home"])
                    continue
                p, (low, high) = pivots.value[space], ranges.value[space]
                if space not in apart:  # differences of the pivots, as 2 - 2cos loses distances below about 1e-8
                    apart[space] = np.array([np.sqrt(((p - q) ** 2).sum(1)) for q in p])
                low, high = _root(low - ERROR) - radius, _root(high + ERROR) + radius
                d = _squares(_unit(batch.column("embedding").take(pa.array(rows)).to_pylist()), p)
                home = d.argmin(1)
                mine = d[np.arange(len(d)), home]
                near = (d - mine[:, None] <= 2 * radius * apart[space][home] + ERROR) & (_root(d - ERROR) <= high) & (_root(d + ERROR) >= low)
                near[np.arange(len(d)), home] = True
                row, col = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([cid.take(pa.array(row)), pa.array(col, pa.int32()), pa.array(home[row] == col)], ["cid", "pivot", "home"])

    return run


def _pivots(classes: DataFrame) -> dict[str, np.ndarray]:
    """Pivots of the spaces with more than ``PER_PIVOT`` vectors: their vectors with the smallest hashes, about one in so
    many, fewer where they would be more than ``MOST_PIVOTS`` in all."""
    large = classes.groupBy("space").count().filter(F.col("count") > PER_PIVOT).orderBy(F.desc("count"), "space").limit(MOST_PIVOTS).collect()
    if not large:
        return {}
    share = min(1 / PER_PIVOT, MOST_PIVOTS / sum(r["count"] for r in large))
    some = classes.filter((F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < F.lit(share * (1 << 30))))
    some = some.join(F.broadcast(classes.sparkSession.createDataFrame([(r["space"],) for r in large], "space string")), "space", "left_semi")
    found: dict[str, list] = {}
    for r in some.select("space", "unit").collect():
        found.setdefault(r["space"], []).append(r["unit"])
    return {k: _unit(sorted(v)) for k, v in found.items()}


def _block(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        x, y = _unit(a["embedding"].tolist()), _unit(b["embedding"].tolist())
        ids, others, many = a["cid"].to_numpy(), b["cid"].to_numpy(), b["n"].to_numpy()
        place = {c: i for i, c in enumerate(dict.fromkeys([*ids.tolist(), *others.tolist()]))}
        groups, out = Union(len(place)), []
        at = np.array([place[c] for c in others.tolist()])
        for i in range(0, len(x), 512):
            hit = (x[i : i + 512] @ y.T >= threshold) & (ids[i : i + 512, None] != others[None, :])
            links = (hit * many).sum(1)
            for k in np.flatnonzero(links).tolist():
                u = int(ids[i + k])
                out.append((u, u, int(links[k])))
                out += [(u, int(others[j]), 0) for j in np.flatnonzero(hit[k]).tolist() if groups.join(place[u], int(at[j]))]
        return pd.DataFrame(out, columns=["u", "v", "links"], dtype="int64")

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) link when their cosine in double precision is at least ``threshold``. Vectors that
    are null, zero, or hold a null or non-finite component link with nothing; vectors of different lengths don't link.
    Repeated rows are vectors of their own and link. Null ids are never smallest. Only the three columns named are read.
    An empty table gives an empty result.
    """
    with scratch() as keep:
        out = written(_near_vectors(vectors, id_col, embedding, label, threshold), "vector-found")
        keep(out)
    return out


def _near_vectors(vectors: DataFrame, id_col: str, embedding: str, label: str, threshold: float) -> DataFrame:
    spark = vectors.sparkSession
    e = vectors[embedding].cast("array<double>")
    fine = vectors[label].isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False))
    rows = written(vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), e.alias("embedding"), fine.alias("fine")), "vectors")
    # values are scaled by their largest, so that squares neither overflow nor vanish
    scaled = F.transform("embedding", lambda v: v / F.array_max(F.transform("embedding", lambda w: F.abs(w))))
    classes = rows.filter("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), F.concat_ws(":", F.size("embedding"), "label").alias("space"), F.size("embedding").alias("dim"), "label", "embedding", scaled.alias("unit"), "least", "n"), "vector-classes")
    chosen = _pivots(classes)
    pivots = spark.sparkContext.broadcast(chosen)
    vector = F.col("unit").alias("embedding")
    low, high = {k: np.full(len(p), np.inf) for k, p in chosen.items()}, {k: np.full(len(p), -np.inf) for k, p in chosen.items()}
    for r in classes.select("space", vector).mapInArrow(_homes(pivots), "space string, home int, low double, high double").groupBy("space", "home").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["space"]][r["home"]], high[r["space"]][r["home"]] = r["low"], r["high"]
    ranges = spark.sparkContext.broadcast({k: (low[k], high[k]) for k in chosen})
    radius = float(np.sqrt(2.0 - 2.0 * threshold + ERROR))
    cells = classes.select("cid", "space", vector).mapInArrow(_cells(pivots, ranges, radius), "cid long, pivot int, home boolean")
    cells = written(cells.join(classes.select("cid", "space", vector, "n"), "cid"), "vector-cells")
    size = cells.groupBy("space", "pivot").agg(F.ceil(F.count_if("home") / BLOCK).cast("long").alias("home_blocks"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).filter("home_blocks > 0")
    cells = cells.join(size, ["space", "pivot"])
    own = lambda col: F.array(F.pmod(F.xxhash64("cid"), F.col(col)))
    every = lambda col: F.sequence(F.lit(0).cast("long"), F.col(col) - 1)
    parts = lambda df, a, b, asks: df.withColumn("a", F.explode(a)).withColumn("b", F.explode(b)).select("space", "pivot", "a", "b", "cid", "embedding", "n", F.lit(asks).alias("asks"))
    work = parts(cells.filter("home"), own("home_blocks"), every("blocks"), True).unionByName(parts(cells, every("home_blocks"), own("blocks"), False))
    links = written(work.groupBy("space", "pivot", "a", "b").applyInPandas(_block(threshold), "u long, v long, links long"), "vector-links")
    group = components(links.filter("links = 0").select("u", "v")).withColumnRenamed("node", "cid")
    count = links.filter("links > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    known = classes.join(group, "cid", "left").join(count, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    keyed = lambda df: df.withColumn("_h", F.xxhash64("label", "embedding"))
    out = keyed(rows.filter("fine")).join(keyed(known).withColumnRenamed("label", "_l").withColumnRenamed("embedding", "_e"), "_h").filter("label = _l and embedding = _e").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = {
    "op5_embedding_join": r"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT u AS node, u AS seen FROM l UNION SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT x.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component, x.vec_id) AS component_id, x.vec_id = coalesce(c.component, x.vec_id) AS kept
FROM embeddings x LEFT JOIN c ON c.node = x.vec_id LEFT JOIN n ON n.u = x.vec_id
"""
}
