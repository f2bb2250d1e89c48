"""Substring dedup by a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of a document. The index holds the 64-bit fingerprints of all windows seen so far
in sorted immutable runs, cut by ranges of hashes, each fingerprint with the bundle of documents that had it first. A new
batch's windows are sorted, dealt out by range and merge-joined with the range's runs and with one another; what the runs
lack becomes a new run. Two runs of a level are compacted into one of the next, so a fingerprint is rewritten a logarithmic
number of times. What comes back to a bundle of documents is a bit for each of its windows, and for those that were found
the bundle to compare with.

Fingerprints only propose. Found windows in a row make a stretch of words, which is sent to the other bundle and compared
there, window by window, with the words that have the same fingerprint. Fingerprints whose words differ anywhere clash:
all windows that have one of those are grouped by their words instead, which gives their exact answer.

Scale: a bundle sends a window once, however often its documents repeat it, so a window that stands in a third of all
documents costs a row a bundle; equal stretches are compared once; a bundle that many others ask is asked in parts. Ranges
are as many as the corpus needs for a fixed number of windows each, and only those that a bundle's windows fall in are
visited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import planes, squeeze, unplanes, unsqueeze
from .bundles import SCHEMA, bundled, range_bits, ranges
from .common import dropped, rows_of, scratch, stored, table, written
from .textvec import chunks, grams, words

WINDOW, PER_RANGE, BATCHES = 13, 1 << 20, 3
#: Leading bits of a window's hash that are its fingerprint.
FINGERPRINT_BITS = 64
#: Windows of a stretch, stretches that a bundle compares at a time, and clashing fingerprints that are sent to every task.
STRETCH, ASKED, MOST_SENT = 4096, 4096, 1 << 16
U = np.uint64
RUN = "bundle long, range int, h binary, sources binary, source binary"
FOUND = "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<long>, source long, stretch binary, h long"
RESULT = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]


def order_keys(ids: list) -> np.ndarray:
    """Unsigned integers in the order of the ids, nulls last."""
    return np.array([(1 << 64) - 1 if i is None else i + (1 << 63) for i in ids], U)


class Windows:
    """The windows of a bundle, sorted by fingerprint and then by document, and where they stand."""

    def __init__(self, ids: list, texts: list[bytes], window: int = WINDOW, bits: int = 64):
        counts, h, at, doc, base = [], [], [], [], 0
        for a, b in chunks(texts):
            n, (p,) = words(texts[a:b])
            counts.append(n)
            own = np.repeat(np.arange(a, b, dtype=np.int32), n)
            if len(p) >= window:
                full = np.flatnonzero(own[: len(own) - window + 1] == own[window - 1 :])
                h.append(grams(p, window)[full]), at.append(full + base), doc.append(own[full])
            base += len(p)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.counts, self.window, self.total, self.texts = join(counts, np.int64), window, base, texts
        h, at, doc = join(h, U) >> U(64 - bits) << U(64 - bits), join(at, np.int64), join(doc, np.int32)
        key = order_keys(ids)[doc]
        order = np.lexsort((key, h))
        h, self.at, key = h[order], at[order], key[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        #: Of each fingerprint: itself, its first document's key, and a place in that document.
        self.h, self.key, self.first = h[first], key[first], self.at[first]
        self.later = key > self.key[self.group] if len(h) else np.zeros(0, bool)

    def split(self) -> list[bytes]:
        return list(chain.from_iterable(t.split() for t in self.texts))

    def same(self, mine: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Whether windows at places of ``mine`` have the words of those at places of ``other``; both are numbers of words."""
        out = np.ones(len(at), bool)
        for j in range(self.window):
            out &= mine[at + j] == other[there + j]
        return out

    def covered(self, start: np.ndarray) -> np.ndarray:
        """Which words are in the windows that start there."""
        edge = np.zeros(self.total + self.window + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.window, -1)
        return np.cumsum(edge)[: self.total] > 0


def _numbers(words_: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A number for each word: equal words, and only those, have the same."""
    return np.fromiter((known.setdefault(w, len(known)) for w in words_), np.int64, len(words_))


def _encoded(texts: list) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _ask(bits: int, window: int, fingerprint: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, ids, texts in rows_of(batches):
            w = Windows(ids, _encoded(texts), window, fingerprint)
            keys, ordinal = np.unique(w.key, return_inverse=True)
            keys, ordinal = planes(keys), ordinal.astype(np.uint32)
            out = [(bundle, r, squeeze(w.h[a:b]), keys, planes(ordinal[a:b])) for r, a, b in ranges(w.h, 64 - bits)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32()] + [pa.binary()] * 3, strict=True)], ["bundle", "range", "h", "keys", "ordinal"])

    return run


def _indexed(values: np.ndarray) -> tuple[bytes, bytes]:
    every, at = np.unique(values, return_inverse=True)
    return planes(every), planes(at.astype(np.uint32))


def _unindexed(every: bytes, at: bytes) -> np.ndarray:
    return unplanes(every, np.int64)[unplanes(at, np.uint32)]


def _merge(keep: bool):
    """Rows of runs (range, h, sources, source) and of bundles (bundle, range, h, keys, ordinal) of a range: the bundles'
    replies and, without a bundle, the new run."""

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(new):
            r, hs = int(new["range"].iloc[0]), [unsqueeze(b) for b in new["h"]]
            h = np.concatenate(hs)
            key = np.concatenate([unplanes(k, U)[unplanes(o, np.uint32)] for k, o in zip(new["keys"], new["ordinal"], strict=True)])
            who = np.repeat(new["bundle"].to_numpy(np.int64), [len(x) for x in hs])
            order = np.lexsort((key, h))
            first = np.ones(len(h), bool)
            first[1:] = h[order][1:] != h[order][:-1]
            start, group = order[np.flatnonzero(first)], np.cumsum(first) - 1
            own, source, past = h[start], who[start], np.zeros(len(start), bool)
            for b, s, t in zip(old["h"], old["sources"], old["source"], strict=True):
                have, of = unsqueeze(b), _unindexed(s, t)
                at = np.minimum(np.searchsorted(have, own), len(have) - 1)
                found = have[at] == own
                past |= found
                source[found] = of[at[found]]
            hit, whence = np.empty(len(h), bool), np.empty(len(h), np.int64)
            hit[order] = past[group] | (key[order] > key[start][group])
            whence[order] = source[group]
            cut = np.cumsum([0] + [len(x) for x in hs])
            for b, x, y in zip(new["bundle"], cut, cut[1:]):
                out.append((int(b), r, planes(np.packbits(hit[x:y])), *_indexed(whence[x:y][hit[x:y]])))
            if keep and not past.all():
                out.append((None, r, squeeze(own[~past]), *_indexed(source[~past])))
        return pd.DataFrame(out, columns=["bundle", "range", "h", "sources", "source"]).astype({"bundle": "Int64"})

    return run


def _compact(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of a range as one; they have no fingerprint in common."""
    h, source = np.concatenate([unsqueeze(b) for b in rows["h"]]), np.concatenate([_unindexed(s, t) for s, t in zip(rows["sources"], rows["source"], strict=True)])
    order = np.argsort(h, kind="stable")
    return pd.DataFrame([(None, rows["range"].iloc[0], squeeze(h[order]), *_indexed(source[order]))], columns=["bundle", "range", "h", "sources", "source"]).astype({"bundle": "Int64"})


def _answer(bits: int, window: int, fingerprint: int):
    """From (ids, texts, replies, exact): results (kind 0), stretches to compare (1), clashing fingerprints (2). ``exact``
    says of windows at some places whether they go, whatever the replies say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, replies, exact in rows_of(batches):
            w = Windows(ids, _encoded(texts), window, fingerprint)
            hit, source, at = np.zeros(len(w.h), bool), np.zeros(len(w.h), np.int64), {r: (a, b) for r, a, b in ranges(w.h, 64 - bits)}
            for x in replies or []:
                a, b = at[x["range"]]
                own = np.unpackbits(unplanes(x["h"], np.uint8))[: b - a].astype(bool)
                hit[a:b] = own
                source[a:b][own] = _unindexed(x["sources"], x["source"])
            goes, flat = np.zeros(w.total + 1, bool), w.split()
            goes[w.at[w.later | hit[w.group]]] = True
            for x in exact or []:
                goes[x["at"]] = x["hit"]
            out = [] if exact is not None else _to_verify(w, flat, hit, source)
            gone, k = w.covered(np.flatnonzero(goes)), 0
            for doc_id, n in zip(ids, w.counts.tolist(), strict=True):
                own, g = flat[k : k + n], gone[k : k + n]
                k += n
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                kept = b" ".join(compress(own, ~g)) if len(edge) else b" ".join(own)
                out.append((0, doc_id, n, int(g.sum()), hashlib.sha256(kept).hexdigest(), edge.tolist(), None, None, None))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64()]
            for a in range(0, len(out), 8192):
                some = zip(*out[a : a + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(some, kinds, strict=True)], [c.split(" ")[0] for c in FOUND.split(", ")])

    return run


def _to_verify(w: Windows, flat: list[bytes], hit: np.ndarray, source: np.ndarray) -> list[tuple]:
    out, none = [], (None,) * 5
    again = np.flatnonzero(w.at != w.first[w.group])
    if len(again):
        mine = _numbers(flat, {})
        group = w.group[again]
        differ = ~w.same(mine, w.at[again], mine, w.first[group])
        out += [(2, *none, None, None, h) for h in np.unique(w.h[group[differ]]).view(np.int64).tolist()]
    if hit.any():
        place, whence = w.first[hit], source[hit]
        order = np.argsort(place)
        place, whence = place[order], whence[order]
        doc = np.searchsorted(np.cumsum(w.counts), place, "right")
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (whence[1:] != whence[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        seen = set()
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(place)]):
            for c in range(a, b, STRETCH):
                text = b" ".join(flat[place[c] : place[min(c + STRETCH, b) - 1] + w.window])
                if (key := (int(whence[c]), text)) not in seen:
                    seen.add(key)
                    out.append((1, *none, key[0], text, None))
    return out


def _compare(window: int, fingerprint: int):
    """Clashing fingerprints of rows (ids, texts, stretches): those whose words in a stretch aren't the bundle's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, stretches in rows_of(batches):
            w, s = Windows(ids, _encoded(texts), window, fingerprint), Windows([0] * len(stretches), stretches, window, fingerprint)
            known: dict[bytes, int] = {}
            mine, theirs = _numbers(w.split(), known), _numbers(s.split(), known)
            at = np.minimum(np.searchsorted(w.h, s.h), max(len(w.h) - 1, 0))
            # a stretch holds only windows that were found; one by chance that the bundle lacks is none of them
            there = (w.h[at] == s.h)[s.group] if len(w.h) else np.zeros(len(s.at), bool)
            differ = ~w.same(theirs, s.at[there], mine, w.first[at[s.group[there]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(s.h[s.group[there][differ]]).view(np.int64), pa.int64())], ["h"])

    return run


def _spelled(window: int, fingerprint: int, some: frozenset | None):
    """Windows as (bundle, at, id, h, words): those with a fingerprint of ``some``, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.array(sorted(some), np.int64).view(U) if some is not None else None
        for bundle, ids, texts in rows_of(batches):
            w = Windows(ids, _encoded(texts), window, fingerprint)
            group = np.flatnonzero(np.isin(w.h, only)) if only is not None else np.arange(len(w.h))
            pick, flat = np.flatnonzero(np.isin(w.group, group)), w.split()
            doc = np.searchsorted(np.cumsum(w.counts), w.at[pick], "right")
            for a in range(0, len(pick), 8192):
                at = w.at[pick[a : a + 8192]].tolist()
                cols = [pa.array([bundle] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([ids[k] for k in doc[a : a + 8192].tolist()], pa.int64()), pa.array(w.h[w.group[pick[a : a + 8192]]].view(np.int64), pa.int64()), pa.array([b" ".join(flat[x : x + window]) for x in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bundle", "at", "id", "h", "words"])

    return run


class WindowIndex:
    """An index that grows by batches. What it holds is earlier than a new batch, so batches come in the order of their
    ids. With a ``folder`` that all machines share, an index that lies there is opened, and what is added stays there for
    later sessions; without, it lasts as long as the application."""

    def __init__(self, spark: SparkSession, bits: int = 4, window: int = WINDOW, folder: str | None = None, fingerprint: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.bits, self.window, self.fingerprint = bits, window, fingerprint or FINGERPRINT_BITS
        self.runs: list[tuple[int, DataFrame]] = []
        self.docs: list[DataFrame] = []
        self.replies: dict[int, DataFrame] = {}
        self.batch = 0
        if self.folder and self._exists(f"{self.folder}/manifest"):
            self._open()

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _open(self) -> None:
        rows = self.spark.read.parquet(f"{self.folder}/manifest")
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).orderBy("level", "path").collect()
        self.batch, self.bits, self.window, self.fingerprint = (rows[0][k] for k in ("batch", "bits", "window", "fingerprint"))
        self.docs = [stored(self.spark, f"{self.folder}/{r['path']}", SCHEMA) for r in rows if r["level"] < 0]
        self.runs = [(r["level"], stored(self.spark, f"{self.folder}/{r['path']}", RUN)) for r in reversed(rows) if r["level"] >= 0]

    def _save(self) -> None:
        """The manifest of the last batch: which tables make the index. It is written once they all are."""
        name = lambda df: df._statloom_path.rsplit("/", 1)[1]
        rows = [(self.batch, self.bits, self.window, self.fingerprint, level, name(df)) for level, df in [*((-1, d) for d in self.docs), *self.runs]]
        self.spark.createDataFrame(rows, "batch long, bits int, window int, fingerprint int, level int, path string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def feed(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
        """Proposals for a batch (columns ``FOUND``), which the index then holds; :meth:`settled` makes results of them."""
        args = (self.bits, self.window, self.fingerprint)
        cut = written(bundled(docs, id_col, text, batch=self.batch), "windows-docs", self.folder)
        asked = cut.mapInArrow(_ask(*args), "bundle long, range int, h binary, keys binary, ordinal binary")
        old = self._rows(self.runs)
        out = written(old.groupBy("range").cogroup(asked.groupBy("range")).applyInPandas(_merge(keep), RUN), "windows-run", self.folder)
        found = written(self._answers(cut, out, None), "windows-found")
        self.docs.append(cut)
        self.replies[self.batch] = out
        self.batch += 1
        before = []
        if keep:
            self.runs.append((0, out))
            while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
                two, level = self.runs[-2:], self.runs[-1][0] + 1
                self.runs[-2:] = [(level, written(self._rows(two).groupBy("range").applyInPandas(_compact, RUN), "windows-run", self.folder))]
                before += [df for _, df in two]
        if self.folder:
            self._save()
        for k, df in self.replies.items():  # those tables hold replies, too
            if any(df is b for b in before):
                self.replies[k] = written(df.filter("bundle is not null"), "windows-replies")
        dropped(*before)
        return found

    def _rows(self, runs: list[tuple[int, DataFrame]]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN)
        for _, df in runs:
            out = out.unionByName(df.filter("bundle is null"))
        return out

    def _answers(self, cut: DataFrame, replies: DataFrame, exact: DataFrame | None) -> DataFrame:
        packed = replies.filter("bundle is not null").groupBy("bundle").agg(F.collect_list(F.struct("range", "h", "sources", "source")).alias("replies"))
        both = cut.join(packed, "bundle", "left")
        if exact is None:
            both = both.withColumn("exact", F.lit(None).cast("array<struct<at:long,hit:boolean>>"))
        else:
            both = both.join(exact, "bundle", "left").withColumn("exact", F.coalesce("exact", F.array().cast("array<struct<at:long,hit:boolean>>")))
        return both.select("ids", "texts", "replies", "exact").mapInArrow(_answer(self.bits, self.window, self.fingerprint), FOUND)

    def settled(self, found: dict[int, DataFrame]) -> DataFrame:
        """Results for the batches of these proposals (by number), after comparing words."""
        every = None
        for df in found.values():
            every = df if every is None else every.unionByName(df)
        docs = self.docs[0]
        for df in self.docs[1:]:
            docs = docs.unionByName(df)
        asked = every.filter("kind = 1").select("source", "stretch").distinct()
        parts = asked.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("long").alias("parts"))
        asked = asked.join(parts, "source").groupBy(F.col("source").alias("bundle"), F.pmod(F.xxhash64("stretch"), F.col("parts")).alias("part")).agg(F.collect_list("stretch").alias("stretches"))
        differ = docs.join(asked, "bundle").select("ids", "texts", "stretches").mapInArrow(_compare(self.window, self.fingerprint), "h long")
        clashes = written(differ.unionByName(every.filter("kind = 2").select("h")).distinct(), "windows-clashes")
        if clashes.isEmpty():
            return every.filter("kind = 0").select(RESULT)
        few = clashes.limit(MOST_SENT + 1).collect()
        some = frozenset(r["h"] for r in few) if len(few) <= MOST_SENT else None
        rows = written(docs.mapInArrow(_spelled(self.window, self.fingerprint, some), "bundle long, at long, id long, h long, words binary").join(clashes, "h", "left_semi"), "windows-spelled")
        me = F.struct(F.col("id").isNull().alias("no"), "id")
        first = rows.groupBy("words").agg(F.min(me).alias("first"))
        verdict = rows.join(first, "words").groupBy("bundle").agg(F.collect_list(F.struct("at", (me > F.col("first")).alias("hit"))).alias("exact"))
        verdict, out = written(verdict, "windows-verdict"), None
        for k in found:
            again = self._answers(self.docs[k - self.batch + len(self.docs)], self.replies[k], verdict)
            out = again if out is None else out.unionByName(again)
        return out.filter("kind = 0").select(RESULT)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each row of the batch: doc_id, n_words, n_removed, kept_sha256 and ``removed``, word places at
        which removed stretches start and end in turn. Nulls, empty texts and repeated rows are as :func:`dedup` says."""
        with scratch() as hold:
            found = self.feed(docs, id_col, text)
            out = written(self.settled({self.batch - 1: found}), "windows-result")
            hold(out, *self.docs, *[df for _, df in self.runs])
        del self.replies[self.batch - 1]
        return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, removed; fed in ``batches`` ranges of ids.

    A word goes if a window that covers it also starts in a document with a smaller id. Rows of one id never remove each
    other's words; null ids come after all others; ids are integers, or are cast to them. Null texts have no words; texts
    shorter than a window keep all; they may be of any length. Only the two columns named are read. An empty table gives
    an empty result.
    """
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    with scratch() as hold:
        cuts = own.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
        cuts = sorted(set(cuts or []))
        index, found = WindowIndex(docs.sparkSession, range_bits(own, "text", PER_RANGE), window), {}
        for k in range(len(cuts) + 1):
            low = F.col("id") > cuts[k - 1] if k else F.lit(True)
            part = own.filter(low & (F.col("id") <= cuts[k])) if k < len(cuts) else own.filter(F.col("id").isNull() | low)
            found[k] = index.feed(part, "id", "text", keep=k < len(cuts))
        out = written(index.settled(found), "windows-result")
        hold(out)
    return out


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = {
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first_id FROM x GROUP BY g),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS places FROM x JOIN f USING (g) WHERE first_id < doc_id GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed, CASE WHEN places IS NULL THEN ws ELSE [ws[j] for j in range(1, len(ws) + 1) if NOT list_contains(places, j)] END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
}
