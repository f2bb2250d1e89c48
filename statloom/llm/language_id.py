"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes deep. The code length of a byte is that of its
probability in the longest context that the language knows, with an escape to the next shorter one where it never
followed (method C: a context seen n times with q different followers gives 1 of c/(n+q) and an escape of q/(n+q)); below
the shortest context all 256 bytes are equally likely. Statistics are frozen after training, without exclusions, so a
text's code length is a sum of numbers that depend on four bytes each. Those are tabulated once for all languages side
by side, and scoring is a look-up for each byte of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, trimmed
from .textvec import chunks

ORDER = 3
#: Training rows for each language, taken by a hash of id and text; all where there are fewer.
TRAIN_DOCS = 4000
#: Languages learned at most, the most frequent ones; the first by code point of equally frequent ones.
MOST_LANGS = 256
#: A text is in none of the languages if its best code takes more than so many bits a byte, and so many besides. Texts in
#: a learned language take 2 to 3, odd words and keys in them up to 7; in a script that no language has, bytes take over 8.
MOST_BITS, SLACK_BITS = 7.5, 64.0
PAD = b"\n" * ORDER


def _prepared(text: str) -> bytes:
    return PAD + text.lower().encode("utf-8", "replace")


def _keys(buf: np.ndarray) -> np.ndarray:
    """Four bytes up to each place, as an integer."""
    b = buf.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all places of all texts, and how many places each text has."""
    keys = _keys(np.frombuffer(b"".join(texts), np.uint8))
    n = np.array([len(t) - ORDER for t in texts])
    at = np.cumsum([0] + [len(t) for t in texts[:-1]])
    keep = np.concatenate([np.arange(a, a + k) for a, k in zip(at, n, strict=True)]) if len(texts) > 1 else slice(0, int(n[0]))
    return keys[keep], n


@trimmed
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lang, rows in b.groupby("lang"):
            texts = [_prepared(t) for t in rows["text"]]
            for x, y in chunks(texts):
                key, n = np.unique(_joined(texts[x:y])[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "key": key.astype(np.int64), "n": n})


class Model:
    """Frozen code lengths, in bits, of all languages side by side."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        width, code = max(1, len(self.langs)), counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(int)
        self.cost: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        key, n = counts["key"].to_numpy(np.int64), counts["n"].to_numpy(float)
        for order in range(ORDER + 1):
            sub, at = np.unique(key & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
            c = np.zeros((len(sub), width))
            np.add.at(c, (at, code), n)
            ctx, of = np.unique(sub >> 8, return_inverse=True)
            total, kinds = np.zeros((len(ctx), width)), np.zeros((len(ctx), width))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(known, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(c / (total + kinds)[of])
            lower = self._below(order, sub)
            self.cost.append((sub.astype(np.uint32), np.where(c > 0, seen, esc[of] + lower).astype(np.float32)))
            self.escape.append((ctx.astype(np.uint32), esc.astype(np.float32)))
        self._index()

    def _below(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Costs of ``keys`` by contexts shorter than ``order``."""
        if order == 0:
            return np.full((len(keys), max(1, len(self.langs))), 8.0)
        sub = (keys & ((1 << (8 * order)) - 1)).astype(np.uint32)
        have, cost = self.cost[order - 1]
        at = np.minimum(np.searchsorted(have, sub), max(len(have) - 1, 0))
        hit = have[at] == sub if len(have) else np.zeros(len(sub), bool)
        out = np.empty((len(sub), max(1, len(self.langs))), np.float64)
        out[hit] = cost[at[hit]]
        if not hit.all():
            miss = sub[~hit]
            ctx, esc = self.escape[order - 1]
            c = miss >> 8
            k = np.minimum(np.searchsorted(ctx, c), max(len(ctx) - 1, 0))
            known = (ctx[k] == c)[:, None] if len(ctx) else np.zeros((len(c), 1), bool)
            out[~hit] = np.where(known, esc[k] if len(ctx) else 0.0, 0.0) + self._below(order - 1, miss)
        return out

    def _index(self) -> None:
        """Two hash tables for the longest keys; what neither holds is found by search."""
        keys = self.cost[ORDER][0]
        self.bits = max(10, int(len(keys)).bit_length() + 2)
        self.slots = []
        rest = np.arange(len(keys))
        for mul in (0x9E3779B1, 0x85EBCA77):
            slot = self._slot(keys[rest], mul)
            where = np.full(1 << self.bits, len(keys), np.int32)
            where[slot] = rest
            self.slots.append((mul, where))
            rest = rest[where[slot] != rest]
        self.padded = np.append(keys, np.uint32(0))

    def _slot(self, key: np.ndarray, mul: int) -> np.ndarray:
        return (key * np.uint32(mul)) >> np.uint32(32 - self.bits)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each key's last byte after the others: one row a key, one column a language."""
        have, cost = self.cost[ORDER]
        if not len(have):
            return np.full((len(keys), max(1, len(self.langs))), 8.0, np.float32)
        mul, where = self.slots[0]
        at = where[self._slot(keys, mul)]
        miss = np.flatnonzero((self.padded[at] != keys) | (at == len(have)))
        mul, where = self.slots[1]
        at[miss] = where[self._slot(keys[miss], mul)]
        miss = miss[(self.padded[at[miss]] != keys[miss]) | (at[miss] == len(have))]
        at[miss] = 0
        out = cost[at]
        if len(miss):
            out[miss] = self._below(ORDER + 1, keys[miss])
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths in bits: one row a text, one column a language."""
        raw = [_prepared(t) for t in texts]
        out = np.zeros((len(raw), max(1, len(self.langs))))
        for a, b in chunks(raw):
            if b - a == 1 and len(raw[a]) > 1 << 20:
                for x in range(0, len(raw[a]) - ORDER, 1 << 20):
                    out[a] += self.costs(_keys(np.frombuffer(raw[a][x : x + (1 << 20) + ORDER], np.uint8))).sum(0, dtype=np.float64)
                continue
            keys, n = _joined(raw[a:b])
            cost = self.costs(keys)
            full = np.flatnonzero(n)
            if len(full):
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                out[a + full] = np.add.reduceat(cost, at, axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, key: str = "doc_id") -> Model:
    """A model from rows with a language; of each language about ``train_docs`` whole texts, chosen by hash.

    Counting runs on the executors; the driver gets the counts of four-byte strings, bounded by the sample. Null texts
    and languages teach nothing; without any row the model knows no language. Rows that repeat count as often as they do.
    """
    rows = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].cast("string").alias("text"), labelled[key].alias("key")).dropna(subset=["lang", "text"])
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    share = F.create_map(*[F.lit(x) for r in n for x in (r["lang"], min(1.0, train_docs / r["n"]))])[F.col("lang")] if n else F.lit(0.0)
    some = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    counts = some.mapInPandas(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())


def _lettered(texts: list[str]) -> np.ndarray:
    import regex

    letter = regex.compile(r"\p{L}")
    return np.array([bool(letter.search(t)) for t in texts], bool)


def _predict(shared):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bits = model.lengths(texts)
            best = bits.argmin(1)
            with np.errstate(over="ignore", under="ignore"):
                share = 1.0 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
            known = _lettered(texts) & bool(model.langs)
            size = np.array([max(1, len(t)) for t in texts])
            pred = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(bits.min(1) / size)], ["row", "lang_pred", "score", "bits"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, bits (a character, in the best language).

    ``und`` with score 0 if the text is null or has no letter, or the model knows no language; the score is the best
    language's share of all languages' probabilities. Ties go to the first language by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, bits double")


def held_out(doc_id, parts: int, of: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(docs["doc_id"], 5, 0)))
    found = predict(docs, model)
    return found.select("doc_id", held_out(found["doc_id"], 5, 0).alias("held_out"), "lang_pred", "score", "bits")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most_bits: float = MOST_BITS) -> DataFrame:
    """``docs`` without the rows whose language isn't identified, columns as they were; a null ``lang`` becomes the predicted one.

    Rows go whose text has no letter (null and empty ones too), or takes more than ``most_bits`` bits a byte and 64 bits
    besides in the best language: no language explains it. If no row has a language, nothing is learned, and texts
    without letters are all that goes. Null ids and repeated rows are judged like others; an empty table stays empty.
    """
    model = train(docs.filter(~held_out(docs[id_col], 5, 0)), text, lang, key=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, named = docs.columns.index(text), docs.columns.index(lang)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            fine = _lettered(texts)
            if model.langs:
                bits = model.lengths(texts)
                size = np.array([len(_prepared(t)) - ORDER for t in texts])
                fine &= bits.min(1) <= most_bits * size + SLACK_BITS if len(texts) else fine
                if pa.types.is_string(batch.column(named).type):
                    best = pa.array([model.langs[k] for k in bits.argmin(1).tolist()], pa.string())
                    batch = batch.set_column(named, batch.schema.field(named), pc.coalesce(batch.column(named), best))
            yield batch.filter(pa.array(fine))

    return docs.mapInArrow(run, docs.schema)
