"""Text quality by a naive Bayes support vector machine.

Features are indicators of hashed n-grams: byte trigrams and words of a text, and four-grams of whether words repeat the
word one to four places before. Each is scaled by the log ratio of its
smoothed counts in the two classes, rows are scaled to length 1, and a linear hinge-loss model is fitted to them by dual
coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import held_out
from .textvec import PIECE, SPACE, words

BITS = 20
#: Labelled rows that the model is fitted to, taken by a hash of the id; all where there are fewer.
TRAIN_DOCS = 8000
EPOCHS, COST = 12, 1.0


#: Words are compared with those so many places before, at most.
NEAR = 4
SIZE = (2 << BITS) + 16 * NEAR


def _repeats(h: np.ndarray) -> list[np.ndarray]:
    """Four-grams of repetition: for each distance, which patterns four words in a row make by equalling earlier ones."""
    out = []
    for d in range(1, NEAR + 1):
        if len(h) >= d + 4:
            r = (h[d:] == h[:-d]).astype(np.uint32)
            out.append(np.unique(r[:-3] * 8 + r[1:-2] * 4 + r[2:-1] * 2 + r[3:]) + np.uint32((2 << BITS) + 16 * (d - 1)))
    return out


def features(text: bytes) -> np.ndarray:
    """Distinct features of a text: the first 2**BITS numbers are trigrams, the next are words, the last repetitions."""
    found = []
    for a in range(0, max(len(text), 1), PIECE):
        b = np.frombuffer(text[a : a + PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            found.append(np.unique((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)))
    _, (h,) = words([text], SPACE)
    found.append(np.unique((h >> np.uint64(64 - BITS)).astype(np.uint32)) + np.uint32(1 << BITS))
    found += _repeats(h)
    return np.unique(np.concatenate(found)) if len(text) > PIECE else np.concatenate(found)


class Model:
    """Weights of all features, already times their log-count ratios; a constant where one class is missing."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 7):
        size = SIZE
        self.constant, self.ratio, self.weight, self.bias = None, np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0
        good, n = labels > 0, len(labels)
        if n == 0 or good.all() or not good.any():
            self.constant = 0.5 if n == 0 else float(good.all())
            return
        p, q = np.ones(size), np.ones(size)
        for r, g in zip(rows, good, strict=True):
            (p if g else q)[r] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        norm = np.array([np.sqrt((ratio[r] ** 2).sum() + 1e-12) for r in rows])
        y = np.where(good, 1.0, -1.0)
        most = cost * np.where(good, n / (2 * good.sum()), n / (2 * (~good).sum()))
        w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(n), np.random.default_rng(seed)
        for _ in range(epochs):
            moved = 0.0
            for i in rng.permutation(n):
                r, x = rows[i], ratio[rows[i]] / norm[i]
                gradient = y[i] * (w[r] @ x + bias) - 1.0
                new = min(max(alpha[i] - gradient / 2.0, 0.0), most[i])  # each row has length 1, and 1 for the bias
                step = new - alpha[i]
                if step:
                    alpha[i] = new
                    w[r] += step * y[i] * x
                    bias += step * y[i]
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        self.ratio, self.weight, self.bias = ratio.astype(np.float32), (w * ratio).astype(np.float32), bias

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        f = features(text)
        margin = float(self.weight[f].sum(dtype=np.float64) / np.sqrt((self.ratio[f].astype(np.float64) ** 2).sum() + 1e-12)) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(2.0 * margin, -40, 40))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features((t or "").encode()).astype(np.int32) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "f"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit to about ``train_docs`` labelled rows. A document labelled more than once counts by its largest label, and
    as often as it stands in ``docs``; null labels, ids and texts teach nothing; with one class alone the score is
    constant, with none it is 0.5. The driver gets each row's distinct features, at most ``SIZE`` numbers however long
    its text is. Ids compare as they are; other columns aren't read."""
    marks = labels.select(labels[id_col].alias("k"), labels[label].cast("int").alias("label")).dropna().groupBy("k").agg(F.max("label").alias("label"))
    n = marks.count()
    some = marks.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(min(1.0, train_docs / max(n, 1)) * (1 << 30)))
    rows = docs.select(docs[id_col].alias("i"), docs[text].cast("string").alias("t")).dropna()
    found = rows.join(F.broadcast(some), F.col("i") == F.col("k")).select("t", "label").mapInArrow(_featured, "label int, f binary").toArrow()
    return Model([np.frombuffer(x, np.int32) for x in found["f"].to_pylist()], found["label"].to_numpy())


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            score = np.array([model.score((t or "").encode()) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted (1 if the score is 0.5 or more, ties included).

    Null text is empty; an empty text gets the score of a text without features. Texts may be of any length. Null ids stay
    null, repeated rows keep their rows and get equal scores, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(_scored(shared), "doc_id long, score double, predicted int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out(labels["doc_id"], 3, 1)))
    found = score(docs, model)
    return found.select("doc_id", held_out(found["doc_id"], 3, 1).alias("held_out"), "score", "predicted")
