"""Documents bundled into rows of a few megabytes, so that what a bundle asks of the corpus and what comes back are a
few compact rows instead of one row a shingle or window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

BUNDLE_BYTES = 4 << 20
SCHEMA = "bundle long, ids array<long>, texts array<string>"


def bundled(docs: DataFrame, id_col: str, text: str, size: int = BUNDLE_BYTES, batch: int = 0) -> DataFrame:
    """Rows (bundle, ids, texts) of about ``size`` bytes of text; a longer text is a bundle of its own. Bundle numbers
    hold only for one evaluation, so the result must be written before it is used twice; those of different batches differ."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids: list = []
        texts: list = []
        held, number = 0, batch << 47 | TaskContext.get().partitionId() << 23

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], ["bundle", "ids", "texts"])

        for some in batches:
            for i, t in zip(some.column(0), some.column(1), strict=True):
                t = t.as_py() or ""
                if ids and held + len(t) > size:
                    yield flush()
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(i.as_py()), texts.append(t)
                held += len(t)
        if ids:
            yield flush()

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def ranges(h: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of the ranges of leading bits that sorted hashes ``h`` have; only those."""
    if not len(h):
        return []
    r = h >> np.uint64(shift)
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return list(zip(r[start].tolist(), start.tolist(), [*start[1:].tolist(), len(h)], strict=True))


def range_bits(docs: DataFrame, text: str, per_range: int) -> int:
    """So many leading bits of a hash that a range of hashes has about ``per_range`` words of the corpus."""
    size = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    return max(4, int(size // 6 // per_range).bit_length())
