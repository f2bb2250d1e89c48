"""Output files from many tasks: each task encodes its rows into a part file. The driver joins the parts to one file, or
each task makes a whole file of its own part.

The parts lie beside the output, so tasks and driver must share its folder (as they must to read it back).
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.files import split_uri


#: Bytes of a batch that are encoded at once, about.
ENCODED_BYTES = 8 << 20


class Encoded:
    """Part files in a folder: (part, name, rows) of each."""

    def __init__(self, folder: str, found: list[tuple[int, str, int]]):
        self.folder, self.found = folder, found

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.found)

    def into(self, out, more: bool = False) -> int:
        """Append all parts to a file; how many bytes."""
        start = out.tell()
        for _, name, _ in self.found:
            with open(os.path.join(self.folder, name + (".more" if more else "")), "rb") as f:
                shutil.copyfileobj(f, out, 8 << 20)
        return out.tell() - start


class Parts(Encoded):
    """Encoded rows of a DataFrame, in its order. ``encode(batch, state)`` returns the bytes of a batch's rows and of
    what goes elsewhere in the file; ``state`` is a dict of the task, with ``part``. With ``finish``, each task that has
    rows, and the first one, makes a file of the folder ``path``."""

    def __init__(self, df: DataFrame, path: str, encode: Callable[[pa.RecordBatch, dict], tuple[bytes, bytes]], finish=None, suffix: str = ""):
        store, at = split_uri(path)
        if store:
            raise ValueError(f"{path}: files are written to folders that all machines mount, not to object stores")
        self.path = at
        self.folder = folder = os.path.join(os.path.dirname(os.path.abspath(at)), f".{os.path.basename(at)}-{uuid.uuid4().hex[:10]}")
        if finish:
            os.makedirs(at, exist_ok=True)
            if os.listdir(at):
                raise FileExistsError(f"the folder {path} isn't empty")
        os.makedirs(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            t, n = TaskContext.get(), 0
            state = {"part": t.partitionId()}
            name = f"{t.partitionId()}-{t.taskAttemptId()}"
            with open(os.path.join(folder, name), "wb") as rows, open(os.path.join(folder, name + ".more"), "wb") as more:
                for whole in batches:
                    step = max(1, whole.num_rows * ENCODED_BYTES // max(ENCODED_BYTES, whole.nbytes))
                    for k in range(0, whole.num_rows, step):
                        b = whole.slice(k, step)
                        x, y = encode(b, state)
                        rows.write(x), more.write(y)
                        n += b.num_rows
            if finish and (n or t.partitionId() == 0):
                whole = os.path.join(folder, name + ".whole")
                with open(whole, "wb") as out:
                    finish(Encoded(folder, [(t.partitionId(), name, n)]), out)
                os.replace(whole, os.path.join(at, f"part-{t.partitionId():06d}.{suffix}"))
                os.remove(os.path.join(folder, name)), os.remove(os.path.join(folder, name + ".more"))
            yield pa.RecordBatch.from_arrays([pa.array([t.partitionId()], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], ["part", "name", "n"])

        try:
            self.found = sorted(tuple(r) for r in df.mapInArrow(run, "part int, name string, n long").collect())
        except BaseException:
            self.close()
            if finish:
                shutil.rmtree(at, ignore_errors=True)
            raise

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def save(df: DataFrame, path: str, encode, finish: Callable[[Encoded, object], None], each: str | None = None) -> None:
    """Write ``df`` to the file ``path``, or, where ``each`` names an extension, each partition to a file of the folder
    ``path``. ``finish(parts, out)`` writes a whole file around the rows of ``parts``."""
    with Parts(df, path, encode, finish if each else None, each or "") as parts:
        if not each:
            with open(parts.path, "wb") as out:
                finish(parts, out)
