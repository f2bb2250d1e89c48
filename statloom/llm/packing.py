"""Packing tokenised documents into sequences by first-fit decreasing over a tournament tree of bin capacities.

A document's ids are cut into pieces of ``size``, the last one shorter. Pieces are dealt into groups by a hash of what
they are (so that no document, however long, and no repeated row fills a group), and each group is packed on its own:
longest first, each into the first bin that has room, found by walking a tournament tree whose nodes hold the largest
capacity below them.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, trimmed, written

SIZE, END_ID, GROUP_PIECES = 2048, 1, 8192
#: Chunks that aren't plain, and parts of others, that a process remembers, and bytes of the longest one.
CHUNKS, PARTS, CACHE_BYTES = 100_000, 500_000, 64
#: Stands for the apostrophe of an ending, so that it isn't taken for a sign. No plain text holds it.
SHORT = "\x01"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next one
    from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def _rules() -> tuple[re.Pattern, ...]:
    """Patterns of: a character that no plain text holds; a white-space-separated chunk with such a one; in lower-cased plain
    text an ending after an apostrophe, a number, a run of signs. They begin with one set of characters if they can,
    which is what ``re`` finds fast."""
    import regex

    white, plain = r"\t-\r\x20", r"\x21-\x7E\u00A1-\u024F"
    lower = sorted({c for k in (*range(0x21, 0x7F), *range(0xA1, 0x250)) for c in chr(k).lower()})
    number = "".join(c for c in lower if regex.match(r"\p{N}", c))
    sign = re.escape("".join(c for c in lower if regex.match(r"[^\s\p{L}\p{N}]", c)))
    return (
        re.compile(rf"[^{white}{plain}]"),
        re.compile(rf"(?<![^{white}])([{plain}]*+[^{white}{plain}][^{white}]*+)"),
        re.compile(rf"(?<![{sign}])'(s|t|re|ve|m|ll|d)"),
        re.compile(rf"[{number}]"),
        re.compile(rf"[{sign}][{sign}]*"),
    )


class Memory(dict):
    """Ids of strings by a function, which is asked for those that aren't known.

    Half of ``most`` are here; when these are full they become the older half, whose strings come back when they are met
    again, so frequent ones stay and rare ones go. Long ones aren't remembered.
    """

    def __init__(self, ask: Callable[[str], bytes], most: int):
        super().__init__()
        self.ask, self.most, self.older = ask, max(1, most // 2), {}

    def __missing__(self, string: str) -> bytes:
        found = self.older.get(string)
        if found is None:
            found = self.ask(string)
            if len(string.encode()) > CACHE_BYTES:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[string] = found
        return found


class Encoder:
    """Ids of a text by a public tokenizer, with a memory of the parts that its rules split texts into.

    The tokenizer drops white space and no rule of it looks across ASCII white space, so a text's ids are those of its
    white-space-separated chunks in a row. Texts of Latin letters, digits and signs are lower-cased here and get spaces
    around what the tokenizer's own rules split off: endings after an apostrophe, numbers, runs of signs. Its model is
    asked for each part. Chunks with other characters, which have a memory of their own, and texts that may hold a special
    token's string go through the whole tokenizer.
    """

    def __init__(self, path: str, most_chunks: int = CHUNKS, most_parts: int = PARTS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.characters = self.whole.model, _byte_characters()
        self.chunks, self.parts = Memory(self._whole, most_chunks), Memory(self._part, most_parts)
        self.odd, self.odd_chunk, self.ending, self.number, self.signs = _rules()

    def _whole(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        text = "'" + part[1:] if part[0] == SHORT else part
        if not text.isascii():
            text = "".join([self.characters[b] for b in text.encode()])
        return _packed([t.id for t in self.model.tokenize(text)])

    def _plain(self, text: str) -> bytes:
        text = text.lower()
        if "'" in text:
            text = self.ending.sub(rf" {SHORT}\1 ", text)
        text = self.signs.sub(r" \g<0> ", self.number.sub(r" \g<0> ", text))
        return b"".join(map(self.parts.__getitem__, text.split()))

    def __call__(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            return self._whole(text)
        if not self.odd.search(text):
            return self._plain(text)
        pieces = self.odd_chunk.split(text)  # plain, odd, plain, ...; a plain one of one character is white space
        pieces[1::2] = map(self.chunks.__getitem__, pieces[1::2])
        pieces[::2] = [self._plain(t) if len(t) > 1 else b"" for t in pieces[::2]]
        return b"".join(pieces)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder, with what it remembers from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, size: int, end_id: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, width = encoder(path), 4 * size
        end = _packed([end_id])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for a in range(0, len(ids), width):
                    part = ids[a : a + width]
                    out.append((doc_id, a // 4, len(part) // 4, crc32(part), len(ids) // 4))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Bins:
    """First bin with room, by a tournament tree over the bins' capacities."""

    def __init__(self, size: int, most: int):
        self.leaves = 1
        while self.leaves < max(most, 1):
            self.leaves *= 2
        self.tree = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < length:
                at += 1
        tree[at] -= length
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return found


def _pack(size: int):
    @trimmed
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "uid"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, used, which, offset = Bins(size, len(group)), {}, [], []
        for n in group["length"].tolist():
            b = bins.place(n)
            which.append(b)
            offset.append(used.get(b, 0))
            used[b] = offset[-1] + n
        group["sequence_id"] = group["group"] * (1 << 24) + np.array(which, np.int64)
        group["offset"] = offset
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Null ids stay null. Repeated rows are packed as often as they stand. An
    empty table gives an empty result. Groups have about ``group_pieces`` pieces, at any size of the corpus.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    cut = rows.mapInArrow(_pieces(tokenizer or tokenizer_path(), size, end_id), PIECE_SCHEMA)
    cut = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "uid"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_pack(size), PIECE_SCHEMA + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
