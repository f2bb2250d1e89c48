"""Licence scans by a positional rare-token index.

Every template is a sequence of words, some of them in mandatory phrases, and the index holds its anchors: of each mandatory
phrase the words with the highest inverse document frequency over the whole corpus, with their places. A file is looked
up by its places of those words, the rarest ones first: each gives the alignments (its place less the anchor's place in
the template) that it allows, and the lists are intersected, so that a template whose rarest word a file lacks costs one
look-up. What is left is verified: the mandatory phrases must stand at their places, and enough of the other words. As
they must stand there, no alignment that would be verified is lost by intersecting.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The phrases of the base, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings of licence texts, as words; brackets enclose mandatory phrases.
TEMPLATES = {
    "mit": "[permission is hereby granted free of charge] to any person obtaining a copy of this software and [associated documentation files]",
    "apache": "[licensed under the apache license] version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "[under the terms of the gnu general public license] as published by the free software foundation",
    "lgpl": "[gnu lesser general public license]",
    "agpl": "[gnu affero general public license]",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
    "mpl": "subject to the terms of the [mozilla public license]",
    "isc": "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted",
    "cc": "[creative commons attribution]",
    "unlicense": "this is [free and unencumbered software released into the public domain]",
    "boost": "permission is hereby granted free of charge to [any person or organization obtaining a copy of the software] and accompanying documentation",
    "zlib": "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages",
    "epl": "this program and the accompanying materials are made available under the terms of the [eclipse public license]",
    "cddl": "subject to the terms of the [common development and distribution license]",
    "eupl": "licensed under the [european union public licence]",
    "ofl": "this font software is licensed under the [sil open font license]",
    "psf": "[python software foundation license]",
    "cc0": "[cc0 1 0 universal]",
}
#: Anchors of a mandatory phrase, and the share of a template's words that must stand in their places.
ANCHORS, LEAST = 2, 0.6
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def _parse(template: str) -> tuple[list[bytes], list[range]]:
    out, must, start = [], [], 0
    for w in template.split():
        start = len(out) if w[0] == "[" else start
        out.append(w.strip("[]").encode())
        must += [range(start, len(out))] * (w[-1] == "]")
    return out, must


class Index:
    """Anchors of all templates; document frequencies say which words are rare."""

    def __init__(self, frequency: dict[bytes, int], documents: int):
        self.templates = [(label, True, *_parse(f"[{p}]")) for p, label in PHRASES.items()] + [(label, False, *_parse(t)) for label, t in TEMPLATES.items()]
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for t in self.templates for w in t[2]}
        #: Of each template, its anchors as (word, place), the rarest first.
        self.anchors: list[list[tuple[bytes, int]]] = []
        for _, _, own, must in self.templates:
            rank = lambda j, own=own: (-self.idf[own[j]], own[j], j)
            self.anchors.append([(own[j], j) for j in sorted({j for m in must for j in sorted(m, key=rank)[:ANCHORS]}, key=rank)])
        self.vocabulary = frozenset(w for a in self.anchors for w, _ in a)

    def _aligned(self, k: int, places: dict[bytes, list[int]]) -> set[int]:
        """Where a template may start: alignments that all its anchors allow."""
        found: set[int] | None = None
        for w, j in self.anchors[k]:
            if w not in places:
                return set()
            own = {i - j for i in places[w]}
            found = own if found is None else found & own
            if not found:
                break
        return found or set()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places and labels of the base phrases, in order; labels with the best share of a template's words."""
        if self.vocabulary.isdisjoint(words):
            return [], {}
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        base, found = [], {}
        for k, (label, phrase, own, must) in enumerate(self.templates):
            for at in self._aligned(k, places):
                if any(at + m.start < 0 or words[at + m.start : at + m.stop] != own[m.start : m.stop] for m in must):
                    continue
                share = sum(0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(own)) / len(own)
                if phrase:
                    base.append((at, label))
                if share >= LEAST:
                    found[label] = max(found.get(label, 0.0), share)
        return sorted(base), found


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def build(docs: DataFrame, text: str = "text") -> Index:
    """The index, with frequencies counted over all of ``docs``; the driver gets one number for each template word."""
    vocabulary = frozenset(w for t in [*PHRASES, *TEMPLATES.values()] for w in _parse(t)[0])
    counted = docs.select(docs[text].cast("string").alias("text")).mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Index({bytes(r["word"]): r["n"] for r in counted.collect()}, docs.count())


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text is empty; without base phrases first_word and last_word are null; the score is the largest share of a
    template's words that stand in their places, 1 for a base phrase, 0 without labels. Null ids and repeated rows keep
    their rows; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index or build(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(t)
                base, found = shared.value.scan(own)
                out.append((doc_id, len(own), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(found)), max(found.values(), default=0.0)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
