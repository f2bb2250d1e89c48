"""A training corpus from raw documents: identify, deduplicate, join near copies, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` applies them to the table
``documents``, each stage's result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm.common import dropped, scratch, table, written
from statloom.llm.exact_dedup import keep_first
from statloom.llm.jaccard_join import keep_one
from statloom.llm.language_id import keep_identified
from statloom.llm.mixing import repeat_mixed
from statloom.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without any letter go, and those that no learned language explains."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the similarity of their five-word shingles, the one with the smallest id."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return repeat_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences."""
    return pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Language models and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as keep:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
        dropped(before)
    return docs
