"""The corpus pipeline: documents without toxic and poor ones and without near
duplicates, with pseudonyms for personal data, packed into bins.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import packing, pseudonyms, queries, ruleset, simjoin, toxicity
from lodestone.llm.tables import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10 does not reject."""
    return toxicity.without_toxic(docs, toxicity.train_toxicity(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 8 does not reject."""
    return ruleset.good_documents(docs, ruleset.train_quality(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of operator 2."""
    return simjoin.one_of_each_class(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the pseudonyms of operator 4."""
    return pseudonyms.pseudonymized(docs, queries.PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of operator 3."""
    return packing.best_fit_pack(docs, queries.BIN_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_copies),
    ("personal data", hide_personal_data),
    ("packing", pack),
]
#: Training and chosen-path buckets are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is a table in the shared folder
    before the next one reads it, so a lost executor costs tasks of one stage only.  A table
    is removed when the next one is written; the last one is what the result reads."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.clear(keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
