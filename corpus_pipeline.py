"""Corpus pipeline: recognised languages, one of each group of near duplicates, personal
data replaced, packed sequences.

Each stage gets the documents its predecessor kept and, but for the last, returns rows
with the columns of documents.  Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evgraph.llm import jaccard, language, packing, surrogates
from evgraph.llm.common import stored, table

#: Session setting with the secret of the replacements, and its value where it is unset.
KEY_SETTING, KEY = "evgraph.pii.key", "corpus pipeline"


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; rejected documents go."""
    return language.keep_recognised(docs, language.learned_on(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8; the smallest id of each group stays."""
    return jaccard.keep_first(docs, width=5, percent=80)


def hide(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates."""
    return surrogates.replace_personal_data(docs, spark.conf.get(KEY_SETTING, KEY)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as found."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", recognise),
    ("jaccard_join", distinct),
    ("surrogates", hide),
    ("packing", pack),
]

#: No stage after the first can be written in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
