"""From raw documents to packed training sequences, one stage after the other.

Each stage gets the documents that its predecessor kept, as a written table, and
returns documents with the same columns; the last one returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import langid, near_copies, packing, quality_rules
from kerbline.llm.queries import word_vocabulary
from kerbline.llm.texts import table
from kerbline.operators.stage import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels of these documents teach."""
    return langid.keep(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    return quality_rules.keep(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles that are 0.8 alike or more; fingerprints only name candidates."""
    return near_copies.keep_one(docs, prints=8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    return packing.pack(docs, word_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", known_language),
    ("quality rules", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("best-fit packing", packed),
]
#: Language profiles, fingerprints and tokens cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
STATEMENTS: dict[str, str] = {}
