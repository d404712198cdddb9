"""From raw documents to packed training sequences.

Language, quality, near duplicates and benchmark passages each remove documents; packing then
places what is left. Every stage reads what the one before it wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import decontaminate, language, ngram_join, packing, quality
from panelcast.llm.common import prepare, save
from panelcast.sources.tables import scan


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows (operator 6)."""
    prepare(spark)
    return language.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep (operator 2)."""
    prepare(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group (operator 8)."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark (operator 7)."""
    prepare(spark)
    return decontaminate.keep_clean(docs, scan(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences (operator 4)."""
    prepare(spark)
    return packing.pack_documents(docs)[1]


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Language scores and vote estimates are numeric models; SQL can't express their stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = scan(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = save(docs, "snappy")
    return docs
