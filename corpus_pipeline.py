"""Training corpus out of ``documents``: classify, deduplicate, decontaminate, mix, shard.

Every stage takes whole texts of any length, keeps all columns of its rows (the
last one apart), whatever their names, and gives no rows for an empty table. Null
texts count as empty ones, null ids as ids of their own that come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import copies, decontaminate, mix, quality, shard
from kindred.llm.common import table
from kindred.session import cut, ship_package


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score below 0.5); it learns from ``labels``.

    Null and empty texts are scored like others (by the classifier's bias); a score
    of exactly 0.5 stays; repeated rows share one verdict. Without a label to
    learn from every document scores 0.5 and stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("score >= 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies (5-word Jaccard 0.8 or more), that of the least doc_id.

    Candidates come from operator 8 (SimHash within 3 bits) and from MinHash bands; all are verified.
    Null and empty texts are equal to each other: one of them stays. Of repeated
    rows one stays; ties of doc_id go by the text.
    """
    ship_package(spark)
    return copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``.

    Null and empty texts and items hold and match nothing; repeated rows share one
    verdict; without items all documents stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until the sources have their target shares.

    Documents without words have size 0 and nothing to take; a null source is a
    source, the last. Every copy is a row equal to its document.
    """
    return mix.emit(mix.mix(docs))


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, copies included; doc_id, size and checksum name the text.

    Repeated rows get slots of their own; a null or empty text has size 1 and checksum 0.
    """
    return shard.assign(docs)


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("shard", shard_rows),
]

#: Neither the classifier nor the near copies have a form in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
