"""A corpus pipeline over ``documents``: quality, near duplicates, personal data, mixing and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import stored, table
from millrace.llm.mixing import mixed_documents
from millrace.llm.neardup import near_duplicates, without
from millrace.llm.packing import pack
from millrace.llm.privacy import redact
from millrace.llm.quality import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines."""
    return keep_clean(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    gone = stored(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return without(docs, gone)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("privacy", privacy), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the tokenizer or the trees; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
