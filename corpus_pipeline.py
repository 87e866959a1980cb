"""Documents to packed training sequences: quality, toxicity, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import quality as fm
from factloom.llm import toxicity as lexicon
from factloom.llm.common import drop_stage, keep, read, scratch
from factloom.llm.neardup import without_near_duplicates
from factloom.llm.packing import pack_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op5) accepts; it learns from labelled rows among them outside the held-out fold."""
    return fm.accepted(docs, fm.learn(docs, read(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon (op7) does not reject."""
    return lexicon.accepted(docs, lexicon.learn(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (op3: five words, a similarity of 0.8 or more), the smallest doc_id's; see without_near_duplicates()."""
    return without_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that were kept (op10)."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express the stages (models, sketches, tokenizers); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each one's table is removed once the next is written."""
    docs, written = read(spark, sf_dir, "documents"), False
    for name, step in STAGES:
        with scratch(spark):
            after = keep(step(spark, docs, sf_dir), name)
        if written:
            drop_stage(docs)
        docs, written = after, True
    return docs
