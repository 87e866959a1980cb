"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 5, is 0 (a null doc_id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled documents, those with the least hash of doc_id; never held-out ones.

    One row a doc_id, so that `limit` bounds both what is broadcast and what is learned from: of rows that repeat an id
    the least text counts. Ids whose labels contradict each other, null labels, null ids and labels without a document
    are left out.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(~held_out() & F.col("label").isin(0, 1))
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def new_name(df: DataFrame, stem: str = "score") -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
