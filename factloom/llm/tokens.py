"""op6: token counts. op8: encoding and decoding with digests."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import BacktrackingBpe, WholeTokenCounter, encoder, prove
from .common import read, row_slices

VOCABULARY = "byte_bpe_50k.json"


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty; a null doc_id and repeated rows are kept; an empty table gives no rows; other columns
    are not read, whatever their names.
    """

    proof = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        counter = encoder(WholeTokenCounter, path, proof.value)
        for b in (part for whole in batches for part in row_slices(whole, 1, 1024)):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, ids array<int>, decoded string.

    A null text is empty and has no ids; a null doc_id and repeated rows are kept; an empty table gives no rows; other
    columns are not read, whatever their names.
    """

    proof = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        bpe = encoder(BacktrackingBpe, path, proof.value)
        for b in (part for whole in batches for part in row_slices(whole, 1, 1024)):
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x).decode() for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_documents with digests in place of ids and text, made where the ids are so that neither leaves the worker."""

    proof = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        bpe = encoder(BacktrackingBpe, path, proof.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in (part for whole in batches for part in row_slices(whole, 1, 1024)):
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(bpe.decimal(x)) for x in ids], pa.string()), pa.array([sha(bpe.decode(x)) for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
