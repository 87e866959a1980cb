"""op10: packing of token sequences by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordBpe, encoder
from .common import keep, read, row_slices, scratch, stage

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
#: Pieces that one packing task gets on average; the number of tasks follows the input.
PIECES_A_BUCKET = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the least capacity that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = [0] * (2 * self.size)
        self.at = [[] for _ in range(window + 1)]

    def put(self, capacity: int, what: int) -> None:
        self.at[capacity].append(what)
        k = capacity + self.size
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open window that is need or more; -1 if there is none."""
        k = need + self.size
        while not self.some[k]:
            while k & 1:
                k >>= 1
            if k == 0:
                return -1
            k += 1
            if k & (k - 1) == 0:
                return -1
        while k < self.size:
            k *= 2
            if not self.some[k]:
                k += 1
        return k - self.size

    def take(self, capacity: int) -> int:
        out = self.at[capacity].pop()
        if not self.at[capacity]:
            k = capacity + self.size
            self.some[k] = 0
            k >>= 1
            while k and not (self.some[2 * k] or self.some[2 * k + 1]):
                self.some[k] = 0
                k >>= 1
        return out


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each length (all are 1 to window)."""
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    heap, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity = heap.tightest(need)
        if capacity < 0:
            capacity, which = window, n
            n += 1
        else:
            which = heap.take(capacity)
        seq[i], off[i] = which, window - capacity
        if capacity > need:
            heap.put(capacity - need, which)
    return seq, off


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenises whole texts and cuts overlong documents into full windows and a rest, as PIECES and `copy`.

    Null texts are empty: the end id alone. Rows with a null doc_id and repeated rows are documents like others; copy
    numbers equal pieces of a task, so that they can be told apart. Other columns are not read, whatever their names.
    """
    last = np.array([end_id], dtype="<u4").tobytes()

    def all_ids(bpe: WordBpe, texts: pa.Array):
        for part in row_slices(pa.record_batch([texts], names=["text"]), 0):
            yield from bpe.ids([t or "" for t in part.column(0).to_pylist()])

    def run(batches):
        bpe, copies = encoder(WordBpe, path), Counter()
        for b in batches:
            cols: list[list[int | None]] = [[] for _ in _NAMES]
            for doc, ids in zip(b.column(0).to_pylist(), all_ids(bpe, b.column(1)), strict=True):
                ids += last
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    crc = zlib.crc32(part)
                    for col, v in zip(cols, (doc, at, len(part) // 4, crc, n, copies[doc, at, crc]), strict=True):
                        col.append(v)
                    copies[doc, at, crc] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECES}, copy long")


def pack(pieces: DataFrame, window: int = WINDOW, pieces_a_bucket: int = PIECES_A_BUCKET) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to window tokens, as token_pieces() gives them.

    Pieces are dealt by a hash of (doc_id, start, checksum, copy) to buckets of bounded size, copies of a document too,
    and each bucket is packed by itself: longest first, of equal lengths by doc_id (nulls last), start and checksum. A bucket's
    few last windows are all that stays open, and sequence ids interleave the buckets so that none is used twice. An
    empty table gives an empty result.
    """
    n = pieces.count()
    buckets = max(1, -(-n // pieces_a_bucket))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("length", "doc_id", "start", "ids_crc32")])
        seq, off = best_fit_decreasing(t.column("length").to_numpy(), window)
        bucket = t.column("bucket")[0].as_py()
        return t.drop_columns(["bucket", "copy"]).append_column("sequence_id", pa.array(seq * buckets + bucket)).append_column("offset", pa.array(off))

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs to packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(stage(token_pieces(docs, path or public_tokenizers.path(VOCABULARY)), "pieces"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return keep(pack_documents(read(spark, sf_dir, "documents")), "packed")
