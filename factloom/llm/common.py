"""Tables, shared storage and the byte kernels that the operators of this package have in common."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in slices of about this many bytes, so that a worker's memory does not follow the Arrow batch.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may lack it, as in tests; it then gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of staged tables, a list for each scratch() that is open.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that stage() writes within are removed at the end; those that keep() writes last until the scope around it ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def stage(df: DataFrame, name: str, scope: int = -1) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}/{name}"
    if len(_scopes) >= -scope:
        _scopes[scope].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def keep(df: DataFrame, name: str) -> DataFrame:
    """stage() for what is read after the innermost scratch() has ended."""
    return stage(df, name, -2)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stage(df: DataFrame) -> None:
    """Removes a table written by stage() that no later plan reads."""
    for scope in _scopes:
        if df._factloom_path in scope:
            scope.remove(df._factloom_path)
    _remove(df.sparkSession, df._factloom_path)


def few(df: DataFrame, limit: int) -> DataFrame:
    """df, broadcast if a count shows that it has `limit` rows at most."""
    return F.broadcast(df) if df.count() <= limit else df


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; x (uint64) is not changed."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b & _M64, np.uint64)])) for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, bytes as uint8, offsets from 0) for runs of rows; null texts are empty, each text is whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def row_slices(batch: pa.RecordBatch, text: int, rows: int = 256, limit: int = SLICE_BYTES):
    """Slices of a batch with `rows` rows at most, and with `limit` bytes of the text column unless a single text has more."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    lo = 0
    while lo < batch.num_rows:
        done = size[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(size, done + limit, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _FOLD[data]


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true positions that stay within a text: starts, ends, and each text's first run (and the count at the end)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    prev = np.empty(n, dtype=bool)
    prev[0], prev[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~prev | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of [^\\x20\\x09-\\x0D]+."""
    return spans(~_SPACE[data], offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over random byte codes, by prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
