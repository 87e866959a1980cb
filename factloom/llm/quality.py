"""op5: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_case, read, span_hashes, spans, text_slices
from .labels import held_out, new_name, training_rows

#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 8_000
BITS = 14
#: Steps of learning, at least: small samples are gone through more often.
LEAST_STEPS = 600
WORDS = 1 << BITS
BINS = 16
RANK = 8
STATS = ("upper", "digit", "sign", "wide", "line", "word length", "distinct", "repeat", "top", "stop", "chars", "doubled sign")
FEATURES = WORDS + len(STATS) * BINS

_KIND = np.zeros((256, 5), dtype=bool)
_KIND[65:91, 0] = True
_KIND[48:58, 1] = True
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True
_KIND[128:, 3] = True
_KIND[10, 4] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of each text (index, value, each text's first entry) and its statistics (one row a text)."""
    n_docs, size = len(offs) - 1, np.maximum(np.diff(offs), 1).astype(float)
    starts, ends, first = spans(_LETTER[data], offs)
    h = span_hashes(fold_case(data), starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    stats = np.zeros((n_docs, len(STATS)))
    for k in range(5):
        stats[:, k] = np.diff(np.concatenate([[0], np.cumsum(_KIND[data, k])])[offs]) / size
    per = np.maximum(count, 1)
    stats[:, 5] = np.bincount(doc, ends - starts, n_docs) / per
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stats[:, 7] = np.bincount(doc, same, n_docs) / per
    stats[:, 9] = np.bincount(doc, (ends - starts) <= 3, n_docs) / per
    stats[:, 10] = np.log1p(np.diff(offs))
    double = np.zeros(len(data), dtype=bool)
    double[1:] = _KIND[data[1:], 2] & (data[1:] == data[:-1])
    stats[:, 11] = np.diff(np.concatenate([[0], np.cumsum(double)])[offs]) / size
    key, times = np.unique(doc.astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS), return_counts=True)
    of = (key >> np.uint64(BITS)).astype(np.int64)
    at = np.searchsorted(of, np.arange(n_docs + 1))
    stats[:, 6] = np.diff(at) / per
    top = np.zeros(n_docs)
    np.maximum.at(top, of, times)
    stats[:, 8] = top / per
    x = np.log1p(times)
    x /= np.sqrt(np.maximum(np.bincount(of, x * x, n_docs), 1e-9))[of]
    return (key & np.uint64(WORDS - 1)).astype(np.int64), x, at, stats


def _with_bins(idx, x, at, stats, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds each text's binned statistics to its words."""
    n, k = stats.shape
    bins = np.stack([np.searchsorted(edges[s], stats[:, s], side="left") for s in range(k)], axis=1) if n else np.zeros((0, k), np.int64)
    where = np.repeat(at[1:], k)
    idx = np.insert(idx, where, (WORDS + np.arange(k) * BINS + bins).ravel())
    return idx, np.insert(x, where, 1.0), at + np.arange(n + 1) * k


def raw_scores(m: Machine, idx, x, at) -> tuple[np.ndarray, np.ndarray]:
    """Linear part plus half of (square of sums minus sum of squares) of the factors; also the sums, for learning."""
    if len(at) < 2:
        return np.zeros(0), np.zeros((0, RANK))
    vx = m.factors[idx] * x[:, None]
    sums = np.add.reduceat(vx, at[:-1], axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), at[:-1])
    return m.bias + np.add.reduceat(m.linear[idx] * x, at[:-1]) + ((sums * sums).sum(axis=1) - squares) / 2, sums


def fit(idx, x, at, stats, y: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.1, shrink: float = 2e-5) -> Machine:
    """AdaGrad on the logistic loss, in an order fixed by a seed; with no rows or one class only the prior is learned."""
    edges = np.array([np.quantile(stats[:, s], np.arange(1, BINS) / BINS) if len(y) else np.zeros(BINS - 1) for s in range(len(STATS))])
    rng = np.random.default_rng(5)
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m = Machine(float(prior), np.zeros(FEATURES), rng.normal(0, 0.01, (FEATURES, RANK)), edges)
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    idx, x, at = _with_bins(idx, x, at, stats, edges)
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(y)))
    g1, g2, g0 = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            size = at[rows + 1] - at[rows]
            begin = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(at[rows] - begin[:-1], size) + np.arange(begin[-1])
            i, v, doc = idx[take], x[take], np.repeat(np.arange(len(rows)), size)
            z, sums = raw_scores(m, i, v, begin)
            err = 1 / (1 + np.exp(-z)) - y[rows]
            g = (err[doc] * v)[:, None]
            used, inv = np.unique(i, return_inverse=True)
            d1 = np.bincount(inv, g[:, 0], len(used)) / len(rows) + shrink * m.linear[used]
            each = g * (sums[doc] - m.factors[i] * v[:, None])
            d2 = np.stack([np.bincount(inv, each[:, f], len(used)) for f in range(RANK)], axis=1) / len(rows) + shrink * m.factors[used]
            g1[used] += d1 * d1
            g2[used] += d2 * d2
            g0 += err.mean() ** 2
            m.linear[used] -= rate * d1 / np.sqrt(g1[used])
            m.factors[used] -= rate * d2 / np.sqrt(g2[used])
            m.bias -= rate * err.mean() / np.sqrt(g0)
    return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits the machine on at most `sample` labelled documents outside the held-out fold; see training_rows() for repeated ids. Without any, the score is the prior."""
    kind = "doc_id long, label int, idx array<int>, x array<float>, stats array<double>"

    def run(batches):
        for b in batches:
            for lo, data, offs in text_slices(b.column("text")):
                idx, x, at, stats = features(data, offs)
                n = len(stats)
                cut = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), b.column("label").slice(lo, n), pa.ListArray.from_arrays(cut, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(x, pa.float32())), pa.array(list(stats), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "idx", "x", "stats"],
                )

    got = training_rows(docs, labels, "quality", sample).mapInArrow(run, kind).toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    flat = lambda c, t: np.asarray(pc_flat(got.column(c)), t)
    at = np.concatenate([[0], np.cumsum([len(v) for v in got.column("idx")])]).astype(np.int64)
    return fit(flat("idx", np.int64), flat("x", float), at, flat("stats", float).reshape(-1, len(STATS)), got.column("label").to_numpy().astype(float))


def pc_flat(column: pa.ChunkedArray) -> np.ndarray:
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(chunks) if chunks else np.zeros(0)


def with_score(docs: DataFrame, machine: Machine, column: str) -> DataFrame:
    """docs with the score in a column that it does not have. A null text is scored as an empty one."""
    text, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            for lo, data, offs in text_slices(b.column(text)):
                idx, x, at = _with_bins(*features(data, offs), machine.edges)
                z, _ = raw_scores(machine, idx, x, at)
                part = b.slice(lo, len(offs) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def score_quality(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: its columns, then score (0 to 1) and predicted; columns of docs by these names are replaced.

    Every row is scored by its own whole text, repeated rows and null ids included; a null text counts as empty; equal
    texts have equal scores; an empty table gives no rows.
    """
    scored = with_score(docs.drop("score", "predicted"), machine, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with their own columns only, that the score does not reject."""
    column = new_name(docs)
    return with_score(docs, machine, column).where(F.col(column) >= threshold).select(docs.columns)


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
