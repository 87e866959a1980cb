"""op4: I-Match fingerprints over randomised subsets of the terms in a band of document frequency."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, few, fold_case, mix64, read, row_slices, scratch, span_hashes, spans, stage, text_slices

#: The band: terms in this share of all documents, at least and at most. The lower bound limits the lexicon to
#: (mean distinct terms of a document) / LEAST_SHARE terms, whatever the number of documents, so it may be broadcast.
LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 5
#: A subset of level b holds a term with a probability of 2**-b; SUBSETS of each level.
LEVELS, SUBSETS = (1, 3, 5, 7, 9), 16
#: Hexadecimal digits of a subset's hash.
DIGITS = 6
#: Terms of the lexicon at most (8 bytes each); the band's lower end rises until they are no more.
TERMS = 4_000_000
#: Bytes of text that a sorted run of documents holds on average, and runs at most (beyond, runs grow); sampled keys a run.
RUN_BYTES, RUNS, SAMPLED = 16 << 20, 100_000, 16
#: Copies of one row from which on they are worked as one.
COPIES = 100
#: Length of an order key: null flag, doc_id and md5 in hexadecimal digits.
KEY = 1 + 16 + 32

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = np.random.default_rng(4).integers(1, 1 << 63, (len(LEVELS) * SUBSETS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = (1 << 4 * DIGITS) - 1


def distinct_terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct terms (runs of ASCII letters, digits and other bytes; A-Z folded), and their texts."""
    starts, ends, first = spans(_LETTER[data], offs)
    h = span_hashes(fold_case(data), starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band, by exact document frequencies over all documents.

    There are at most (mean distinct terms of a document) / least of them, and at most TERMS: where there would be
    more, the rarest go, all of a frequency together.
    """

    def run(batches):
        for b in batches:
            n, parts = 0, []
            for _, data, offs in text_slices(b.column(0)):
                parts.append(distinct_terms(data, offs)[0])
                n += len(offs) - 1
            terms, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, np.uint64(0)).view(np.int64)), pa.array(np.append(times, 0)), pa.array(np.append(np.zeros(len(terms), np.int64), n))], names=["term", "df", "docs"])

    counts = docs.select("text").mapInArrow(run, "term long, df long, docs long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"))
    n = docs.count()
    with scratch(docs.sparkSession):
        band = stage(counts.where((F.col("df") >= max(2.0, n * least)) & (F.col("df") <= max(2.0, n * most))).select("term", "df"), "band")
        if (terms := band.count()) > TERMS:
            step = F.floor(F.log2("df") * 64).alias("step")
            for r in sorted(band.groupBy(step).count().collect()):
                terms -= r["count"]
                if terms <= TERMS:
                    band = band.where(F.floor(F.log2("df") * 64) > r.step)
                    break
        return np.sort(band.select("term").toArrow().column("term").to_numpy().view(np.uint64))


def signatures(texts: pa.Array, band: np.ndarray) -> np.ndarray:
    """Hashes of each text's sorted distinct terms in every subset; 0 for none. Texts without a term in the band use all their terms."""
    out = np.zeros((len(texts), len(_SEEDS)), np.int64)
    for lo, data, offs in text_slices(texts):
        terms, doc = distinct_terms(data, offs)
        n = len(offs) - 1
        keep = np.zeros(len(terms), dtype=bool)
        if len(band):
            keep = band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms
        keep |= (np.bincount(doc, keep, n) == 0)[doc]
        terms, doc = terms[keep], doc[keep]
        first = np.searchsorted(doc, np.arange(n + 1))
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            continue
        for k, (a, b) in enumerate(_SEEDS):
            chosen = mix64(terms * a)
            chosen = np.where(chosen >> np.uint64(64 - LEVELS[k // SUBSETS]) == 0, mix64(terms ^ b), np.uint64(0))
            sums = np.add.reduceat(chosen, first[some])
            out[lo + some, k] = np.where(sums == 0, 0, (mix64(sums) % np.uint64(_MOST)).astype(np.int64) + 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) of rows of signatures: the share of equal hashes among subsets that either uses, at the sparsest
    level of which half the subsets are used (else at the densest). Rows that use no subset are alike if both do not."""
    shape = (len(a), len(LEVELS), SUBSETS)
    used = ((a != 0) | (b != 0)).reshape(shape).sum(axis=2)
    same = ((a == b) & (a != 0)).reshape(shape).sum(axis=2)
    level = np.where(used >= SUBSETS // 2, np.arange(len(LEVELS)), 0).max(axis=1)
    rows = np.arange(len(a))
    return np.where(used.sum(axis=1) == 0, 1.0, np.where(used[rows, level] > 0, same[rows, level] / np.maximum(used[rows, level], 1), (a == b).all(axis=1)))


def _hex(rows: np.ndarray) -> list[str]:
    return ["".join([f"{v:0{DIGITS}x}" for v in r]) for r in rows.tolist()]


def fingerprint(docs: DataFrame, band: np.ndarray) -> DataFrame:
    """Per row of docs: doc_id, n_chars, fingerprint. Equal texts have equal fingerprints; a null text is empty, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(band)

    def run(batches):
        for b in batches:
            for part in row_slices(b, 1):
                texts = part.column(1).fill_null("")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts.to_pylist()], pa.int64()), pa.array(_hex(signatures(texts, shared.value)))], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _key_array(column: pa.Array) -> np.ndarray:
    """Order keys, which are all of KEY ASCII characters, as a numpy array."""
    return np.array(column.to_pylist(), dtype=f"S{KEY}")


def _cut_runs(keys: DataFrame, n: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(runs, bounds, first key of each run that has rows, the run before each): ranges of keys of near equal numbers of rows.

    Bounds are quantiles of a sample that hashes choose, SAMPLED keys a run, so that the driver holds no more than that.
    """
    runs = min(RUNS, max(1, -(-size // RUN_BYTES)))
    bounds = np.zeros(0, dtype=f"S{KEY}")
    if runs > 1:
        some = keys.where(F.pmod(F.xxhash64("key", F.lit(4)), F.lit(max(1, n // (runs * SAMPLED)))) == 0).select("key").distinct().toArrow()
        some = np.sort(_key_array(some.column("key")))
        bounds = np.unique(some[np.linspace(0, len(some), runs + 1).astype(int)[1:-1]]) if len(some) else bounds

    def firsts(batches):
        for b in batches:
            own = np.sort(_key_array(b.column(0)))
            run, at = np.unique(np.searchsorted(bounds, own, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array([k.decode() for k in own[at]], pa.string())], names=["run", "key"])

    rows = keys.select("key").mapInArrow(firsts, "run int, key string").groupBy("run").agg(F.min("key").alias("key")).collect()
    rows.sort(key=lambda r: r.run)
    return len(bounds) + 1, bounds, np.array([r.key for r in rows], dtype=f"S{KEY}"), np.roll([r.run for r in rows], 1)


def edited_likeness(docs: DataFrame, band: np.ndarray) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next document's,
    in the order of doc_id (nulls first, equal ids by md5 of the text; after the last row comes the first, for one row
    itself). Rows are dealt to runs of near equal size, ranges of that order, and sorted there; each run also gets the
    first row of the run that follows, so that texts are shuffled once and no window spans all rows. Of the rows that
    repeat an id and its text COPIES times, all but one are followed by themselves; they are worked as one. An empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digits = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.when(F.col("doc_id").isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), digits)), F.md5(text))
    base = docs.select("doc_id", key.alias("key"), text.alias("text"))
    keys = stage(base.select("key", F.octet_length("text").alias("size")), "keys")
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    runs, *cuts = _cut_runs(keys, total.n, total.size or 0)
    shared = spark.sparkContext.broadcast((band, *cuts))
    copied = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") >= COPIES), "copied")
    base = base.withColumn("copies", F.lit(1).cast("long"))
    drop_stage(keys)
    if alone := copied.isEmpty():
        drop_stage(copied)
    else:
        these = few(copied.select("key"), 100_000)
        one = base.join(these, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.sum("copies").alias("copies"))
        base = base.join(these, "key", "left_anti").unionByName(one)

    def deal(batches):
        """Adds the run, and gives the first row of a run to the run before as well (after = 1)."""
        _, bounds, first, before = shared.value
        for b in batches:
            own = _key_array(b.column("key"))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, own, side="right"), pa.int32()), pa.array(np.zeros(len(own)), pa.int32()), *b.columns], names=["run", "after", *b.schema.names])
            at = np.minimum(np.searchsorted(first, own), len(first) - 1)
            if len(heads := np.flatnonzero(first[at] == own)):
                part = b.take(pa.array(heads))
                yield pa.RecordBatch.from_arrays([pa.array(before[at[heads]], pa.int32()), pa.array(np.ones(len(heads)), pa.int32()), *part.columns], names=["run", "after", *b.schema.names])

    def pairs(t: pa.Table) -> pa.RecordBatch:
        """Rows of a sorted stretch that are documents, each with the row below it, and copies with themselves."""
        texts, copies = t.column("text").to_pylist(), t.column("copies").to_numpy()
        at = np.flatnonzero(t.column("after").to_numpy()[:-1] == 0)
        more = at[copies[at] > 1]
        who, follow, times = np.concatenate([at, more]), np.concatenate([at + 1, more]), np.concatenate([np.ones(len(at), np.int64), copies[more] - 1])
        edited = []
        for k, y in zip(who.tolist(), follow.tolist(), strict=True):
            q = len(texts[k]) // 4
            edited.append(texts[k][: len(texts[k]) - q] + texts[y][:q])
        band = shared.value[0]
        own, changed = signatures(pa.array(texts, pa.string()), band), signatures(pa.array(edited, pa.string()), band)
        return pa.RecordBatch.from_arrays(
            [
                t.column("doc_id").combine_chunks().take(pa.array(who)),
                pa.array([len(texts[k]) for k in who], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(_hex(own[who]), pa.string()),
                pa.array(_hex(changed), pa.string()),
                pa.array(likeness(own[who], changed), pa.float64()),
                pa.array(likeness(own[who], own[follow]), pa.float64()),
                pa.array(times),
            ],
            names=[*(x.split()[0] for x in kind.split(", ")), "times"],
        )

    def run(batches):
        carry = None
        for b in batches:
            for part in row_slices(b, b.schema.get_field_index("text"), 128):
                part = pa.Table.from_batches([part])
                if carry is not None:
                    part = pa.concat_tables([carry, part])
                carry = part.slice(part.num_rows - 1)
                yield pairs(part)

    rows = base.select("doc_id", "key", "text", "copies").mapInArrow(deal, "run int, after int, doc_id long, key string, text string, copies long")
    out = rows.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "after", "key").mapInArrow(run, f"{kind}, times long")
    if alone:
        return out.drop("times")
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_likeness(docs, lexicon(docs))
