import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, window):
    """Best-fit decreasing by looking through all open windows."""
    left, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(left)) if left[w] >= lengths[i]]
        w = min(fits, key=lambda w: left[w]) if fits else len(left)
        if not fits:
            left.append(window)
        out[i] = w
        left[w] -= lengths[i]
    return len(left)


def test_segment_tree_packs_as_tight_as_a_search():
    rng = np.random.default_rng(0)
    for window in (7, 64, 100, 4096):
        lengths = rng.integers(1, window + 1, 300)
        seq, off = packing.best_fit_decreasing(lengths, window)
        assert seq.max() + 1 == plain_best_fit(lengths.tolist(), window)
        for s in range(seq.max() + 1):
            rows = sorted(zip(off[seq == s], lengths[seq == s]))
            assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= window
    assert packing.best_fit_decreasing(np.zeros(0, np.int64), 8)[0].size == 0


def test_every_id_is_in_one_piece(docs, odd, none):
    lib = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.token_pieces(docs, PATH, window=256), window=256, pieces_a_bucket=40).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = np.array([*lib.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(odd).count() == 7 and packing.pack_documents(none).count() == 0


def test_copies_are_dealt_to_many_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, "the same few words")] * 600, "doc_id long, text string").withColumns({"bucket": F.lit("x"), "copy": F.lit("y"), "offset": F.lit(1)}).repartition(3)
    rows = packing.pack(packing.token_pieces(df, PATH, window=64), window=64, pieces_a_bucket=50).collect()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 600 and max(Counter(s % 12 for s in (r.sequence_id for r in rows)).values()) < 150
    assert all(sum(n for _, n in v) <= 64 and sorted(o for o, _ in v) == [v[0][1] * k for k in range(len(v))] for v in by_seq.values())
