import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import tokens
from factloom.llm import bpe
from factloom.llm.bpe import BacktrackingBpe, WholeTokenCounter, WordBpe, encoder, prove

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    alphabet = "ab'st  \n\n\t<|>12é  ßΣσς你好ÀÉ\x01\x02\x1c.,!?-"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    wide = "ab 1'\u00a0\u3000\u2003\u2028 \nяжЖ你好世界ñ한글אبति€—’“”😀\u0558\u1e05\ua7c0\U00031350\U00011fc0٣५²½ⅧǅªºʰΩ\u0301\u200d\ufeff\ufffd\U0010ffff\x1c\x1f\x00"
    made += ["".join(rng.choice(wide) for _ in range(rng.randint(0, 40))) for _ in range(2500)]
    made += ["Привет, мир! Это длинный текст на русском языке. " * 3, "今日は良い天気です。東京は大きい。", "مرحبا بالعالم ١٢٣", "नमस्ते दुनिया १२३", "καλημέρα κόσμε", "a\u00a0 b", "a \u00a0b", "\u00a0 \u00a0 x", " \u3000\u3000x y\u2009", "x" * 3000 + "é" * 2000]
    return made + ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\n y", " <|startoftext|>Hi", "don't DON'T we'll  it's", "İstanbul ſ K", "", "  ", "\n", " a", "a ", "a  b", "a\n \nb", "\u00a0\n x"]


@pytest.mark.parametrize("path, kind", [(BYTE, BacktrackingBpe), (BYTE, WholeTokenCounter), (WORD, WordBpe)])
def test_same_ids_as_the_library(prose, path, kind):
    texts = [t or "" for t in prose] + odd_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    own = encoder(kind, path, *([prove(path)] if path == BYTE else []))
    if kind is WordBpe:
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == want
    elif kind is WholeTokenCounter:
        assert [own.count(t) for t in texts] == [len(x) for x in want]
    else:
        got = [own.encode(t) for t in texts]
        assert [x.tolist() for x in got] == want
        assert [own.decode(x).decode() for x in got] == texts
        assert [own.decimal(x).decode() for x in got] == [",".join(map(str, x)) for x in want]


def test_random_bytes_decode_like_the_library():
    own, lib, rng = encoder(BacktrackingBpe, BYTE, prove(BYTE)), Tokenizer.from_file(BYTE), random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert own.decode(np.array(ids, "<u4")).decode() == lib.decode(ids, skip_special_tokens=False)


def test_queries_keep_all_rows(docs, odd, none):
    lib = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokens.count_tokens(docs, BYTE, 50).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 50)
    for r in tokens.encoding_digests(docs, BYTE).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert all(r.decoded == texts[r.doc_id] for r in tokens.encode_documents(docs, BYTE).collect())
    assert tokens.count_tokens(odd, BYTE).count() == 7 and tokens.encoding_digests(none, BYTE).count() == 0


def test_workers_do_without_the_library(monkeypatch):
    """Once proved, no text of any script needs the library: here it fails when asked."""
    texts = odd_texts()
    lib = Tokenizer.from_file(BYTE)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    proof = prove(BYTE)

    def fails(*_):
        raise AssertionError("the library was asked")

    monkeypatch.setattr(bpe, "_library", fails)
    monkeypatch.setattr(bpe, "Tokenizer", fails)
    counter, codec = WholeTokenCounter(BYTE, proof), BacktrackingBpe(BYTE, proof)
    assert [codec.encode(t).tolist() for t in texts] == want
    assert [counter.count(t) for t in texts] == [len(x) for x in want]


def test_classes_of_all_code_points():
    """Each code point between letters, digits and signs is cut as the library cuts it."""
    lib, own = Tokenizer.from_file(BYTE), encoder(BacktrackingBpe, BYTE, prove(BYTE))
    for lo in range(0, 0x110000, 0x4000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(lo, lo + 0x4000) if not 0xD800 <= c < 0xE000)
        assert own.pieces(text) == [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]


def test_memory_is_bounded_by_bytes(prose):
    memo = bpe.Memo(lambda k: k * 2, 5_000)
    for i in range(1000):
        assert memo[f"key {i}"] == f"key {i}" * 2
        assert sum(map(len, memo)) < 5_000
    memo["x" * 100_000]
    assert all(len(k) <= bpe.LONGEST for k in memo)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "ids": F.lit(1), "N_BYTES": F.lit(2)})
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.count_tokens(df, BYTE).collect()) == [(1, 2), (2, 0)]
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.encoding_digests(df, BYTE).collect()) == [(1, 2), (2, 0)]
    assert sorted((r.doc_id, len(r.ids)) for r in tokens.encode_documents(df, BYTE).collect()) == [(1, 2), (2, 0)]
