import re
from itertools import combinations

import numpy as np
import pytest

from factloom.llm import neardup
from factloom.llm.components import components


def brute(rows, size, percent):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(docs, size, percent):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, size, percent).collect()}
    assert got == want and sum(k for *_, k in want.values()) < len(want) - 5


@pytest.mark.parametrize("block", [2, 3, 7])
def test_small_blocks_lose_nothing(docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == want


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 3, 85).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, -4, False), (None, None, False), (7, -4, False), (7, -4, False), (7, 7, True), (9, 9, True), (-4, -4, True)]))
    assert neardup.near_duplicates(none).count() == 0 and neardup.without_near_duplicates(none).count() == 0
    left = sorted((str(r.doc_id), r.text) for r in neardup.without_near_duplicates(odd, 3, 85).collect())
    assert left == [("-4", "a b c d e f"), ("7", "other words in this row"), ("9", ""), ("None", None)]


A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows, components, stay", [
    ([(5, A), (5, B), (8, A + " x"), (9, B + " y")], {(5, A): 5, (5, B): 5, (8, A + " x"): 5, (9, B + " y"): 5}, {(5, A), (5, B)}),
    ([(5, A), (7, A + " x"), (7, B)], {(5, A): 5, (7, A + " x"): 5, (7, B): 7}, {(5, A), (7, B)}),
    ([(5, A), (5, A), (None, A), (None, A)], {(5, A): 5, (None, A): 5}, {(5, A)}),
    ([(None, A), (None, A), (None, A + " x"), (None, B)], {(None, A): None, (None, A + " x"): None, (None, B): None}, {(None, B)}),
])
def test_repeated_and_null_ids(spark, rows, components, stay):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], KIND).repartition(2)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sorted(map(str, (r.component_id for r in got))) == sorted(map(str, (components[r] for r in rows)))
    left = [(r.doc_id, r.text) for r in neardup.without_near_duplicates(df).collect()]
    assert len(left) == len(set(left)) == len(stay) + (len(stay) == 1 and rows[0][0] is None) and stay <= set(left)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, A, 5, "k"), (2, A, 6, "l"), (3, B, 7, "m")], "doc_id long, text string, row_number int, key string").selectExpr("*", "key AS lead_", "1 AS row", "2 AS n", "3 AS component_id", "4 AS kept")
    assert [(r.doc_id, r.kept) for r in neardup.near_duplicates(df).orderBy("doc_id").collect()] == [(1, True), (2, False), (3, True)]
    out = neardup.without_near_duplicates(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.row_number, r.key, r.kept) for r in out.collect()) == [(1, 5, "k", 4), (3, 7, "m", 4)]


def test_texts_that_only_share_boilerplate_stay_apart(spark):
    """Pairs of a low similarity share bands; they are no candidates, and nothing joins them."""
    common = " ".join(f"c{i}" for i in range(40))
    df = spark.createDataFrame([(i, common + " " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1) for i in range(200)], KIND)
    assert neardup.near_duplicates(df).where("kept").count() == 200


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_likelihood_keeps_true_pairs_and_drops_far_ones():
    rng = np.random.default_rng(5)
    draw = lambda n: np.sort(rng.integers(1, 1 << 63, n, dtype=np.uint64))
    kept = dropped = 0
    for _ in range(60):
        a = draw(400)
        for share, count in ((0.95, True), (0.05, False)):
            b = np.sort(np.concatenate([a[: int(400 * share)], draw(400 - int(400 * share))]))
            ra, rb = (neardup.registers(x, np.array([0]))[0].astype(int) for x in (a, b))
            more, less = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
            ok = neardup.likely(400.0, np.array([400.0]), more, less, neardup.REGISTERS - more - less, 0.85)[0]
            kept, dropped = kept + (ok and count), dropped + (not ok and not count)
    assert kept == 60 and dropped == 60
