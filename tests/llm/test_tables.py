import hashlib
from collections import defaultdict
import zlib

import duckdb
import pytest

from factloom.llm import fingerprints, sharding, urls


def test_shards(docs, odd, none):
    rows = sharding.shard_documents(docs, 4).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots, size, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        b = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        groups[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * largest
    assert max(map(len, groups.values())) == 1  # equal texts stay together here
    assert sharding.shard_documents(odd, 3).count() == 7 and sharding.shard_documents(none, 3).count() == 0


def test_shards_of_a_hot_group(spark):
    """A group of copies larger than a shard is split; sizes stay near equal."""
    df = spark.createDataFrame([(i, "x" * 100 if i % 3 else f"row {i} " + "y" * 93, "en", "s", 1) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    size = defaultdict(int)
    for r in sharding.shard_documents(df, 10).collect():
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 10
    assert len(size) == 10 and max(abs(s - mean) for s in size.values()) < 0.02 * mean


@pytest.mark.parametrize("fetch", [0, 20_000])
def test_shards_against_a_plain_tree(spark, monkeypatch, fetch):
    """The tree cut again by sorting rows; both ways of reading the cuts give it."""
    monkeypatch.setattr(sharding, "FETCH", fetch)
    rng = __import__("random").Random(5)
    rows = [(i, "word " * rng.randint(1, 400) + str(i % 70 or i), rng.choice("abcde"), f"source {rng.randint(0, 30):02}", 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node int").repartition(3)
    got = {r.doc_id: (r.shard, r["size"]) for r in sharding.shard_documents(df, 8).collect()}
    groups = defaultdict(list)
    for i, t, lang, source, _ in rows:
        groups[t].append((lang, source))
    langs, sources = sorted({r[2] for r in rows}), sorted({r[3] for r in rows})
    points = []
    for i, t, *_ in rows:
        size = len(t) + 16
        points.append((i, zlib.crc32(t.encode()), size, {"lang": 1 + langs.index(min(g[0] for g in groups[t])), "source": 1 + sources.index(min(g[1] for g in groups[t])), "length": min(1023, int(__import__("math").log2(size) * 32))}))
    extent = {d: max(p[3][d] for p in points) - min(p[3][d] for p in points) for d in ("lang", "source", "length")}
    mean = sum(p[2] for p in points) / 8

    def check(part, low, high):
        """Rows of shards low to high, cut at the weighted median of their widest dimension, up to a tie's bytes."""
        if high - low < 2:
            return
        middle = low + (high - low) // 2
        width = {d: (max(p[3][d] for p in part) - min(p[3][d] for p in part)) / extent[d] for d in extent}
        d = max(width, key=lambda k: (width[k], extent[k]))
        left, right = [p for p in part if got[p[0]][0] < middle], [p for p in part if got[p[0]][0] >= middle]
        assert max(p[3][d] for p in left) <= min(p[3][d] for p in right)
        quota = sum(p[2] for p in part) * (middle - low) / (high - low)
        assert abs(sum(p[2] for p in left) - quota) <= max(p[2] for p in part) / 2 + 2 * sharding.TOLERANCE * mean + max(p[2] for p in part)
        check(left, low, middle)
        check(right, middle, high)

    check(points, 0, 8)
    by_text = defaultdict(set)
    for i, t, *_ in rows:
        by_text[t].add(got[i][0])
    assert max(map(len, by_text.values())) == 1


def test_equal_rows_without_an_id_are_dealt_to_shards(spark):
    """Rows that nothing tells apart, over many shards; clashing columns; groups of equal texts from many sources, some broadcast."""
    df = spark.createDataFrame([(None, "the very same text", None, f"s{i % 50}", i) for i in range(3000)] + [(i, f"text {i % 40}", "en", f"s{i % 7}", i) for i in range(1000)], "doc_id long, text string, lang string, source string, shard int").withColumn("crc", __import__("pyspark").sql.functions.lit("x")).repartition(3)
    size, slots = defaultdict(int), defaultdict(list)
    for r in sharding.shard_documents(df, 10).collect():
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 10
    assert len(size) == 10 and max(abs(x - mean) for x in size.values()) < 0.05 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_cells_follow_the_order_of_values(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 20)
    df = spark.createDataFrame([(f"v{i:04}", 1 + 500 * (i == 77)) for i in range(1000)] + [(None, 1)], "v string, w long")
    got = sorted((r.v or "", r.c) for r in df.select("v", sharding.ranked(df, "v", "w").alias("c")).collect())
    assert got[0] == ("", 0) and [c for _, c in got] == sorted(c for _, c in got) and got[-1][1] <= 20
    cells = dict(got)
    assert cells["v0077"] != cells["v0076"]  # a heavy value begins a cell
    assert max(list(cells.values()).count(c) for c in set(cells.values())) < 400


URLS = [None, "", "no scheme", "http://EXAMPLE.org/en/12#x", "https://a.b.example.org/es/?q", "https://org", "https://org/", "http://xorg/", "http://m.example.com/de/x", "http://example.com/fr", "ftp://x://example.com/de/", "https://spam-farm.example.net/a/b", "http://spam-farm.example.net?x", "http://www.spam-farm.example.net/", "http://x.net/\u00e9/", "://org/", "http://example.org./es/", "http://.org/", "http://m.casino-win.example.com/x/", "http://notcasino-win.example.com/x", "https://free-bets.example.net:80/"]


def test_urls_against_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, verdict string")
    got = urls.judge_urls(pages, spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string"), spark.createDataFrame([(u,) for u in urls.LISTED], "url string")).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.sql(urls.OP2_SQL)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    by = {r.page_id: r for r in got}
    assert (by[3].rule, by[3].verdict) == ("example.org/en/1", "block") and by[6].rule == "org/" and by[5].rule is None and by[11].verdict == "block"


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    blocks = urls.bloom_blocks(keys, 188)
    assert urls.possible_hits(keys, blocks, 188).count() == 3000
    assert urls.possible_hits(spark.range(5000).selectExpr("concat('n', id) AS key"), blocks, 188).count() < 100


def test_urls_with_large_lists_and_none(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 1)  # a filter far too small for its keys
    monkeypatch.setattr(urls, "BROADCAST_KEYS", 0)
    test_urls_against_sql(spark)
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    empty = urls.judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string"), spark.createDataFrame([], "url string")).collect()
    assert [tuple(r) for r in empty] == [(1, "a.org", "/x", None, "allow")]
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string"), spark.createDataFrame([(None,)], "url string")).count() == 0


def test_a_list_of_300_000_urls(spark):
    """Beyond what the exact join broadcasts: pages on the list, of listed hosts and their subdomains, and none of the others."""
    listed = spark.range(300_000).selectExpr("CASE WHEN id % 3 = 0 THEN concat('host', id, '.net/') ELSE concat('site.net/page/', id) END AS url")
    pages = spark.range(6000).selectExpr("id AS page_id", "CASE id % 4 WHEN 0 THEN concat('https://a.b.host', id * 30, '.net/some/path') WHEN 1 THEN concat('http://SITE.net/page/', id, '/?q=1') WHEN 2 THEN concat('http://nothost', id * 3, '.net/') ELSE concat('http://site.net/other/', id) END AS url", "'x' AS rule")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string"), listed).collect()}
    want = {k: "block" if (k % 4 == 0 and k * 30 < 300_000) or (k % 4 == 1 and k % 3) else "allow" for k in range(6000)}
    assert got == want


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_fingerprints(request, name):
    df = request.getfixturevalue(name)
    band = fingerprints.lexicon(df)
    got = fingerprints.edited_likeness(df, band).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = defaultdict(int)
    for k, (doc, text) in enumerate(rows):
        follow, q = rows[(k + 1) % len(rows)][1], len(text) // 4
        want[doc, len(text), hashlib.sha256((text[: len(text) - q] + follow[:q]).encode()).hexdigest()] += 1
    for r in got:
        want[r.doc_id, r.n_chars, r.edited_sha256] -= 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 6 * 80
        if r.edited_fingerprint == r.fingerprint:
            assert r.near_edited == 1.0
    assert not any(want.values())
    one = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df, band).collect() if r.doc_id is not None} if name == "docs" else {}
    assert all(one.get(r.doc_id, r.fingerprint) == r.fingerprint for r in got)
    if name == "docs":
        by = defaultdict(set)
        for r in df.collect():
            by[r.text or ""].add(one[r.doc_id])
        assert all(len(s) == 1 for s in by.values())


def test_document_frequencies(docs):
    import re

    from factloom.llm.common import span_hashes
    import numpy as np

    texts = [t.text or "" for t in docs.collect()]
    df = defaultdict(int)
    for t in texts:
        for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))):
            df[w] += 1
    band = {w for w, n in df.items() if 2 <= n <= len(texts) / 5}
    hashes = {int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in band}
    assert set(fingerprints.lexicon(docs).tolist()) == hashes


def naive(text, band):
    """A text's signature and terms, term by term, in Python's own numbers."""
    import re

    from factloom.llm.common import span_hashes
    import numpy as np

    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    words = set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())))
    terms = {int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words}
    terms = (terms & band) or terms
    out = []
    for k, (a, b) in enumerate(fingerprints._SEEDS.tolist()):
        picked = [t for t in terms if mix(t * a & m64) >> 64 - fingerprints.LEVELS[k // fingerprints.SUBSETS] == 0]
        total = sum(mix(t ^ b) for t in picked) & m64
        out.append(0 if not total else mix(total) % ((1 << 24) - 1) + 1)
    return out


def naive_likeness(a, b):
    if not any(a) and not any(b):
        return 1.0
    for level in range(4, -1, -1):
        pairs = [(x, y) for x, y in zip(a, b)][16 * level : 16 * level + 16]
        used = [p for p in pairs if any(p)]
        if len(used) >= 8 or level == 0:
            return sum(x == y for x, y in used) / len(used) if used else float(a == b)


def check_fingerprints(df, band):
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen = {}
    sign = lambda t: seen.setdefault(t, naive(t, set(band.tolist())))
    want = []
    for k, (doc, text) in enumerate(rows):
        follow, q = rows[(k + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - q] + follow[:q]
        hexed = lambda t: "".join(f"{v:06x}" for v in sign(t))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(text), hexed(edited), naive_likeness(sign(text), sign(edited)), naive_likeness(sign(text), sign(follow))))
    assert sorted(map(str, want)) == sorted(map(str, map(tuple, fingerprints.edited_likeness(df, band).collect())))


@pytest.mark.parametrize("run_bytes, copies", [(1 << 24, 100), (2_000, 2)])
def test_fingerprints_against_a_plain_form(spark, docs, odd, monkeypatch, run_bytes, copies):
    monkeypatch.setattr(fingerprints, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(fingerprints, "COPIES", copies)
    check_fingerprints(docs, fingerprints.lexicon(docs))
    check_fingerprints(odd, fingerprints.lexicon(odd))
    wide = [(0, "a b c d"), (1, "e f g h"), (2**63 - 1, "i j k l m"), (-(2**63), "n o p q"), (None, "r s t u"), (None, None), (10**12, "v w")]
    clash = spark.createDataFrame([(i, t, "x", 7) for i, t in wide], "doc_id long, text string, key string, run int").selectExpr("*", "1 AS times", "2 AS after", "3 AS copies")
    check_fingerprints(clash, fingerprints.lexicon(clash))
    one = spark.createDataFrame([(5, "only this text here")], "doc_id long, text string")
    check_fingerprints(one, fingerprints.lexicon(one))


def test_no_run_holds_most_rows(spark, monkeypatch):
    """An outlier among the ids, and many rows without an id, leave the runs near equal."""
    monkeypatch.setattr(fingerprints, "RUN_BYTES", 4_000)
    rows = [(i, f"text {i} of some words") for i in range(3000)] + [(10**12, "far")] + [(None, f"no id {i % 700}") for i in range(2000)] + [(None, "same")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fingerprints.edited_likeness(df, fingerprints.lexicon(df))
    assert out.count() == len(rows)
    from pyspark.sql import functions as F

    per = [r["count"] for r in out.where("n_chars <> 4").groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) > 15 and max(per) < 800


def test_a_small_lexicon_limit(docs, monkeypatch):
    whole = fingerprints.lexicon(docs)
    monkeypatch.setattr(fingerprints, "TERMS", len(whole) // 2)
    assert 0 < len(fingerprints.lexicon(docs)) <= len(whole) // 2


def test_no_rows(none):
    assert fingerprints.edited_likeness(none, fingerprints.lexicon(none)).count() == 0
