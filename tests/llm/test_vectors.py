import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from factloom.llm import vectors

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    good = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    low, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                links[a] += 1
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def sample(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    group = x[0] + 0.15 * rng.normal(size=(120, 16))
    x = np.concatenate([x, group, x[5:9], 3 * x[9:12], np.tile(x[20], (6, 1))]).astype(np.float32)
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    return rows + [(10_001 + 2 * k, v) for k, v in enumerate(bad)]


def small(monkeypatch, size, block=2048, clusters=1024):
    monkeypatch.setattr(vectors, "CLUSTER_SIZE", size)
    monkeypatch.setattr(vectors, "SPLIT", 1)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CLUSTERS", clusters)


@pytest.mark.parametrize("size, block, clusters", [(600, 2048, 1024), (60, 2048, 1024), (40, 2048, 3), (150, 40, 1024)])
def test_against_all_pairs(spark, monkeypatch, size, block, clusters):
    """Whole, split at once, split over levels, and as pairs of blocks."""
    rows = sample()
    want = brute(rows)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    small(monkeypatch, size, block, clusters)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got.keys() == want.keys()
    assert sum(n for n, *_ in got.values()) >= 0.97 * sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] == want[i][1:] for i in want) >= len(want) - 3


def test_audit_of_recall(spark, monkeypatch):
    """Every row whose id is divisible by 50 against all rows, in blocks, over more than 50 clusters of two levels; links have two ends."""
    small(monkeypatch, 60, clusters=20)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(150, 32))
    x = (middle[rng.integers(0, 150, 5000)] + 0.3 * rng.normal(size=(5000, 32)) * rng.uniform(0.2, 1, (5000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], ROWS)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.concatenate([(x[k : k + 500] @ x.T >= 0.95).sum(axis=1) - 1 for k in range(0, 5000, 500)])
    found = np.array([got[k][0] for k in range(5000)])
    asked = np.arange(0, 5000, 50)
    few = exact < 20
    print(f"recall {found[asked].sum() / exact[asked].sum():.4f}, of all rows {found.sum() / exact.sum():.4f}, of rows with few {found[few].sum() / exact[few].sum():.4f}")
    assert (found <= exact).all() and found.sum() % 2 == 0
    assert found[asked].sum() >= 0.95 * exact[asked].sum() and found[few].sum() >= 0.95 * exact[few].sum()
    pairs = [c for c, n in __import__("collections").Counter(c for _, c in got.values()).items() if n == 2]
    assert all(n == 1 for n, c in got.values() if c in set(pairs))


def test_clusters_of_the_audit(spark, monkeypatch):
    small(monkeypatch, 60, clusters=20)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, 1, rng.normal(size=16).astype("f4").tolist()) for i in range(5000)], "rep long, copies long, embedding array<float>")
    shards = vectors._shards(df, 16, 0.95)
    assert shards.select("cluster").distinct().count() > 50
    homes = shards.where("home").groupBy("rep").count()
    assert homes.count() == 5000 and homes.where("count <> 1").count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, None)], ROWS)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, False)], key=str)
    assert vectors.near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    clash = df.selectExpr("*", "1 AS rep", "2 AS copies", "'x' AS home", "3 AS component_id")
    assert vectors.near_vectors(clash).count() == 4


def test_hot_third_over_many_clusters(spark, monkeypatch, tmp_path):
    """A third of the rows within 0.95 of each other, split over many centroids; VECTORS=120000 audits a large table."""
    n = int(os.environ.get("VECTORS", 3000))
    if "VECTORS" not in os.environ:
        small(monkeypatch, 30)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 64))
    x[: n // 3] = x[0] + 0.2 * rng.normal(size=(n // 3, 64))
    x[-n // 20 :] = x[n // 3 : n // 3 + n // 20] + 0.25 * rng.normal(size=(n // 20, 64))
    x = x[rng.permutation(n)].astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, n, max(1, n // 2000))
    exact = np.concatenate([(x[asked[k : k + 250]] @ x.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(asked), 250)])
    found = np.array([got[k] for k in asked.tolist()])
    few = exact < 100
    print(f"recall {found.sum() / exact.sum():.4f} of {exact.sum()} links; of rows with few links {found[few].sum() / exact[few].sum():.4f} of {exact[few].sum()}")
    assert (found <= exact).all()
    assert found.sum() >= 0.97 * exact.sum() and found[few].sum() >= 0.9 * exact[few].sum()
