"""op9: near-duplicate embeddings by range search in a robust-pruned flat graph, built on overlapping cluster shards."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, keep, mix64, read, scratch, stage
from .components import components

#: Vectors that one level's centroids are fitted on, in expectation at most, and clusters that it makes; a level's clusters are split again.
SAMPLE, CLUSTERS = 32_768, 1024
#: Vectors a cluster is meant to hold, and how many times as many make it be split; part of a cluster's rows from which on a child is not split again.
CLUSTER_SIZE, SPLIT, STALLED = 600, 4, 0.8
#: Nearest groups of clusters that each vector may join in any case; members of a shard that one task holds on either side; floats a routing task holds.
OVERLAP, BLOCK, CHUNK = 4, 2048, 1 << 21
#: Standard deviations of a partner's offset that routing allows for; part of a shard from which on a range is computed in full.
SPREAD, DENSE = 1.5, 16
#: Of what a walk has met: the nearest that pruning goes through, the nearest from which others are taken at spaced ranks, and how many.
NEAREST, REACH, FAR = 24, 96, 12
#: Random earlier vectors that become neighbours too; neighbours kept, and as many that chose a vector; slack of the pruning rule.
RANDOM, DEGREE, ALPHA = 8, 40, 1.44
#: Expansions before the range is walked; how far below the range the walk still goes; vectors that start the graph.
WALK, SLACK, SEEDS = 32, 0.08, 64


def usable(v):
    """Whether a vector can link: no null or non-finite component, not all zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from a fixed seed; clusters that lose all members keep their place."""
    c = x[np.random.default_rng(9).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def merged(c: np.ndarray, least: float) -> np.ndarray:
    """Each centroid's group: centroids chained by cosines of least or more, which split one dense region between them."""
    group = np.arange(len(c))
    near = c @ c.T >= least
    while True:
        low = np.where(near, group[None, :], len(c)).min(axis=1)
        low = np.minimum(low, group)
        if (low == group).all():
            return group
        group = low


def routes(x: np.ndarray, c: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, group and whether it is the row's home, for all groups in which x's partners may be at home.

    A vector at cosine least or more can lie in another cluster's cell only if the plane between both centroids is
    within that radius, which decides on the OVERLAP nearest groups. Groups further down the order are joined where
    the plane is within SPREAD standard deviations of such a vector's offset in a random direction.
    """
    radius = np.sqrt(max(0.0, 1 - least * least))
    sims = x @ c.T
    first = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(c @ c.T, -1, 1)))[first]
    gap = sims[np.arange(len(x)), first][:, None] - sims
    names, at = np.unique(group, return_inverse=True)
    best, can, likely = np.full((len(x), len(names)), -2.0), np.zeros((len(x), len(names)), bool), np.zeros((len(x), len(names)), bool)
    for k, g in enumerate(at):
        best[:, g] = np.maximum(best[:, g], sims[:, k])
        can[:, g] |= gap[:, k] <= radius * apart[:, k] + 1e-9
        likely[:, g] |= gap[:, k] <= radius * min(1.0, SPREAD / np.sqrt(x.shape[1])) * apart[:, k] + 1e-9
    top = np.argsort(-best, axis=1, kind="stable")[:, :OVERLAP]
    in_top = np.zeros_like(can)
    np.put_along_axis(in_top, top, True, axis=1)
    row, g = np.nonzero(likely | (can & in_top))
    return row, names[g], g == at[first[row]]


def walk(qx: np.ndarray, x: np.ndarray, graph: np.ndarray, start: np.ndarray, least: float | None, own: np.ndarray | None = None) -> np.ndarray:
    """Cosines of the queries qx with the vectors of x that greedy walks from `start` (and each query's own node) meet; -2 for the others.

    Where least is given, the walk then goes on over all that lies in the range or little below it. A range that takes
    up much of x is computed in full, which is exact and costs less than walking it.
    """
    n, rows = len(x), np.arange(len(qx))
    sims = np.full((len(qx), n), -2.0)
    done = np.zeros((len(qx), n), dtype=bool)
    sims[:, start] = qx @ x[start].T
    if own is not None:
        sims[rows, own] = 1.0
    step, live = 0, rows
    while len(live) and (step < WALK or least is not None):
        open_sims = np.where(done[live], -3.0, sims[live])
        width = 1 if step < WALK else min(8, n)
        best = open_sims.argmax(axis=1)[:, None] if width == 1 else np.argpartition(-open_sims, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(open_sims, best, axis=1)
        want = value > -2 if step < WALK else value >= least - SLACK
        some = want.any(axis=1)
        live, best, want = live[some], best[some], want[some]
        if least is not None:
            dense = (sims[live] >= least).sum(axis=1) * DENSE >= n
            if dense.any():
                sims[live[dense]] = qx[live[dense]] @ x.T
                live, best, want = live[~dense], best[~dense], want[~dense]
        r, c = np.nonzero(want)
        done[live[r], best[r, c]] = True
        to = graph[best[r, c]]
        who = np.repeat(live[r], to.shape[1])
        to = to.ravel()
        new = sims[who, to] == -2.0
        who, to = who[new], to[new]
        if len(who):
            sims[who, to] = np.einsum("ij,ij->i", qx[who], x[to])
        step += 1
    return sims


def incremental_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each vector: DEGREE that it chose and DEGREE that chose it; its own index where there are fewer.

    Vectors are put in by batches that grow with the graph. Each one's candidates are what a greedy walk over the graph
    so far has met, and its batch. The nearest are gone through nearest first, and what a kept one is clearly nearer to
    is left out (robust pruning); others at spaced ranks, and random earlier vectors, make the long edges.
    """
    n = len(x)
    graph = np.repeat(np.arange(n)[:, None], 2 * DEGREE, axis=1)
    back = np.zeros(n, np.int64)
    rng = np.random.default_rng(11)
    order = rng.permutation(n)
    at = 0
    while at < n:
        batch = order[at : at + (max(16, min(256, at // 4)) if at else SEEDS)]
        sims = walk(x[batch], x, graph, order[: min(8, at)], None) if at else np.full((len(batch), n), -2.0)
        sims[:, batch] = x[batch] @ x[batch].T
        if at:
            pick = order[rng.integers(0, at, (len(batch), RANDOM))]
            np.put_along_axis(sims, pick, np.einsum("ij,ikj->ik", x[batch], x[pick]), axis=1)
        sims[np.arange(len(batch)), batch] = -2.0
        reach = min(REACH, n)
        near = np.argpartition(-sims, reach - 1, axis=1)[:, :reach] if reach < n else np.repeat(np.arange(n)[None, :], len(batch), axis=0)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
        close = min(NEAREST, reach)
        ranks = np.unique(np.concatenate([np.arange(close), np.geomspace(1, reach, FAR).astype(int) - 1]))
        cand = near[:, ranks]
        far = 1 - np.take_along_axis(sims, cand, axis=1)
        alive = far < 3
        between = 1 - np.matmul(x[cand], x[cand].transpose(0, 2, 1))
        if at:
            cand, far = np.concatenate([cand, pick], axis=1), np.concatenate([far, np.zeros(pick.shape)], axis=1)
            alive = np.concatenate([alive, np.ones(pick.shape, bool)], axis=1)
        count = np.zeros(len(batch), np.int64)
        for j in range(cand.shape[1]):
            take = np.flatnonzero(alive[:, j] & (count < DEGREE))
            graph[batch[take], count[take]] = cand[take, j]
            count[take] += 1
            if j < len(ranks):
                alive[take, :close] &= (ALPHA * between[take, j] > far[take, : len(ranks)])[:, :close]
        source, place = np.nonzero(np.arange(DEGREE)[None, :] < count[:, None])
        target, source = graph[batch[source], place], batch[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nth = np.arange(len(target)) - np.searchsorted(target, target)
        free = back[target] + nth < DEGREE
        graph[target[free], DEGREE + back[target[free]] + nth[free]] = source[free]
        for v in np.unique(target[~free]).tolist():  # a full list keeps its nearest
            mine = np.unique(np.concatenate([graph[v, DEGREE:], source[target == v]]))
            mine = mine[mine != v]
            graph[v, DEGREE : DEGREE + min(DEGREE, len(mine))] = mine[np.argsort(-(x[mine] @ x[v]), kind="stable")[:DEGREE]]
        back = np.minimum(DEGREE, back + np.bincount(target, minlength=n))
        at += len(batch)
    return graph


def _build(dim: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids = t.column("rep").to_numpy()
        near = ids[incremental_graph(unit(t.column("embedding"), dim))]
        return pa.table({"rep": pa.array(ids), "near": pa.array(list(near), pa.list_(pa.int64()))})

    return run


def _local(ids: np.ndarray, near: pa.ListArray) -> np.ndarray:
    """Adjacency lists of ids (in order) as places in them; neighbours that are not among them point back."""
    size, flat = near.value_lengths().to_numpy(), near.flatten().to_numpy()
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    row = np.repeat(np.arange(len(ids)), size)
    at = np.where(ids[at] == flat, at, row)
    graph = np.repeat(np.arange(len(ids))[:, None], max(1, size.max()), axis=1)
    graph[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = at
    return graph


#: A row without b: wa vectors are linked with a. A row with wa: the link of a and b, which counts wa for a and wb for b. Others only say that both are connected.
LINKS = "a long, b long, wa long, wb long"


def _search(dim: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("rep", "ascending")])
        ids, copies, home, block = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "home", "block"))
        x, near = unit(t.column("embedding"), dim), t.column("near").combine_chunks()
        sides = [np.flatnonzero(block == k) for k in np.unique(block)]
        inner = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        found = np.zeros((len(ids), len(ids)), dtype=bool)
        for asked, base in [(sides[0], sides[0])] if inner else [(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []:
            xb, graph = x[base], _local(ids[base], near.take(pa.array(base)))
            start = np.unique(np.append(np.linspace(0, len(base) - 1, 8).astype(int), (xb @ xb.mean(axis=0)).argmax()))
            queries = np.flatnonzero(home[asked])
            for lo in range(0, len(queries), 256):
                q = queries[lo : lo + 256]
                found[asked[q][:, None], base] = walk(x[asked[q]], xb, graph, start, least, q if inner else None) >= least
        np.fill_diagonal(found, False)
        # Pairs at home here are counted here, from both ends; the others are named, as their other shard may name them too.
        rows: list[tuple] = []
        x_, y_ = np.nonzero(found[home][:, ~home])
        for p, q in zip(np.flatnonzero(home)[x_].tolist(), np.flatnonzero(~home)[y_].tolist(), strict=True):
            p, q = (p, q) if ids[p] < ids[q] else (q, p)
            rows.append((ids[p], ids[q], copies[q], copies[p]))
        mine = np.flatnonzero(home)
        both = found[np.ix_(mine, mine)]
        both |= both.T
        comp = np.arange(len(mine))
        for k in np.flatnonzero(both.any(axis=1)).tolist():
            at = np.flatnonzero(both[k])
            rows.append((ids[mine[k]], None, copies[mine[at]].sum(), None))
            for y in at[comp[at] != comp[k]].tolist():
                if comp[y] != comp[k]:
                    comp[comp == comp[y]] = comp[k]
                    rows.append((ids[mine[k]], ids[mine[y]], None, None))
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("a", "b", "wa", "wb"))})

    return run


def _split(level: DataFrame, dim: int, least: float) -> DataFrame | None:
    """level (rep, copies, embedding, cluster, home, parent) with the clusters that are too large replaced by theirs; None if there is none.

    parent: rows of the cluster that a row's cluster was split off, 0 for the first.
    """
    homes = F.count_if("home")
    sizes = level.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), homes.alias("homes"), F.max("parent").alias("parent"))
    large = stage(sizes.where((F.col("homes") > SPLIT * CLUSTER_SIZE) & ((F.col("parent") == 0) | (F.col("rows") < STALLED * F.col("parent")))).drop("parent"), "large")
    if large.isEmpty():
        return None
    k = F.least(F.lit(CLUSTERS), F.ceil(F.col("homes") / CLUSTER_SIZE)).cast("int")
    large = large.withColumns({"k": k, "every": F.greatest(F.lit(1), F.floor(F.col("homes") / F.least(F.lit(SAMPLE), 64 * k)).cast("long")), "chunks": F.ceil(F.col("rows") / max(256, CHUNK // max(1, dim))).cast("int")})
    large = few(large, 100_000)
    rows = level.drop("parent").join(large, "cluster")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        c = centroids(unit(t.column("embedding"), dim), t.column("k")[0].as_py())
        return pa.table({"cluster": t.column("cluster").slice(0, 1), "centers": pa.array([c.tobytes()], pa.binary()), "groups": pa.array([merged(c, least)], pa.list_(pa.int64()))})

    fitted = stage(rows.where(F.col("home") & (F.pmod(F.xxhash64("rep"), "every") == 0)).select("cluster", "k", "rep", "embedding").groupBy("cluster").applyInArrow(fit, "cluster long, centers binary, groups array<long>"), "fitted")

    def route(t: pa.Table, f: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and f.num_rows:
            c, group = np.frombuffer(f.column("centers")[0].as_py()).reshape(-1, dim), np.array(f.column("groups")[0].as_py())
            for lo in range(0, t.num_rows, 1024):
                part = t.slice(lo, 1024).combine_chunks()
                row, child, own = routes(unit(part.column("embedding"), dim), c, group, least)
                part = part.take(pa.array(row))
                named = mix64(part.column("cluster").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + child.astype(np.uint64) + np.uint64(1)).view(np.int64)
                out.append(pa.table({"rep": part.column("rep"), "copies": part.column("copies"), "embedding": part.column("embedding"), "cluster": pa.array(named), "home": pa.array(own & part.column("home").to_numpy()), "parent": part.column("rows")}))
        return pa.concat_tables(out) if out else pa.table({"rep": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "cluster": pa.array([], pa.int64()), "home": pa.array([], pa.bool_()), "parent": pa.array([], pa.int64())})

    dealt = rows.select("rep", "copies", "embedding", "cluster", "home", "rows", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"))
    each = fitted.join(large, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "centers", "groups")
    made = dealt.groupBy("cluster", "chunk").cogroup(each.groupBy("cluster", "chunk")).applyInArrow(route, "rep long, copies long, embedding array<float>, cluster long, home boolean, parent long")
    return level.join(large.select("cluster"), "cluster", "left_anti").select("rep", "copies", "embedding", "cluster", "home", "parent").union(made)


def _shards(vectors: DataFrame, dim: int, least: float) -> DataFrame:
    """rep, copies, embedding, home, (cluster, i, j), block: every vector in all groups of clusters that routes() names, large groups as pairs of blocks.

    All vectors are one cluster at first; clusters that are too large are split, by centroids fitted on a sample of
    each, until they are small or do not fall apart any more.
    """
    level = stage(vectors.select("rep", "copies", "embedding", F.lit(0).cast("long").alias("cluster"), F.lit(True).alias("home"), F.lit(0).cast("long").alias("parent")), "level")
    while (after := _split(level, dim, least)) is not None:
        level = stage(after, "level")
    large = level.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = level.join(few(stage(large, "blocks"), 100_000), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("rep", "copies", "embedding", "home", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def near_vectors(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Per row of rows (vec_id, embedding): vec_id, n_links, component_id, kept, by cosine in double precision.

    Equal vectors become one class. Classes are dealt by distance to groups of clusters (centroids fitted on bounded
    samples, level by level; those within the radius of each other make one group). Each shard's graph is built by
    putting in one vector after another, each with robust-pruned neighbours among what a greedy walk meets; a class's
    lists are united, and its links are searched at its home from the shard's medoids, over the whole range. Every link
    found is checked by its cosine and counts at both its ends, whichever found it; n_links counts vectors, copies
    included. Groups beyond BLOCK members are worked as pairs of blocks.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Vectors of different lengths do not link. A null vec_id takes its class's component and is never kept;
    where all ids of a class are null it links with nothing but its copies. Repeated rows count as vectors. A cosine
    of exactly `least` is a link. An empty table gives no rows. Columns other than vec_id and embedding are not read.
    """
    spark = rows.sparkSession
    with scratch(spark):
        base = rows.select("vec_id", "embedding")
        classes = base.where(usable("embedding")).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        classes = stage(classes, "classes")
        known = classes.where("rep is not null")
        found = []
        for size in known.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
            shards = stage(_shards(known.where(F.size("embedding") == size.dim), size.dim, least), "shards")
            lists = shards.where("i = j").groupBy("cluster", "i").applyInArrow(_build(size.dim), "rep long, near array<long>")
            lists = stage(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")
            found.append(stage(shards.join(lists, "rep").groupBy("cluster", "i", "j").applyInArrow(_search(size.dim, least), LINKS), "links"))
        links = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LINKS)
        named = links.where("b is not null and wa is not null").distinct()
        counts = links.where("b is null").select(F.col("a").alias("rep"), F.col("wa").alias("w"))
        counts = counts.union(named.select("a", "wa")).union(named.select("b", "wb")).groupBy("rep").agg(F.sum("w").alias("w"))
        component = components(links.where("b is not null").select("a", "b")).toDF("rep", "component")
        out = base.join(classes, "embedding", "left").join(counts, "rep", "left").join(component, "rep", "left")
        out = out.withColumn("n_links", F.coalesce("w", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0)))
        out = out.withColumn("component_id", F.coalesce("component", "rep", "vec_id"))
        return keep(out.select("vec_id", F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")), "vectors")


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
