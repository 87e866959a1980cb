"""op3: near-duplicate documents by SetSketch registers, joint likelihood and exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, fold_case, keep, mix64, read, scratch, span_hashes, stage, text_slices, words
from .components import components
from .labels import new_name

REGISTERS = 120
#: Base, rate and register range of the sketch: 16-bit registers, close to plain minima in resolution.
BASE, RATE, TOP = 1.001, 20.0, 0xFFFF
#: A pair goes on to the exact check unless the likelihood of the threshold is this far (in nats) below the best one.
DOUBT = 20.0
#: Members that one task compares on either side, and their shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 20
#: Rows of ids (some 40 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 250_000

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_plan(threshold: float, registers: int = REGISTERS, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands for which a pair at the threshold shares none with a probability of `miss` at most."""
    for rows in range(8, 1, -1):
        if (1 - threshold**rows) ** (registers // rows) <= miss:
            return registers // rows, rows
    return registers, 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and each text's first (and the count at the end)."""
    data = fold_case(data)
    starts, ends, first = words(data, offs)
    h = span_hashes(data, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(len(h)) + size <= first[1:][doc])
    out = np.full(len(at), size, np.uint64)
    for i in range(size):
        out += h[at + i] * _STEP[i]
    doc = doc[at]
    if len(short := np.flatnonzero((n > 0) & (n < size))):
        add = n[short].astype(np.uint64)
        for i in range(size - 1):
            more = n[short] > i
            add[more] += h[first[short[more]] + i] * _STEP[i]
        out, doc = np.concatenate([out, add]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    out = mix64(out)
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def registers(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets: floor(1 - log_base of the least exponential value), truncated to the range."""
    low = np.empty((len(starts), REGISTERS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        low[:, i] = np.minimum.reduceat(sets * seed, starts)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(regs), bands), np.uint64)
    for j in range(bands):
        key = np.full(len(regs), j + 1, np.uint64) * _STEP[63]
        for i in range(rows):
            key = mix64(key + regs[:, j * rows + i].astype(np.uint64) * _STEP[i])
        out[:, j] = key
    return out.view(np.int64)


def likely(n1: np.ndarray | float, n2: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a Jaccard similarity of the threshold or above is plausible, by the joint likelihood of three register counts.

    more, less, equal: registers in which the first sketch is above, below and equal to the second; n1, n2: set sizes.
    """
    n1 = np.broadcast_to(n1, n2.shape)
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    j = np.concatenate([np.linspace(0.0, 0.999, 24)[None, :] * np.minimum(threshold, top)[:, None], np.linspace(0.0, 1.0, 9)[None, :] * (top - threshold)[:, None] + threshold], axis=1)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    log = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return log[:, 24:].max(axis=1) >= log.max(axis=1) - DOUBT


def _set_keys(sets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each non-empty set."""
    hi, low = np.add.reduceat(mix64(sets), starts), np.add.reduceat(mix64(sets * _STEP[62]), starts)
    return [k.tobytes() for k in np.stack([hi, low], axis=1)]


def _sketches(rows: DataFrame, size: int, bands: int, per: int) -> DataFrame:
    """Per row: row, doc_id, tk (hash of the text), n_shingles, key (digest of the set; null for none), bands."""

    def run(batches):
        for b in batches:
            for lo, data, offs in text_slices(b.column("text")):
                sets, first = shingle_sets(data, offs, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                keys, at = [None] * len(n), np.zeros((0, bands), np.int64)
                if len(some):
                    at = band_keys(registers(sets, first[some]), bands, per)
                    for i, k in zip(some.tolist(), _set_keys(sets, first[some]), strict=True):
                        keys[i] = k
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n > 0)]) * bands, pa.int32()), pa.array(at.ravel()))
                own = [b.column(c).slice(lo, len(n)) for c in ("row", "doc_id", "tk")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], names=["row", "doc_id", "tk", "n_shingles", "key", "bands"])

    return rows.mapInArrow(run, "row long, doc_id long, tk long, n_shingles long, key binary, bands array<long>")


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    """key, n, members, registers of the texts' sets; a task gives each set once."""

    def run(batches):
        seen = set()
        for b in batches:
            for _, data, offs in text_slices(b.column(0)):
                sets, first = shingle_sets(data, offs, size)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                keys = _set_keys(sets, first[some])
                new = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
                if not new:
                    continue
                regs = registers(sets, first[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in new], pa.binary()), pa.array(np.diff(first)[some[new]], pa.int64()), pa.array([sets[first[some[k]] : first[some[k] + 1]].tobytes() for k in new], pa.binary()), pa.array([regs[k].tobytes() for k in new], pa.binary())],
                    names=["key", "n", "members", "registers"],
                )

    return texts.select("text").mapInArrow(run, "key binary, n long, members binary, registers binary")


def _plausible(regs: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs (x, y) those whose sizes and registers allow the threshold."""
    ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    x, y = x[ok], y[ok]
    more, less = (regs[x] > regs[y]).sum(axis=1), (regs[x] < regs[y]).sum(axis=1)
    ok[ok] = likely(n[x].astype(float), n[y].astype(float), more, less, REGISTERS - more - less, percent / 100) if len(x) else []
    return ok


EDGES = "a binary, b binary"


def _edges(keys: list[bytes], a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in x], pa.binary()) for x in (a, b)], names=["a", "b"])


def _bucket_links(percent: int):
    """Of rows sorted by band: plausible links that span each bucket. A bucket is whole in one partition and has BLOCK_DOCS rows at most."""

    def spanning(t: pa.Table) -> pa.RecordBatch:
        keys, n = t.column("key").to_pylist(), t.column("n").to_numpy()
        regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        band = t.column("band").to_numpy()
        end = np.searchsorted(np.flatnonzero(np.diff(band)), np.arange(len(band)))
        end = np.append(np.flatnonzero(np.diff(band)) + 1, len(band))[end]
        comp = list(range(len(band)))

        def root(k: int) -> int:
            while comp[k] != k:
                comp[k] = comp[comp[k]]
                k = comp[k]
            return k

        a, b, step = [], [], 1
        while len(at := np.flatnonzero(np.arange(len(band)) + step < end)):
            for x in at[_plausible(regs, n, at, at + step, percent)].tolist():
                if (p := root(x)) != (q := root(x + step)):
                    comp[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(x + step)
            step += 1
        return _edges(keys, a, b)

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            band = t.column("band").to_numpy()
            cut = int(np.flatnonzero(np.diff(band))[-1]) + 1 if len(band) and band[0] != band[-1] else 0
            rest = t.slice(cut)
            if cut:
                yield spanning(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield spanning(rest)

    return run


def _compare(percent: int, exact: bool):
    """Links that join different components: within a block (side 0), or from open members (1) to all (2). With `exact`, confirmed on full sets."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("key", "ascending")])
        keys, n, side = t.column("key").to_pylist(), t.column("n").to_numpy(), t.column("side").to_numpy()
        comp = np.unique(np.array([k.hex() for k in t.column("comp").to_pylist()]), return_inverse=True)[1]
        sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()] if exact else []
        regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(len(keys), REGISTERS)
        opened = int((side == 1).sum())
        a, b = [], []
        for x in range(opened or len(keys)):
            ys = np.arange(opened or x + 1, len(keys))
            ys = ys[comp[ys] != comp[x]]
            ys = ys[_plausible(regs, n, np.full(len(ys), x), ys, percent)]
            if exact and len(ys):
                every = np.concatenate([sets[y] for y in ys])
                at = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
                both = np.add.reduceat((sets[x][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(n[ys])[:-1]]))
                ys = ys[100 * both >= percent * (n[x] + n[ys] - both)]
            for y in ys.tolist():
                if comp[x] != comp[y]:
                    comp[comp == comp[y]] = comp[x]
                    a.append(x)
                    b.append(y)
        return pa.Table.from_batches([_edges(keys, a, b)])

    return run


def _blocks(count, size):
    return F.greatest(F.ceil(count / BLOCK_DOCS), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _large_links(rows: DataFrame, large: DataFrame, group: str, percent: int, exact: bool) -> DataFrame:
    """Links that span the groups of `large` (group, hub, blocks), each worked by many tasks.

    First each block is compared within itself, with the group's hub in every block, which joins most of a group of
    copies. Then only members outside the group's largest component are compared with all others, as pairs of blocks.
    """
    test = _compare(percent, exact)
    big = stage(rows.join(large, group), "large")
    place = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = big.withColumns({"block": F.explode(F.when(F.col("key") == F.col("hub"), every).otherwise(F.array(place))), "side": F.lit(0), "comp": F.col("key")})
    first = stage(own.groupBy(group, "block").applyInArrow(test, EDGES), "links")
    found = components(first).toDF("key", "component")
    named = stage(big.join(found, "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component"), "named")
    share = named.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    most = share.groupBy(group).agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("all_rows"), F.max("rows").alias("top"), F.sum("size").alias("all_size"), F.max_by("size", F.struct("rows", "comp")).alias("top_size"))
    left = most.where("all_rows > top").select(group, "main", _blocks(F.col("all_rows") - F.col("top"), F.col("all_size") - F.col("top_size")).alias("u_blocks"))
    rest = named.join(few(left, BROADCAST_IDS), group)
    u = rest.where("comp <> main").withColumns({"u": F.pmod(F.xxhash64("key"), "u_blocks").cast("int"), "m": F.explode(every), "side": F.lit(1)})
    m = rest.withColumns({"u": F.explode(F.sequence(F.lit(0), F.col("u_blocks") - 1)), "m": place, "side": F.lit(2)})
    return first.union(u.unionByName(m).groupBy(group, "u", "m").applyInArrow(test, EDGES))


def _grouped(rows: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For rows (row, doc_id, text): their sketches (row, doc_id, tk, n_shingles, key), and per key its component's root and leader.

    The leader is the component's first row by doc_id (nulls last), hash of the text, and row. See near_duplicates().
    """
    bands, per = band_plan(percent / 100)
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("tk"), "text")
    sketched = stage(_sketches(rows, shingle, bands, per), "sketches")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "row")).alias("lead")
    classes = stage(sketched.where("key is not null").groupBy("key").agg(lead, F.first("bands").alias("bands")), "classes")
    # Buckets know a class by a hash of its key: two classes of one hash only make a bucket larger.
    banded = classes.select(F.xxhash64("key").alias("h"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"), F.bit_xor("h").alias("mixed")).where("rows > 1")
    buckets = buckets.groupBy("rows", "low", "high", "mixed").agg(F.min("band").alias("band")).select("band", "rows")
    placed = stage(banded.join(buckets, "band"), "placed")
    wanted = classes.withColumn("h", F.xxhash64("key")).join(few(placed.select("h").distinct(), BROADCAST_IDS), "h", "left_semi").select(F.col("lead.doc_id").alias("d"), F.col("lead.tk").alias("t"))
    texts = rows.join(few(wanted, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left_semi")
    sets = stage(_full_sets(texts, shingle).dropDuplicates(["key"]), "sets")

    members = placed.join(sets.select(F.xxhash64("key").alias("h"), "key", "n", "registers"), "h").drop("h")
    small = members.where(F.col("rows") <= BLOCK_DOCS).repartition("band").sortWithinPartitions("band").mapInArrow(_bucket_links(percent), EDGES)
    near = stage(small, "near")
    if not (hot := placed.where(F.col("rows") > BLOCK_DOCS)).isEmpty():
        large = members.where(F.col("rows") > BLOCK_DOCS).groupBy("band").agg(F.min("key").alias("hub"), _blocks(F.count(F.lit(1)), F.lit(0)).alias("blocks"))
        near = near.union(_large_links(members.drop("rows"), few(large, BROADCAST_IDS), "band", percent, False))

    clusters = components(near).toDF("key", "cluster")
    members = stage(sets.join(clusters, "key"), "members")
    large = members.groupBy("cluster").agg(F.min("key").alias("hub"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")).where("blocks > 1")
    large = few(stage(large, "large"), BROADCAST_IDS)
    small = members.join(large, "cluster", "left_anti").withColumns({"side": F.lit(0), "comp": F.col("key")})
    links = small.groupBy("cluster").applyInArrow(_compare(percent, True), EDGES)
    if not large.isEmpty():
        links = links.union(_large_links(members, large, "cluster", percent, True))
    found = components(links).toDF("key", "component")
    rooted = stage(classes.join(found, "key", "left").select("key", F.coalesce("component", "key").alias("root"), "lead"), "rooted")
    leaders = rooted.groupBy("root").agg(F.min("lead").alias("lead"))
    return sketched.drop("bands"), rooted.select("key", "root").join(leaders, "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Links: 100 * |intersection| >= percent * |union| of the texts' sets of distinct `shingle`-word shingles.
    1. Equal sets become one class. 2. Classes that share a band of register values are a bucket; buckets of equal
    members count once. Within a bucket, pairs whose sizes and registers make the threshold plausible by joint
    likelihood give links that span them; clusters are the components of these links, so that merely sharing a band
    joins nothing. 3. Within a cluster, plausible pairs of different components are confirmed on full sets. 4. Components
    of the confirmed links. Buckets and clusters beyond a block are worked by many tasks and nothing of them is cut.

    Classes, not ids, are linked, so rows that repeat a doc_id are judged each by its own text. component_id is the
    smallest doc_id in the component, and null where all are null; a row with a null doc_id is never kept. A text of
    fewer words than a shingle is one shingle; a null or wordless text has none, links with nothing and has its own
    doc_id as component. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    with scratch(docs.sparkSession):
        sketched, classes = _grouped(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), shingle, percent)
        out = sketched.join(classes.select("key", F.col("lead.doc_id").alias("lead")), "key", "left")
        out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("lead")))
        return keep(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")), "groups")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near_duplicates(): the first by doc_id (nulls last), hash of its text, and place.

    Rows are known by their place in the table, so repeated or null ids lose no other document and keep no copy. Null and
    wordless texts link with nothing, and all their rows stay.
    """
    row = new_name(docs, "row_number")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession):
        sketched, classes = _grouped(numbered.select(F.col(row).alias("row"), "doc_id", "text"), shingle, percent)
        joined = sketched.where("key is not null").join(classes.select("key", F.col("lead.row").alias("lead")), "key")
        dropped = keep(joined.where("row <> lead").select(F.col("row").alias(row)), "dropped")
    return numbered.join(few(dropped, BROADCAST_IDS), row, "left_anti").select(docs.columns)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
