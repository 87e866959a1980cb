"""op1: shards of near equal bytes by a k-d tree over document metadata. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, keep, read, scratch, stage

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Cells of a dimension; all histograms that reach the driver have this many cells a node at most.
CELLS = 1024
#: A cut may miss its quota by this share of a shard's bytes to keep equal texts together.
TOLERANCE = 0.0025
#: Rows that the driver may fetch to place the cuts of one level.
FETCH = 20_000
#: Rows that are numbered by one window.
CHUNK = 1_000

#: Members of a group of equal texts from which on it may be broadcast, and such groups at most.
HOT_ROWS, HOT_GROUPS = 1_000, 100_000

#: Ordinates that follow the chosen dimension where its cell must be cut: bits of the text's checksum, then of a hash of
#: doc_id, then of a hash of the row's place (which parts rows that are equal in all the others).
TIES = {"t0": ("crc", 22, 10), "t1": ("crc", 11, 11), "t2": ("crc", 0, 11), "t3": ("idh", 10, 10), "t4": ("idh", 0, 10), "t5": ("place", 10, 10), "t6": ("place", 0, 10)}


@dataclass
class Cut:
    """A node of shards [low, high); rows before `path`, in the order of `keys`, go to the left half."""

    low: int
    high: int
    keys: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)

    @property
    def middle(self) -> int:
        return self.low + (self.high - self.low) // 2

    def enter(self, key: str, cells: list[tuple[int, int, int]], quota: float) -> tuple[float, float, int]:
        """Appends the cell (of cell, bytes, rows) that the quota falls into; the quota left in it, its bytes and rows."""
        done, cells = 0, sorted(cells)
        self.keys.append(key)
        for cell, size, rows in cells:
            if done + size > quota or cell == cells[-1][0]:
                self.path.append(cell)
                return quota - done, size, rows
            done += size
        self.path.append(0)
        return 0.0, 0.0, 0

    def here(self) -> Column:
        """Whether a row is of this node: nodes are known by their first shard."""
        return F.col("node") == self.low

    def inside(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k) == c for k, c in zip(self.keys, self.path, strict=True)], self.here())

    def before(self) -> Column:
        out = F.lit(False)
        for key, cell in reversed(list(zip(self.keys, self.path, strict=True))):
            out = (F.col(key) < cell) | ((F.col(key) == cell) & out)
        return out


def kd_leaves(meta: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """meta with `node`, the number of each row's leaf, of near equal `size` in sum; meta has the integer cells of dims and TIES.

    Nodes are cut level by level at the weighted median (in proportion to the shards on either side) of the widest
    dimension, widths being shares of the whole table's. Each pass sums bytes by node and cell in the cluster; the driver sees at most 2 * CELLS cells a node and
    dimension. A cell that the quota falls into is refined by the next ordinate until its bytes, or what is left of the
    quota, are within the tolerance; then the cut is put at its nearer side, so that equal texts stay together unless
    their bytes exceed the tolerance. Each level's placement is written to the shared folder.
    """
    rows = stage(meta.withColumn("node", F.lit(0)), "level")
    level, slack, extent = [Cut(0, shards)], None, {}
    while level := [n for n in level if n.high - n.low > 1]:
        totals = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
        cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("cell")) for d in dims])).alias("x")
        sums: dict[int, dict[str, list[tuple[int, int, int]]]] = {n.low: {d: [] for d in dims} for n in level}
        for r in rows.select("node", "size", cells).groupBy("node", "x.dim", "x.cell").agg(*totals).collect():
            if r.node in sums:
                sums[r.node][r.dim].append((r.cell, r.bytes, r.rows))
        if slack is None:
            slack = TOLERANCE * sum(b for _, b, _ in sums[0][dims[0]]) / shards
        left = {}
        for n in level:
            width = {d: max((c for c, *_ in x), default=0) - min((c for c, *_ in x), default=0) for d, x in sums[n.low].items()}
            extent = extent or {d: max(1, w) for d, w in width.items()}
            widest = max(dims, key=lambda d: (width[d] / extent[d], extent[d], -dims.index(d)))
            found = sums[n.low][widest]
            left[n.low] = n.enter(widest, found, sum(b for _, b, _ in found) * (n.middle - n.low) / (n.high - n.low))
        open_ = lambda n: min(left[n.low][0], left[n.low][1] - left[n.low][0]) > slack
        for at, tie in enumerate(TIES):
            if not (todo := [n for n in level if open_(n)]):
                break
            within = rows.where(reduce(lambda a, b: a | b, [n.inside() for n in todo]))
            # Few rows are fetched with all their ordinates at once; more are narrowed down by one ordinate a pass.
            few = sum(left[n.low][2] for n in todo) <= FETCH
            ties = list(TIES)[at:] if few else [tie]
            got = within.groupBy("node", *ties).agg(*totals).collect()
            for n in todo:
                own = [r for r in got if r.node == n.low]
                for t in ties:
                    if own and open_(n):
                        by: dict[int, list[int]] = {}
                        for r in own:
                            cell = by.setdefault(r[t], [0, 0])
                            cell[0] += r.bytes
                            cell[1] += r.rows
                        left[n.low] = n.enter(t, [(c, *v) for c, v in by.items()], left[n.low][0])
                        own = [r for r in own if r[t] == n.path[-1]]
            if few:
                break
        move = F.col("node")
        for n in level:
            quota, size, _ = left[n.low]
            n.path[-1] += quota > size / 2  # the nearer side of the last cell
            move = F.when(n.here() & ~n.before(), n.middle).otherwise(move)
        after = stage(rows.withColumn("node", move), "level")
        drop_stage(rows)
        rows, level = after, [x for n in level for x in (Cut(n.low, n.middle), Cut(n.middle, n.high))]
    return rows


def ranked(rows: DataFrame, name: str, weight: str) -> Column:
    """The cell of a string column: 0 for null, else 1 and more in the order of the values, CELLS at most.

    With few distinct values each has its own cell. Of more, those that begin a cell are drawn by weight (heavy ones are
    sure to be), so that cells weigh much the same; they are all that reaches the driver.
    """
    values = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum(weight).alias("w"))
    u = (F.pmod(F.xxhash64(name), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    first = sorted(r[0] for r in values.orderBy(-F.log(u) / F.col("w"), name).limit(CELLS - 2).select(name).collect())
    if not first:
        return F.lit(0)
    return F.when(F.col(name).isNull(), 0).otherwise(1 + F.size(F.filter(F.array(*map(F.lit, first)), lambda x: x <= F.col(name))))


def _alike(base: DataFrame) -> DataFrame:
    """base with the least lang and source of each group of equal texts, so that no dimension parts the group.

    Only groups of several values need it. The few large ones are broadcast; the rest are joined by a shuffle, in which
    no key has HOT_ROWS rows (or more than HOT_GROUPS keys have).
    """
    both = lambda f: [f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source")]
    group = base.groupBy("crc", "size").agg(F.count(F.lit(1)).alias("rows"), *both(F.min), *both(F.max), F.count("lang").alias("langs"), F.count("source").alias("sources"))
    differ = " OR ".join(f"min_{c} <> max_{c} OR ({c}s > 0 AND {c}s < rows)" for c in ("lang", "source"))
    group = stage(group.where(f"rows > 1 AND ({differ})").select("crc", "size", "rows", "min_lang", "min_source"), "groups")
    n = group.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if not n:
        return base
    hot, cold = (group.where(c).drop("rows") for c in (f"rows > {max(HOT_ROWS, n // HOT_GROUPS)}", f"rows <= {max(HOT_ROWS, n // HOT_GROUPS)}"))
    hot = F.broadcast(hot)  # HOT_GROUPS rows at most
    own = [c for c in base.columns if c not in ("lang", "source")]
    taken = base.drop("lang", "source").join(hot, ["crc", "size"]).select(*own, F.col("min_lang").alias("lang"), F.col("min_source").alias("source"))
    rest = base.join(hot, ["crc", "size"], "left_anti").join(cold.withColumn("hit", F.lit(True)), ["crc", "size"], "left")
    return taken.unionByName(rest.select(*own, *[F.when(F.col("hit"), F.col(f"min_{c}")).otherwise(F.col(c)).alias(c) for c in ("lang", "source")]))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Dimensions are lang and source (cells in the order of their values) and size (on a scale of powers); lang and source
    of equal texts are the least of the group, and a null has cell 0. A null text has no bytes and the checksum of none.
    Rows with a null doc_id and repeated rows are placed like others, by their place in the table where nothing else
    tells them apart. Slots are gapless in each shard, in the order of hashed chunks and doc_id. With fewer rows than
    shards some shards are empty; an empty table gives no rows. Columns other than doc_id, text, lang and source are not
    read, and lang and source may be absent.
    """
    with scratch(docs.sparkSession):
        return keep(_shard_documents(docs, shards), "shards")


def _shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    names = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    base = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("crc"), *names)
    base = stage(base.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "base")
    meta = stage(_alike(base), "alike")
    cells = {c: ranked(meta, c, "size") for c in ("lang", "source")}
    length = F.least(F.lit(CELLS - 1), F.floor(F.log2("size") * 32)).cast("int")
    meta = meta.select("doc_id", "size", "crc", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("idh"), F.pmod("place", F.lit(1 << 20)).alias("place"), *[cells[c].cast("int").alias(c) for c in cells], length.alias("length"))
    meta = meta.withColumns({t: F.shiftright(c, shift).bitwiseAND((1 << bits) - 1).cast("int") for t, (c, shift, bits) in TIES.items()})
    leaves = kd_leaves(meta, ["lang", "source", "length"], shards)
    placed = leaves.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("node").alias("shard"), "place")
    rows = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    chunks = F.array(*[F.lit(-(-rows.get(s, 0) // CHUNK) or 1) for s in range(shards)])
    chunk = F.pmod(F.xxhash64("doc_id", "text_crc32", F.when(F.col("doc_id").isNull(), F.col("place"))), F.element_at(chunks, F.col("shard") + 1)).cast("int")
    placed = placed.withColumn("chunk", chunk)
    sizes = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    begin = sizes.selectExpr("shard", "chunk", "sum(n) OVER (PARTITION BY shard ORDER BY chunk) - n AS begin")
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, chunk ORDER BY doc_id, text_crc32) - 1 AS nth")
    return numbered.join(begin, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
