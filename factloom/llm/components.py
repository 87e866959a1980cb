"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, keep, scratch, stage


def _first(*cols: str):
    """The column whose value comes first in a fixed random order (so that no run of ordered ids makes a long chain)."""
    return reduce(lambda x, y: F.least(x, y), [F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")) for c in cols])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the undirected edges (a, b), of any type that has an order.

    Each round maps a node to the first of its neighbours' neighbours and contracts the edges; only per-node minima are
    shuffled, so a hub costs no more than its edges. Rounds are written to the shared folder and removed. Loops and
    edges with a null end are left out; no edges give no rows.
    """
    with scratch(edges.sparkSession):
        left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        maps: list[DataFrame] = []
        while not left.isEmpty():
            both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
            once = both.groupBy("u").agg(F.min(_first("v")).alias("f")).select("u", F.least(_first("u"), "f")["id"].alias("v"))
            once = stage(once, "once")
            to = stage(once.join(once.select(F.col("u").alias("v"), F.col("v").alias("to")), "v").select("u", "to"), "map")
            drop_stage(once)
            x, y = to.toDF("a", "x"), to.toDF("b", "y")
            after = left.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            after = stage(after, "edges")
            drop_stage(left)
            left, maps = after, [*maps, to]
        if not maps:
            return keep(left.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        label = maps[0].toDF("node", "root")
        for m in maps[1:]:
            label = label.join(m.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        label = stage(label, "labels")
        low = label.groupBy("root").agg(F.min("node").alias("component"))
        return keep(label.join(low, "root").select("node", "component"), "components")
