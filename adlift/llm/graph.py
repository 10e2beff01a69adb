"""Connected components of a link table, as Spark jobs.

``connected_components`` first contracts each partition's links to a forest of
stars with a local union-find, then alternates large-star and small-star steps
(each a min-aggregate and a join on the node) until the link set is a set of
stars.  No node's neighbours are ever gathered in one task; link sets between
rounds are ``checkpoint()``ed to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.session import ensure_checkpoint_dir

EDGE_SCHEMA = "u long, v long"
FOREST_LINKS = 1_000_000  # distinct nodes held by a task's union-find before it is flushed


class UnionFind:
    """Union-find over arbitrary integer keys; roots are the smallest key."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (y := p.get(root, root)) != root:
            root = y
        while p.get(x, x) != root:
            p[x], x = root, p.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            self.parent.setdefault(a, a)
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.parent[hi] = lo
        self.parent.setdefault(lo, lo)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        """(member, root) of every member that is not its own root."""
        members = [x for x in self.parent if self.find(x) != x]
        return members, [self.find(x) for x in members]


def _forest(batches):
    uf = UnionFind()

    def out():
        u, v = uf.stars()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            uf.union(u, v)
        if len(uf.parent) > FOREST_LINKS:
            yield out()
            uf = UnionFind()
    yield out()


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of the links ``(u, v)``; a component is
    named by its smallest node.  Null ends and self links are ignored."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").mapInArrow(_forest, EDGE_SCHEMA)
    e = e.distinct().checkpoint(eager=True)
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: each link points from its larger end
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = small.where("u <> v").distinct().checkpoint(eager=True)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
