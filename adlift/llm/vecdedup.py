"""Near-duplicate vectors, exact: spherical k-means cells, blocked cosine products.

1. Equal vectors collapse to one class with a multiplicity.
2. Spherical k-means is fitted on at most ``FIT_ROWS`` classes (smallest hashes, a
   documented bound); the number of cells grows with the data up to ``MAX_CELLS``.
3. Every class is at home in its nearest cell.  The plane between two centroids bounds
   the cosine of a row with any vector at home in another cell (``reach``); a row is
   compared with every cell the bound leaves, so no link is lost, whatever the number
   of cells.  Clustered vectors leave few cells; vectors without structure leave nearly
   all, and the work is then that of all pairs.
4. Blocks of bounded size are runs of small cells or hash pieces of a large one.  A row
   goes to the pairs (own block, other block) in which the bound leaves it a cell, so
   vectors move from executor to executor and never through the driver.  Both ends of a
   link reach each other's cell, so their pair of blocks holds both.  Cosines of a pair
   are matrix products in double precision; a task emits link counts and a spanning
   forest, never pairs.
5. Components come from the forests; the smallest vec_id of each is kept.

Edge cases: null or zero vectors and vectors with null or non-finite components
link with nothing (n_links 0, own component); vectors link only with vectors of
the same length; repeated rows are vectors of their own that link with each other;
a null vec_id takes part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.graph import connected_components
from adlift.llm.store import written
from adlift.session import ensure_checkpoint_dir

MIN_COSINE = 0.9
FIT_ROWS = 20_000
CELL_ROWS = 256
MAX_CELLS = 4096
ROWS, COLS = 256, 8192   # cosines of so many rows and vectors at once
BLOCK_BYTES = 16 << 20   # vectors of a block in double precision, at most
MIN_BLOCKS = 8           # blocks of a small table, for its tasks
TASKS_A_BLOCK = 4        # shuffle partitions a block; never more than there are pairs
ROUNDS = 8
MAX_SINE = math.sqrt(1 - MIN_COSINE ** 2)
SLACK = 1e-9             # far above the rounding of the products
LINKS = "cls long, links long, root long"


def _classes(kind: str):
    def run(batches):
        for b in batches:
            cls, dim, raw = [], [], []
            col = b.column("v")
            values = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=kind)  # null components: NaN
            at, known = col.offsets.to_numpy(), col.is_valid().to_pylist()
            for i, ok in enumerate(known):
                x = values[at[i]:at[i + 1]]
                if not ok or len(x) == 0 or not np.isfinite(x).all() or not x.any():
                    cls.append(None), dim.append(0), raw.append(None)
                    continue
                raw.append(x.tobytes())
                cls.append(int.from_bytes(hashlib.blake2b(raw[-1], digest_size=8).digest(), "big", signed=True))
                dim.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cls, pa.int64()), pa.array(dim, pa.int32()),
                                              pa.array(raw, pa.binary())], ["vec_id", "cls", "dim", "raw"])
    return run


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("<f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows spread evenly over the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i:i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total ** 2).sum(axis=1))
        ok = norm > 0
        c[ok] = total[ok] / norm[ok, None]
    return c


def _assign(centroids, kind: str):
    def run(batches):
        c = centroids.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _unit(b.column("raw").to_pylist(), kind)
            home = np.concatenate([np.argmax(x[i:i + 1024] @ c.T, axis=1) for i in range(0, len(x), 1024)])
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *[b.column(n) for n in ("cls", "n", "raw")]],
                                             ["cell", "cls", "n", "raw"])
    return run


def reach(x: np.ndarray, home: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Per row of ``x`` and cell: may the cell be home to a vector linked with the row?

    A vector at home in cell i lies on i's side of the plane between the centroids i and
    j; a row at home in j whose sine to that plane is above ``MAX_SINE`` links with none."""
    d = x @ c.T
    gap = d[np.arange(len(x)), home][:, None] - d
    norm = (c ** 2).sum(axis=1)
    apart = np.sqrt(np.maximum(0.0, norm[home][:, None] + norm - 2 * c[home] @ c.T))
    return gap <= MAX_SINE * apart + SLACK


class Blocks:
    """Blocks of about ``rows`` vectors each: runs of small cells, or pieces of a large cell
    dealt by class.  ``lo`` and ``hi`` are a block's first and last cell."""

    def __init__(self, sizes: np.ndarray, rows: int) -> None:
        lo, hi, held = [], [], rows + 1
        self.first = np.zeros(len(sizes), dtype=np.int64)
        self.pieces = np.ones(len(sizes), dtype=np.int64)
        for cell, size in enumerate(sizes.tolist()):
            n = max(1, -(-size // rows))
            if n > 1 or held + size > rows:
                lo += [cell] * n
                hi += [cell] * n
                self.first[cell], self.pieces[cell] = len(lo) - n, n
                held = size if n == 1 else rows + 1
            else:
                self.first[cell], hi[-1] = len(lo) - 1, cell
                held += size
        self.lo, self.hi = np.array(lo), np.array(hi)

    def of(self, cell: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return self.first[cell] + cls % self.pieces[cell]

    def reached(self, cells: np.ndarray) -> np.ndarray:
        """Rows x blocks from rows x cells: does the block hold a cell of the row's?"""
        upto = np.zeros((len(cells), cells.shape[1] + 1), dtype=np.int32)
        np.cumsum(cells, axis=1, out=upto[:, 1:])
        return upto[:, self.hi + 1] > upto[:, self.lo]


PAIRED = "a int, b int, block int, cls long, n long, raw binary"


def _deal(centroids, blocks, kind: str):
    """Each row to the pairs of blocks (its own, one that it reaches)."""
    def run(batches):
        c, bl = centroids.value, blocks.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                b = batch.slice(s, ROWS)
                cell, cls = b.column("cell").to_numpy(), b.column("cls").to_numpy()
                own = bl.of(cell, cls)
                row, other = np.nonzero(bl.reached(reach(_unit(b.column("raw").to_pylist(), kind), cell, c)))
                for t in range(0, len(row), COLS):
                    i, o = row[t:t + COLS], other[t:t + COLS]
                    some = [b.column(x).take(pa.array(i)) for x in ("cls", "n", "raw")]
                    low, high = np.minimum(own[i], o), np.maximum(own[i], o)
                    yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int32)) for v in (low, high, own[i])], *some],
                                                     ["a", "b", "block", "cls", "n", "raw"])
    return run


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cls, root)`` links that connect what the links ``(u, v)`` connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:  # smallest label of each connected set, by repeated minima
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    tree = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tree], nodes[label[tree]]


def _compare(kind: str):
    """Cosines between the two blocks of a pair: link counts of both sides and a forest."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        a, b = (k.as_py() for k in key)
        block, cls, mult = (t.column(x).to_numpy() for x in ("block", "cls", "n"))
        x = _unit(t.column("raw").to_pylist(), kind)
        left = np.flatnonzero(block == a)
        right = left if a == b else np.flatnonzero(block == b)
        y = x[right]
        links, label = np.zeros(len(x)), np.arange(len(x))
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in range(0, len(left), ROWS):
            rows = left[s:s + ROWS]
            for u in range(s if a == b else 0, len(right), COLS):
                hit = x[rows] @ y[u:u + COLS].T >= MIN_COSINE
                if a == b:  # each pair once
                    hit &= right[u:u + COLS] > rows[:, None]
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                i, j = rows[i], right[u + j]
                links += np.bincount(i, mult[j], len(x)) + np.bincount(j, mult[i], len(x))
                new = label[i] != label[j]
                node, root = _forest(label[i[new]], label[j[new]])
                ends.append((node, root))
                to = np.arange(len(x))
                to[node] = root
                label = to[label]
        node, root = (np.concatenate(e) for e in zip(*ends, strict=True))
        some = np.flatnonzero(links)
        return pa.table({"cls": np.concatenate([cls[some], cls[node]]),
                         "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(node), np.int64)]),
                         "root": pa.array(np.concatenate([np.zeros(len(some), np.int64), cls[root]]),
                                          mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(node), bool)]))})
    return run


def cell_links(reps: DataFrame, rows: int, dim: int, kind: str) -> DataFrame:
    """``(cls, links, root)``: partial link counts (root null) and forest links, of
    classes ``(cls, n, raw)`` that all have the length ``dim``."""
    spark = reps.sparkSession
    k = int(min(MAX_CELLS, max(1, rows // CELL_ROWS)))
    fit = reps.select("cls", "raw").orderBy(F.xxhash64("cls"), "cls").limit(FIT_ROWS).toArrow()
    k = min(k, fit.num_rows)
    c = spark.sparkContext.broadcast(spherical_kmeans(_unit(fit.column("raw").to_pylist(), kind), k))
    homes = written(reps.mapInArrow(_assign(c, kind), "cell int, cls long, n long, raw binary"), "cells")
    sizes = np.zeros(k, dtype=np.int64)
    for r in homes.groupBy("cell").count().collect():  # at most MAX_CELLS rows
        sizes[r["cell"]] = r["count"]
    blocks = Blocks(sizes, max(1, min(BLOCK_BYTES // (8 * dim), -(-rows // MIN_BLOCKS))))
    n = len(blocks.lo)
    dealt = homes.mapInArrow(_deal(c, spark.sparkContext.broadcast(blocks), kind), PAIRED)
    tasks = min(n * (n + 1) // 2, TASKS_A_BLOCK * n)
    return written(dealt.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(_compare(kind), LINKS), "pairs")


def vector_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row."""
    ensure_checkpoint_dir(vectors.sparkSession)
    single = vectors.select(vector).schema[0].dataType.simpleString() == "array<float>"  # moved as they are, compared as doubles
    kind = "<f4" if single else "<f8"
    src = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    v = written(src.mapInArrow(_classes(kind), "vec_id long, cls long, dim int, raw binary"), "vectors")
    reps = written(v.where("cls is not null").groupBy("cls", "dim").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")), "reps")
    found = None
    for r in reps.groupBy("dim").count().orderBy("dim").collect():  # one row per vector length
        part = cell_links(reps.where(F.col("dim") == r["dim"]).select("cls", "n", "raw"), r["count"], r["dim"], kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.lit(True).alias("kept"))
    comp = connected_components(found.where("root is not null").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.where("root is null").groupBy(F.col("cls").alias("c")).agg(F.sum("links").alias("links"))
    classes = reps.select("cls", "rep", "n").join(links, F.col("cls") == F.col("c"), "left") \
        .join(comp, F.col("cls") == F.col("node"), "left") \
        .select("cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "cls").alias("comp"))
    names = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    classes = classes.join(names, "comp").select(F.col("cls").alias("c"), "n_links", "component_id")
    out = v.select("vec_id", "cls").join(classes, F.col("cls") == F.col("c"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
