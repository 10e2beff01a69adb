"""Prefix trie of conversations, its subtree totals by time-forward processing.

``rebuilt_turns`` numbers the turns of every conversation and gives it the first turns of
its block's first conversation; ``prefix_trie`` returns a row per distinct prefix.

* Numbering.  Rows are range partitioned by (conversation, turn, role, digest), so a
  conversation that holds a third of all rows lies over many chunks; places and prefix keys
  are running counts and xors within a chunk plus those of the chunks before it.
* Nodes.  A prefix is named by its depth and the xor of 2 x 64 bits of every (depth, SHA-256
  of role and text) on its way, so an ordinary, map-side combined grouping finds the nodes.
* Subtree totals (``subtree_totals``).  Nodes are range partitioned by (smallest member,
  depth) into shards of about ``SHARD_NODES``.  A shard's nodes are sorted in reverse level
  order; each takes the messages that its children left in a priority queue, adds its own
  values and sends the total on to its parent's place.  The queue spills sorted runs to
  unnamed files.  What is addressed to a node of another shard is summed per node.  The nodes
  so addressed form a smaller tree (the parent of one is whom its shard's root addresses), whose
  totals are found in the same way; with those as first messages the shards run once more.
* Ends.  Conversations are sorted by (node, conversation) over all partitions, joined to
  segments of at most ``SEGMENT_IDS`` ids, and a node's segments are hashed in order as a
  stream: memory does not grow with the number of copies.

Edge cases: null role or text is empty; turns with the same number keep the order of role and
digest, a null turn comes first; repeated rows are turns of their own; rows with a null conv_id
belong to no conversation and are left out; a conversation that is left without turns ends at
the root; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.llm.store import written
from adlift.operators.joins import join_small

BLOCK = 20               # conversations c - c % BLOCK .. share the first turns of the first
HEADS = 4                # crc32(c) % HEADS turns are taken from there
SHARD_NODES = 1 << 15
QUEUE_MESSAGES = 1 << 20  # messages held before a run is spilled
RUN_PIECE = 1 << 14       # messages read from a run at once
SEGMENT_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k0", "k1"]


# -- turns ------------------------------------------------------------------

def _lane(i: int, depth: Column) -> Column:
    return F.xxhash64(F.lit(i), depth.cast("long"), F.col("digest"))


def _before(per_chunk: DataFrame, **totals: Column) -> DataFrame:
    """Per (conv, chunk) what the conversation's chunks before it hold."""
    w = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select("conv", "chunk", *[F.coalesce(x.over(w), F.lit(0)).cast("long").alias(n) for n, x in totals.items()])


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, k0, k1, p0, p1, words)`` of every turn of the rebuilt conversations,
    and ``(conv, length, k0, k1)`` of the conversations, also of those left without turns."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv is not null")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    c = c.select("conv", "turn", "role", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = c.repartitionByRange("conv", *order).withColumn("chunk", F.spark_partition_id())
    rows = written(dealt, "turns")
    counts = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = _before(counts, base=F.sum("n"))
    place = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy(*order)) - 1
    rows = rows.withColumn("place", place).join(base, ["conv", "chunk"])
    rows = rows.withColumn("place", F.col("place") + F.col("base")).drop("base", "turn", "role")
    rows = written(rows, "numbered")

    # the first turns of the blocks' first conversations, with the keys of the prefixes they make
    first = rows.where((F.col("conv") % BLOCK == 0) & (F.col("place") < HEADS - 1))
    up = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    depth = (F.col("place") + 1).alias("depth")
    first = first.select("conv", depth, "words", *[_lane(i, F.col("place") + 1).alias(f"x{i}") for i in (0, 1)],
                         *[F.bit_xor(_lane(i, F.col("place") + 1)).over(up).alias(f"k{i}") for i in (0, 1)])
    heads = first.groupBy(F.col("conv").alias("block")).agg(F.array_sort(F.collect_list(F.struct(  # at most HEADS - 1
        "depth", "k0", "k1", F.col("k0").bitwiseXOR(F.col("x0")).alias("p0"),
        F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), "words"))).alias("head"))
    convs = counts.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = convs.withColumn("block", F.col("conv") - F.col("conv") % BLOCK)
    convs = convs.withColumn("h", (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int"))
    convs = convs.join(heads, "block", "left")
    convs = convs.withColumn("head", F.slice("head", F.lit(1), F.col("h")))  # null without a first conversation
    taken = F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.size("head"))
    last = lambda k: F.coalesce(F.try_element_at("head", F.lit(-1))[k], F.lit(0).cast("long")).alias(k)
    convs = written(convs.select("conv", "h", "head", taken.alias("taken"),
                                 (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"),
                                 last("k0"), last("k1")), "conversations")

    # own turns: where their rebuilt conversation begins is known per (conversation, chunk)
    chunks = counts.select("conv", "chunk").join(convs.select("conv", "h", "taken", "k0", "k1"), "conv")
    own = rows.join(chunks, ["conv", "chunk"]).where("place >= h")
    own = own.withColumn("depth", F.col("taken") + F.col("place") - F.col("h") + 1)
    own = own.select("conv", "chunk", "depth", "words", F.col("k0").alias("h0"), F.col("k1").alias("h1"),
                     *[_lane(i, F.col("depth")).alias(f"x{i}") for i in (0, 1)])
    sums = own.groupBy("conv", "chunk").agg(*[F.bit_xor(f"x{i}").alias(f"x{i}") for i in (0, 1)])
    base = _before(sums, b0=F.bit_xor("x0"), b1=F.bit_xor("x1"))
    up = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    key = [F.bit_xor(f"x{i}").over(up).bitwiseXOR(F.col(f"b{i}")).bitwiseXOR(F.col(f"h{i}")).alias(f"k{i}") for i in (0, 1)]
    own = own.join(base, ["conv", "chunk"]).select("conv", F.col("depth").cast("long").alias("depth"), *key, "x0", "x1", "words")
    own = own.select("conv", *KEY, F.col("k0").bitwiseXOR(F.col("x0")).alias("p0"), F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), "words")
    taken = convs.where("taken > 0").select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    turns = written(taken.select(own.columns).unionByName(own), "rebuilt")
    return turns, convs.select("conv", "length", "taken", "k0", "k1")


# -- time-forward processing ------------------------------------------------

MESSAGE = np.dtype([("time", "<i8"), ("values", "<i8", (3,))])


class SpillingQueue:
    """Messages by the time at which they are taken; equal times are summed."""

    def __init__(self, limit: int = QUEUE_MESSAGES) -> None:
        self.limit, self.held, self.size = limit, [], 0
        self.runs: list[list] = []  # [file, messages left in it, messages read but not taken]

    def push(self, time: np.ndarray, values: np.ndarray) -> None:
        if not len(time):
            return
        m = np.empty(len(time), MESSAGE)
        m["time"], m["values"] = time, values
        self.held.append(m)
        self.size += len(m)
        if self.size > self.limit:
            run = _summed(self.held)
            self.held, self.size = [], 0
            f = tempfile.TemporaryFile()  # a task's own, gone with it
            f.write(run.tobytes())
            f.seek(0)
            self.runs.append([f, len(run), np.empty(0, MESSAGE)])

    def take(self, before: int) -> np.ndarray:
        """All messages for times below ``before``, by time."""
        out = []
        if self.held:
            held = np.concatenate(self.held)
            due = held["time"] < before
            out.append(held[due])
            self.held, self.size = [held[~due]], int((~due).sum())
        for run in self.runs:
            while True:
                f, left, read = run
                n = int(np.searchsorted(read["time"], before))
                out.append(read[:n])
                run[2] = read[n:]
                if len(run[2]) or not left:
                    break
                n = min(left, RUN_PIECE)
                run[2], run[1] = np.frombuffer(f.read(n * MESSAGE.itemsize), MESSAGE), left - n
        self.runs = [r for r in self.runs if r[1] or len(r[2])]
        return _summed(out)


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    m = np.concatenate(parts) if parts else np.empty(0, MESSAGE)
    if not len(m):
        return m
    m = m[np.argsort(m["time"], kind="stable")]
    first = np.flatnonzero(np.diff(m["time"], prepend=m["time"][0] - 1))
    out = np.empty(len(first), MESSAGE)
    out["time"], out["values"] = m["time"][first], np.add.reduceat(m["values"], first, axis=0)
    return out


def _parent_places(t: pd.DataFrame) -> np.ndarray:
    """Place of every row's parent among the rows; -1 where it is not here."""
    here = pd.MultiIndex.from_frame(t[KEY])
    asked = pd.MultiIndex.from_arrays([t["pdepth"], t["p0"], t["p1"]])
    return np.where(t["linked"], here.get_indexer(asked), -1)


def forward(t: pd.DataFrame, limit: int = QUEUE_MESSAGES) -> pd.DataFrame:
    """Totals over the subtrees that lie within the rows of ``t`` (``leaves``, ``saved``; and
    ``children``, summed over the children alone), and per row the address outside that the
    root above it sends to (``rdepth``, ``r0``, ``r1``, ``routed``).  ``e_*`` come in from elsewhere."""
    t = t.sort_values(["depth", "k0", "k1"], ascending=[False, True, True], ignore_index=True)  # reverse level order
    up = _parent_places(t)
    depth = t["depth"].to_numpy()
    own = np.stack([t["v_leaves"] + t["e_leaves"], t["v_saved"] + t["e_saved"], t["e_children"]], axis=1).astype(np.int64)
    ends = np.append(np.flatnonzero(np.diff(depth)) + 1, len(t)) if len(t) else np.zeros(0, int)
    queue, a = SpillingQueue(limit), 0
    for b in ends:
        m = queue.take(b)
        own[m["time"]] += m["values"]
        inner = np.flatnonzero(up[a:b] >= 0) + a
        queue.push(up[inner], np.stack([own[inner, 0], own[inner, 1], np.ones(len(inner), np.int64)], axis=1))
        a = b
    root = np.arange(len(t))
    for b, a in zip(ends[::-1], [*ends[-2::-1], 0], strict=True):  # level order: parents before children
        part = up[a:b]
        root[a:b] = np.where(part >= 0, root[part], root[a:b])
    out = t.assign(leaves=own[:, 0], saved=own[:, 1], children=own[:, 2], inner=up >= 0)
    out["parent_conv"] = t["conv_id"].to_numpy()[up] if len(t) else t["conv_id"]
    for name, col in (("rdepth", "pdepth"), ("r0", "p0"), ("r1", "p1"), ("routed", "linked")):
        out[name] = t[col].to_numpy()[root]
    return out


NODE = ["depth", "k0", "k1", "linked", "pdepth", "p0", "p1", "conv_id", "v_leaves", "v_saved"]
NODE_SCHEMA = ", ".join(f"{c} {'boolean' if c == 'linked' else 'long'}" for c in NODE)
DONE = ["leaves", "saved", "children", "inner", "parent_conv", "rdepth", "r0", "r1", "routed"]
SHARD_SCHEMA = NODE_SCHEMA + ", " + ", ".join(f"{c} {'boolean' if c in ('inner', 'routed') else 'long'}" for c in DONE) + ", shard long"


def _run_shard(t: pd.DataFrame, shard: int, limit: int) -> pa.RecordBatch:
    out = forward(t, limit).assign(shard=shard)
    return pa.RecordBatch.from_pandas(out[[*NODE, *DONE, "shard"]], preserve_index=False)


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        parts = [b for b in batches if b.num_rows]
        if parts:  # about a shard's nodes, by the range partitioning
            t = pa.Table.from_batches(parts).to_pandas()
            yield _run_shard(t.assign(e_leaves=0, e_saved=0, e_children=0), TaskContext.get().partitionId(), limit)
    return run


def _again(limit: int):
    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_run_shard(t.to_pandas(), t["shard"][0].as_py(), limit)])
    return run


def subtree_totals(nodes: DataFrame, shard_nodes: int = SHARD_NODES, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """``nodes`` (columns ``NODE``; ``linked``: has a parent) with ``leaves`` and ``saved`` summed
    over the subtree, ``children`` and ``parent_conv``."""
    n = nodes.count()
    whole = n <= shard_nodes
    nodes = nodes.select(NODE)
    dealt = nodes.repartition(1) if whole else nodes.repartitionByRange(-(-n // shard_nodes), "conv_id", "depth", "k0")
    out = written(dealt.mapInArrow(_shards(queue_messages), SHARD_SCHEMA), "shards")
    if whole:
        return out
    sent = out.where("linked and not inner").groupBy("pdepth", "p0", "p1").agg(
        F.sum("leaves").alias("v_leaves"), F.sum("saved").alias("v_saved"), F.count(F.lit(1)).alias("e_children"))
    sent = sent.toDF(*KEY, "v_leaves", "v_saved", "e_children")
    found = out.select(*KEY, "conv_id", F.col("rdepth").alias("pdepth"), F.col("r0").alias("p0"), F.col("r1").alias("p1"),
                       F.col("routed").alias("linked"))
    ports = written(join_small(found, sent, KEY), "ports")
    if ports.isEmpty():
        return out
    total = subtree_totals(ports, 2 * shard_nodes, queue_messages)
    total = total.select(*KEY, F.col("leaves").alias("e_leaves"), F.col("saved").alias("e_saved"))
    extra = ports.select(*KEY, "e_children", F.col("conv_id").alias("outer_conv")).join(total, KEY)
    extra = written(extra, "port-totals")
    zero = {c: 0 for c in ("e_leaves", "e_saved", "e_children")}
    again = join_small(out.select(*NODE, "shard"), extra.drop("outer_conv"), KEY, "left").fillna(zero)
    again = again.groupBy("shard").applyInArrow(_again(queue_messages), SHARD_SCHEMA)
    outer = extra.select(F.col("depth").alias("pdepth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), "outer_conv")
    again = join_small(again, outer, ["pdepth", "p0", "p1"], "left")
    return again.withColumn("parent_conv", F.when(F.col("inner"), F.col("parent_conv")).otherwise(F.col("outer_conv"))).drop("outer_conv")


# -- ends of the nodes ------------------------------------------------------

SEGMENT = "depth long, k0 long, k1 long, first long, ids string"


def _segments(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in range(3)])
        convs = b.column(3).to_pylist()
        cut = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
        at = np.unique(np.concatenate([[0], cut, np.arange(0, b.num_rows, SEGMENT_IDS)])).astype(np.int64)
        if b.num_rows:
            ids = [",".join(map(str, convs[x:y])) for x, y in zip(at, [*at[1:], b.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(keys[i][at]) for i in range(3)], b.column(3).take(pa.array(at)),
                                              pa.array(ids, pa.string())], ["depth", "k0", "k1", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]):
    key, h = None, None

    def row():
        return pa.RecordBatch.from_pylist([{**dict(zip(KEY, key, strict=True)), "ends_sha256": h.hexdigest()}])

    for b in batches:
        done = []
        for r in b.to_pylist():
            k = (r["depth"], r["k0"], r["k1"])
            if k != key:
                if key is not None:
                    done.append(row())
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(r["ids"].encode())
        yield from done
    if key is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending ``conv`` of every node key in ``ends``."""
    order = [*KEY, "conv"]
    parts = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, SEGMENT)
    streams = parts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return streams.mapInArrow(_digests, "depth long, k0 long, k1 long, ends_sha256 string")


# -- trie -------------------------------------------------------------------

def prefix_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    turns, convs = rebuilt_turns(conversations)
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), zero.alias("p0"), zero.alias("p1"), zero.alias("words"))
    nodes = turns.unionByName(root).groupBy(KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p0").alias("p0"), F.min("p1").alias("p1"),
        F.min("words").alias("words"))
    nodes = written(nodes, "nodes")
    inside = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).distinct()
    nodes = written(nodes.join(inside.withColumn("grows", F.lit(True)), KEY, "left"), "tree")
    tree = nodes.select(*KEY, (F.col("depth") > 0).alias("linked"), (F.col("depth") - 1).alias("pdepth"), "p0", "p1", "conv_id",
                        F.when(F.col("grows"), 0).otherwise(1).cast("long").alias("v_leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("v_saved"))
    total = subtree_totals(tree, shard_nodes, queue_messages)
    total = total.select(*KEY, F.when(F.col("linked"), F.col("parent_conv")).alias("parent_conv_id"), F.col("children").alias("n_children"),
                         F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    last = turns.join(convs.select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("conv", *KEY)
    ends = last.unionByName(root.join(convs.where("length = 0").select("conv"), "conv", "left_semi").select("conv", *KEY))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.select(*KEY, "conv_id", "n_convs").join(total, KEY).join(end_digests(ends), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text))) AS own,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM t GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.own, [])[1:xor(a.crc, 4294967295) % 4], a.own[xor(a.crc, 4294967295) % 4 + 1:]) AS p
  FROM conv a LEFT JOIN conv b ON b.c = a.c - a.c % 20),
prefix AS (SELECT c, p[1:d] AS p, d, len(p) = d AS ends FROM rebuilt, unnest(range(0, len(p) + 1)) AS x(d)),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
  FROM prefix GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (p)),
up AS (SELECT p[1:x.d] AS p, (n_children = 0)::BIGINT AS leaf, saved FROM full_node, unnest(range(0, full_node.d + 1)) AS x(d)),
total AS (SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY p)
SELECT f.conv_id, f.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
  f.n_children::BIGINT AS n_children, total.n_leaves::BIGINT AS n_leaves, total.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN total USING (p) LEFT JOIN node parent ON f.d > 0 AND parent.p = f.p[1:f.d - 1]
"""
