"""The conversation trie against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from adlift.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role.encode(), d, (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    members = {}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        block = c - int(np.fmod(c, 20))
        built[c] = own.get(block, [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = 0 if p in children else 1
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        total[p] = (leaves + sum(total[x][0] for x in children.get(p, [])), saved + sum(total[x][1] for x in children.get(p, [])))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *total[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def _trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, conv string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df.repartition(4), **how).collect()), key=repr)


def _rows(seed=1, n=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.randint(1, 6)):
            text = rng.choice(["hello there", "how are  you", "fine\tthanks", f"unique {c} {t}"])
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return rows


EDGES = ([(None, 0, "user", "lost"), (1000, None, None, None), (1000, 1, "user", "x"), (1000, 1, "user", "x"), (1000, 1, "tool", "b a"),
          (1001, 3, "user", ""), (1002, 0, "user", "y"), (1003, 0, None, "y"), (1019, 0, "user", "only"), (5555, 0, "user", "z")]
         + [(2000 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]
         + [(3001, t, "user", f"long {t}") for t in range(400)] + [(3002, 0, "user", "w " * 100_000)])


@pytest.mark.parametrize("how", [{}, {"shard_nodes": 40, "queue_messages": 3}])
def test_equals_a_plain_trie(spark, how):
    rows = _rows() + EDGES
    assert _trie(spark, rows, **how) == _plain(rows)


def test_hot_conversation_lies_over_many_chunks(spark):
    rows = [(7, t, "user", f"{t % 3}") for t in range(600)] + [(27, t, "user", f"{t % 3}") for t in range(400)] + _rows(3, 40)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _trie(spark, rows, shard_nodes=100) == _plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_tables(spark):
    assert _trie(spark, []) == [] and _trie(spark, [(None, 1, "user", "a")]) == []


def test_queue_takes_in_order_what_was_spilled():
    rng = np.random.default_rng(2)
    q, left = P.SpillingQueue(limit=10), {}
    for now in range(0, 400, 7):
        time = rng.integers(now, 500, 13)
        values = rng.integers(0, 9, (13, 3))
        q.push(time, values)
        for t, v in zip(time.tolist(), values, strict=True):
            left[t] = left.get(t, 0) + v
        due = sorted(t for t in left if t < now + 7)
        got = q.take(now + 7)
        assert got["time"].tolist() == due and (got["values"] == np.array([left.pop(t) for t in due]).reshape(-1, 3)).all()
    assert q.runs


def test_long_runs_of_ends_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_IDS", 7)
    rows = [(0, 1, 1, c) for c in range(1000)] + [(1, 1, 1, 5), (1, 1, 2, -5), (1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "depth long, k0 long, k1 long, conv long").repartition(5)
    got = {(r["depth"], r["k1"]): r["ends_sha256"] for r in P.end_digests(df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {(0, 1): sha(",".join(map(str, range(1000)))), (1, 1): sha("5"), (1, 2): sha("-5,3")}
