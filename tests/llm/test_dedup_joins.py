"""Operators on pairs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlift.llm import vecdedup
from adlift.llm.graph import connected_components
from adlift.llm.ngram_join import divide_skip, ngram_jaccard_components, required
from adlift.llm.vecdedup import vector_duplicates

SF = "/root/testdata/sf0.001"


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    base = "one two three four five six seven eight nine ten eleven twelve"
    extra = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Tiny text"), (9005, "tiny   TEXT"), (9006, base),
             (9007, base.upper() + " thirteen"), (9008, base + " thirteen fourteen"), (9009, "É " + base), (9010, base + " x y z w v u t")]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("n", F.lit(1)).withColumn("cls", F.lit("x"))
    rows = [(r["doc_id"], _shingles(r["text"])) for r in df.collect()]
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i]
             if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = _components([r[0] for r in rows], links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_components(df).collect()}
    assert got == {i: (len(s), want[i]) for i, s in rows}


def test_ngram_join_repeated_rows_nulls_and_empty(spark):
    t = "a b c d e f g"
    rows = [(1, t), (1, t), (None, t), (2, None), (None, None), (3, "other words that are here alone")]
    got = sorted(map(tuple, ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (2, 0, 2), (None, 0, None), (3, 2, 3)], key=repr)
    assert ngram_jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(50):
        q = np.unique(rng.integers(0, 120, 60).astype(np.uint64))
        sets = []
        for _ in range(20):
            keep = q[rng.random(len(q)) < rng.uniform(0.5, 1)]
            sets.append(np.unique(np.append(keep, rng.integers(0, 200, rng.integers(1, 20)).astype(np.uint64))))
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= required(len(q), len(s))]
        assert divide_skip(q, sets).tolist() == want


def test_vectors_match_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    v = rows[0][1]
    near = [x + 0.01 * (-1) ** i for i, x in enumerate(v)]
    rows += [(9001, v), (9002, [2 * x for x in v]), (9003, near), (9004, None), (9005, [0.0] * 64), (9006, [float("nan")] * 64),
             (9007, [None] * 64), (9008, [1.0, 0.0]), (9009, [1.0, 0.1]), (9010, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit("x"))
    unit = {}
    for i, x in rows:
        a = None if x is None or None in x else np.array(x, dtype=np.float32).astype(float)
        if a is not None and len(a) and np.isfinite(a).all() and a.any():
            unit[i] = a / np.linalg.norm(a)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want = _components([r[0] for r in rows], links)
    degree = {i: sum(i in p for p in links) for i, _ in rows}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_duplicates(df).collect()}
    assert got == {i: (degree[i], want[i], want[i] == i) for i, _ in rows}
    assert vector_duplicates(df.limit(0)).count() == 0


def test_no_link_is_lost_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 8)  # 500 cells
    monkeypatch.setattr(vecdedup, "FIT_ROWS", 1000)
    monkeypatch.setattr(vecdedup, "BLOCK_BYTES", 1 << 16)  # blocks of at most 128 vectors
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    cos = rng.uniform(0.9001, 0.91, len(x))[:, None]
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos ** 2) * z])
    both[3990:] = np.eye(64)[0] + 0.05 * rng.normal(size=(10, 64))  # a cluster
    unit = both / np.linalg.norm(both, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    want = _components(range(len(both)), [(a, b) for a, b in np.argwhere(link).tolist() if a < b])
    df = spark.createDataFrame(list(enumerate(both.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.vector_duplicates(df).collect()}
    assert got == {i: (int(link[i].sum()) - 1, want[i]) for i in want}


def test_cell_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "MIN_BLOCKS", 16)  # one cell of near copies is dealt over many blocks
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(32)[3] + 0.06 * rng.normal(size=(500, 32)), rng.normal(size=(60, 32))]).astype(np.float32)
    x[100:103] = x[0]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    want = _components(range(len(x)), [(a, b) for a, b in np.argwhere(link).tolist() if a < b])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_duplicates(df).collect()}
    assert got == {i: (int(link[i].sum()) - 1, want[i]) for i in want}


def test_blocks_hold_every_cell():
    sizes = np.array([3, 0, 5, 40, 2, 9, 9, 25, 0])
    b = vecdedup.Blocks(sizes, 10)
    assert all(b.lo[b.first[c]] <= c <= b.hi[b.first[c]] for c in range(len(sizes)))
    assert b.pieces.tolist() == [1, 1, 1, 4, 1, 1, 1, 3, 1]
    got = b.reached(np.eye(len(sizes), dtype=bool))
    for c in range(len(sizes)):
        assert np.flatnonzero(got[c]).tolist() == list(range(b.first[c], b.first[c] + b.pieces[c]))
    assert all(sizes[lo:hi + 1].sum() <= 10 for lo, hi in zip(b.lo, b.hi, strict=True) if lo < hi)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(None, 1), (5, None), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


@pytest.mark.parametrize("nx,ny", [(1, 1), (3, 4), (100, 75), (100, 134), (7, 9)])
def test_required_is_the_smallest_overlap(nx, ny):
    o = int(required(nx, ny))
    assert 100 * o >= 75 * (nx + ny - o) and 100 * (o - 1) < 75 * (nx + ny - o + 1)


def test_ngram_join_group_whose_hub_links_with_few(spark, monkeypatch):
    """300 near copies of a base text: two copies link where few words differ, the hub of a list may be far from most."""
    import random

    from adlift.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 4000)  # many pairs of blocks
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{i}-{j}" if j % 9 else base[j] for j in range(60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sets = [(d, _shingles(t)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 75 * len(x | y)]
    want = _components([d for d, _ in sets], links)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_components(df).collect()}
    assert got == want and len(set(want.values())) > 31


@pytest.mark.parametrize("pairs", [0, 1000])
def test_a_block_passes_pairs_or_members_and_loses_no_link(monkeypatch, pairs):
    import pyarrow as pa

    from adlift.llm import ngram_join
    monkeypatch.setattr(ngram_join, "PAIRS_A_MEMBER", pairs)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(200)[:rng.integers(150, 200)]], rng.integers(0, 2**63, 12).astype(np.uint64)])) for _ in range(40)]
    t = pa.table({"token": [7] * 40, "a": pa.array([0] * 40, pa.int32()), "b": pa.array([1] * 40, pa.int32()),
                  "block": pa.array([i % 2 for i in range(40)], pa.int32()), "cls": list(range(40)), "comp": [i if i > 3 else 0 for i in range(40)],
                  "n": pa.array([len(s) for s in sets], pa.int32()), "bits": [ngram_join._bitmap(s) for s in sets]})
    key = tuple(pa.scalar(x) for x in (7, 0, 1))
    links = [(i, j) for i in range(0, 40, 2) for j in range(1, 40, 2) if t["comp"][i] != t["comp"][j]
             and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    got = ngram_join._list_members(key, t)
    if pairs:
        found = list(zip(got["cls"].to_pylist(), got["other"].to_pylist()))
        assert {(min(x), max(x)) for x in links} <= set(found)
    else:
        assert got["other"].null_count == got.num_rows <= 40
        found = ngram_join._list_forest(key, got.drop_columns(["other"]).append_column("set", pa.array([sets[c].tobytes() for c in got["cls"].to_pylist()])))
        found = list(zip(found["u"].to_pylist(), found["v"].to_pylist()))
        assert len(found) < got.num_rows and {(min(x), max(x)) for x in found} <= {(min(x), max(x)) for x in links}
        start = [(i, 0) for i in range(4)]
        assert _components(range(40), found + start) == _components(range(40), links + start)
    assert links


def test_written_tables_leave_no_shuffle_files(spark):
    import glob

    from adlift.llm import store
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {p for d in dirs for p in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    df = spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = files(), spark.conf.get(store.CLEANUP)
    out = store.written(df, "counts")
    assert not files() - before and spark.conf.get(store.CLEANUP) == setting
    assert sorted(out.collect()) == sorted(df.collect())


def test_a_member_brings_its_bitmap_once_for_lists_of_one_passage(spark):
    """20 lists of one passage: each lacks another of its 40 members."""
    from adlift.llm import ngram_join
    rows = [(t, c, c, 90 + c) for t in range(20) for c in range(40) if c != t + 7] + [(50, c, c % 2, 100) for c in (3, 60, 61)]
    opened, lists = ngram_join.open_lists(spark.createDataFrame(rows, "token long, cls long, comp long, n int"))
    assert opened.count() == len(rows)
    joint = [tuple(r) for r in ngram_join.joint_lists(opened, lists).select("token", "cls", "comp", "n").collect()]
    of = {t: {(c, p, n) for x, c, p, n in joint if x == t} for t in {r[0] for r in joint}}
    assert len(joint) == 43 and sorted(map(len, of.values())) == [3, 40]
    assert all(any({r[1:] for r in rows if r[0] == t} <= g for g in of.values()) for t in range(20))


def test_hubs_are_known_within_a_bucket_and_pairs_that_share_little_wait(spark):
    import pyarrow as pa

    from adlift.llm import ngram_join
    tok = [5] * 3 + [9] * 2 + [11]
    cls = [30, 10, 20, 40, 10, 10]
    rare = [np.array(tok, np.uint32), np.array(cls, np.int64), np.array([100, 100, 104, 103, 100, 100], np.int32)]
    often = [np.array([77], np.int64), np.array([30], np.int64), np.array([100], np.int32)]
    names = ["tok", "cls", "n"]
    t = pa.table({"bucket": pa.array([2, 2], pa.int32()), "frequent": [False, True]}
                 | {c: [a.tobytes(), b.tobytes()] for c, a, b in zip(names, rare, often, strict=True)})
    got = ngram_join._lists(t)
    at = 2 << 32
    assert {tuple(r.values()) for r in got.to_pylist()} == {
        (at + 5, 10, 100, 10, 100), (at + 5, 20, 104, 10, 100), (at + 5, 30, 100, 10, 100), (at + 9, 10, 100, 10, 100),
        (at + 9, 40, 103, 10, 100), (77, 30, 100, None, None)}
    rows = [(t, c, 100, 1, 100) for c, k in ((1, 20), (2, 9), (3, 1)) for t in range(k)] + [(90 + t, c, 100, None, None) for t in range(9) for c in (1, 4)]
    df = spark.createDataFrame(rows, ngram_join.LIST_SCHEMA)
    assert {tuple(r) for r in ngram_join.hub_pairs(df).collect()} == {(1, 2), (1, 4)}


def test_a_class_meets_the_pivots_of_one_list(spark, monkeypatch):
    """Three passages that 40 classes share in 6, 4 and 2 lists: a class's pairs do not grow with its lists."""
    from adlift.llm import ngram_join
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rows = [(100 * p + t, c, c, 100) for p, lists in enumerate((6, 4, 2)) for t in range(lists) for c in range(p, 40 + p)]
    lone = [(900 + t, c, c, 100) for t in range(7) for c in (7, 70 + t)]
    opened, lists = ngram_join.open_lists(spark.createDataFrame(rows + lone, "token long, cls long, comp long, n int"))
    joint = ngram_join.joint_lists(opened, lists)
    passages = joint.groupBy("token").agg(F.count("*").alias("m")).where("m >= 40").select("token")
    assert passages.count() == 3
    pairs = [tuple(r) for r in ngram_join.pivot_pairs(joint, passages).collect()]
    met = {frozenset(p) for p in pairs}
    assert 0 < len(pairs) <= 3 * 42 and len({x for x, _ in pairs}) == 3
    assert {c for p in met for c in p} == set(range(40))  # 6 lists in common are enough of 12, 4 and 2 are not


def test_pivots_only_where_blocks_would_be_compared(spark, monkeypatch):
    """Near copies that one block holds are compared there at once, else pivots come first; no link is lost."""
    import random

    from adlift.llm import ngram_join
    rng = random.Random(4)
    rows = []
    for d in range(120):
        w = [f"w{d % 2}-{i}" for i in range(90)]
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((d, " ".join(w)))
    sets = [(d, _shingles(t)) for d, t in rows]
    want = _components([d for d, _ in sets], [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 75 * len(x | y)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    calls, pivots = [], ngram_join.pivot_pairs
    monkeypatch.setattr(ngram_join, "pivot_pairs", lambda *a: calls.append(1) or pivots(*a))
    for block, rounds in ((ngram_join.BLOCK_SHINGLES, 0), (1000, 1)):
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
        assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard_components(df).collect()} == want
        assert sum(calls) == rounds
    assert len(set(want.values())) > 2
