"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document's set is its distinct lower-cased 5-word shingles (64-bit hashes);
texts of 1-4 words give one shingle, blank or null texts an empty set that
links with nothing.  Two documents link when ``100 * |x & y| >= 75 * |x | y|``.

Plan, exact at every size:

1. Copies collapse first: documents with equal sets form a class (named by a 64-bit
   digest); everything below works on classes, so a group of copies costs one.
2. Linked sets must share one of their ``n - ceil(0.75 n) + 1`` rarest shingles
   (prefix filter).  Frequent shingles, found by lossy counting over all texts
   (at most ``1 / HEAVY_SHARE`` of them by construction), are ordered last, so
   common passages and phrases rarely form lists.  The order never changes the
   result, only the work.
3. Prefix shingles are dealt by hash into buckets of bounded size; lists held by
   one class alone vanish there.  Lists of frequent shingles stay plain rows.
4. Round one checks list members against their lists' hub (the smallest class): a group
   of m near copies costs about m checks, not m * m.  Then lists with the same members count
   once and lists of one hub and like length as one.  Round two checks the members of such
   lists that are still in different components against a few pivots, if a list is longer than
   a block, so that round three would compare pairs of its blocks.  A class meets the pivots of
   one list, so its rows are at most ``PIVOTS`` a class.  Both pass over
   pairs that share fewer lists than linked sets usually do.  Round three takes what is still open,
   where a member brings its bitmap once for joint lists, as pairs of blocks bounded in shingles.  Bitmaps choose the candidates; where they are few the pairs
   are checked, once for all lists, else the members bring their sets to the block, whose
   search gives a forest of links.  Either way rows grow with members, not their square.  Pairs already connected need no check, so components are exact.
5. A check is a bitmap bound on the overlap (exact upper bound), then
   T-occurrence search: the query's shingles select inverted lists over a block
   of candidate sets; the short lists are merged, the L longest are probed by
   binary search only for candidates that already reach T - L (DivideSkip).

Edge cases: null or blank text -> ``n_shingles`` 0 and ``component_id`` = own
doc_id; repeated rows and equal texts share a class and each input row gives one
output row; a null doc_id takes part and can take a component's id from others;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.graph import UnionFind, connected_components
from adlift.llm.store import written
from adlift.llm.textops import shingle_sets
from adlift.session import ensure_checkpoint_dir

SHINGLE_WORDS = 5
MIN_JACCARD = 75            # per cent
HEAVY_SHARE = 2e-6          # a shingle with this share of all shingles is ordered last
BUCKET_POSTINGS = 400_000   # prefix shingles per bucket
FLUSH_POSTINGS = 500_000  # postings packed at once in a task
BLOCK = 256                 # candidate sets per search block
BROADCAST_ROWS = 500_000    # doc_ids or pairs of classes (8, 16 bytes) sent to every task; more are shuffled
BLOCK_SHINGLES = 800_000    # shingles of the list members compared at once, about (at least one member)
PAIRS_A_MEMBER = 4          # candidate pairs a block may pass on per member; denser ones are searched in place
PIVOTS = 8                  # members of a list longer than a block that all others are compared with first
LONG_LIST_MU = 0.01         # DivideSkip: weight of log M in the number of long lists


def min_prefix(n: np.ndarray | int):
    """Prefix length: any linked set shares one of these many first shingles."""
    return n - (MIN_JACCARD * n + 99) // 100 + 1


def required(nx, ny):
    """Smallest overlap with 100 i >= 75 (nx + ny - i)."""
    return -(-MIN_JACCARD * (nx + ny) // (100 + MIN_JACCARD))


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set; sets are equal when their names are."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


MEMBER_SCHEMA = "token long, a int, b int, block int, cls long, comp long, n int, bits binary, other long"
SIGNATURE = "doc_id long, n int, cls long, bits binary, token long, c long"


def _signatures(k: int):
    """Per text its set's size, class and bitmap; per block of shingles those that are
    frequent in it, with counts, and the block's size (token null)."""
    def run(batches):
        def flush(sets):
            h = np.concatenate(sets)
            tokens, counts = np.unique(h, return_counts=True)
            keep = counts >= max(2, math.ceil(HEAVY_SHARE * len(h)))
            m = int(keep.sum()) + 1
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                 pa.array([*tokens[keep].view(np.int64).tolist(), None], pa.int64()),
                 pa.array([*counts[keep].tolist(), len(h)], pa.int64())], ["doc_id", "n", "cls", "bits", "token", "c"])

        held, size = [], 0
        for b in batches:
            n, cls, bits = [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                bits.append(_bitmap(s) if len(s) else None)
                held.append(s)
                size += len(s)
                if size >= 2 * FLUSH_POSTINGS:
                    yield flush(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary()),
                 pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n", "cls", "bits", "token", "c"])
        if size:
            yield flush(held)
    return run


def heavy_shingles(sig: DataFrame) -> np.ndarray:
    """Frequent shingles with counts, as a (2, m) array sorted by shingle.

    Lossy counting: each block of shingles reports those that reach
    ``HEAVY_SHARE`` of the block, so every shingle that reaches it overall is
    reported; of the summed counts those >= HEAVY_SHARE x total are kept, at most
    ``1 / HEAVY_SHARE`` rows whatever the input size."""
    total = sig.where("n is null and token is null").agg(F.sum("c")).first()[0] or 0
    sums = sig.where("token is not null").groupBy("token").agg(F.sum("c").alias("c"))
    got = sums.where(F.col("c") >= max(2, math.ceil(HEAVY_SHARE * total))).toArrow()
    tokens = got.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return np.vstack([tokens[order], got.column("c").to_numpy().astype(np.uint64)[order]])


def _ordered_prefix(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shingles in (frequency if frequent, hash) order, and their frequent flag."""
    p = int(min_prefix(len(s)))
    if heavy.shape[1] == 0:
        return s[:p], np.zeros(p, dtype=bool)
    at = np.minimum(np.searchsorted(heavy[0], s), heavy.shape[1] - 1)
    freq = np.where(heavy[0][at] == s, heavy[1][at], 0)
    if not freq.any():
        return s[:p], np.zeros(p, dtype=bool)
    order = np.argsort(freq, kind="stable")[:p]
    return s[order], freq[order] > 0


def _postings(k: int, heavy, buckets: int):
    """Postings of the prefix shingles, packed by bucket.  Rarer shingles go to bucket
    shingle modulo ``buckets`` (their quotient's low 32 bits name them there - a chance
    collision only adds a candidate).  Frequent ones keep their hash and are dealt by
    class, so none of their lists meets in one task.  A task's copies of one class are
    packed once per block."""
    def pack(tok, cls, n, bucket, frequent):
        order = np.argsort(bucket, kind="stable")
        ids, first = np.unique(bucket[order], return_index=True)
        cut = np.append(first, len(tok))
        parts = [[a[order][cut[i]:cut[i + 1]].tobytes() for i in range(len(ids))] for a in (tok, cls, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int32)), pa.array([frequent] * len(ids), pa.bool_()),
             *[pa.array(p, pa.binary()) for p in parts]], ["bucket", "frequent", "tok", "cls", "n"])

    def flush(held):
        for rows, frequent in zip(zip(*held, strict=True), (False, True), strict=True):
            size = [len(t) for t, _, _ in rows]
            tok = np.concatenate([t for t, _, _ in rows])
            cls = np.repeat(np.array([c for _, c, _ in rows], dtype=np.int64), size)
            n = np.repeat(np.array([x for _, _, x in rows], dtype=np.int32), size)
            if frequent:
                yield pack(tok, cls, n, cls % buckets, True)
            else:
                yield pack((tok // np.uint64(buckets)).astype(np.uint32), cls, n, tok % np.uint64(buckets), False)

    def run(batches):
        hv = heavy.value
        held, size, seen = [], 0, set()
        for b in batches:
            for s in shingle_sets(b.column(0), k):
                if len(s) == 0 or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                t, f = _ordered_prefix(s, hv)
                held.append(((t[~f], c, len(s)), (t[f], c, len(s))))
                size += len(t)
                if size >= FLUSH_POSTINGS:
                    yield from flush(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from flush(held)
    return run


POSTINGS = "bucket int, frequent boolean, tok binary, cls binary, n binary"
LIST_SCHEMA = "token long, cls long, n int, hub long, hub_n int"


def _unpack(t: pa.Table, token_type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
                 for c, kind in (("tok", token_type), ("cls", np.int64), ("n", np.int32)))


def _lists(t: pa.Table) -> pa.Table:
    """Of one bucket: postings of rarer shingles that two classes of fitting size hold, with
    their list's hub, and the postings of frequent shingles (hub null: other buckets hold
    more of their lists), each once."""
    c_tok, c_cls, c_n = _unpack(t.filter(t.column("frequent")), np.int64)
    order = np.lexsort((c_cls, c_tok))
    c_tok, c_cls, c_n = c_tok[order], c_cls[order], c_n[order]
    new = np.ones(len(c_tok), dtype=bool)
    new[1:] = (c_tok[1:] != c_tok[:-1]) | (c_cls[1:] != c_cls[:-1])
    c_tok, c_cls, c_n = c_tok[new], c_cls[new], c_n[new]
    tok, cls, n = _unpack(t.filter(pc.invert(t.column("frequent"))), np.uint32)
    order = np.lexsort((cls, n, tok))
    tok, cls, n = tok[order], cls[order], n[order]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])  # copies met in several tasks
    tok, cls, n = tok[new], cls[new], n[new]
    fits = (tok[1:] == tok[:-1]) & (100 * n[:-1].astype(np.int64) >= MIN_JACCARD * n[1:].astype(np.int64))
    keep = np.zeros(len(tok), dtype=bool)  # neighbours by size within a list: the nearest size decides
    keep[1:] |= fits
    keep[:-1] |= fits
    bucket = int(t.column("bucket")[0].as_py()) if t.num_rows else 0
    tok, cls, n = tok[keep], cls[keep], n[keep]
    first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])[:len(tok)])
    at = np.lexsort((cls, tok))[first]  # of each list the smallest class
    length = np.diff(np.append(first, len(tok)))
    hub, hub_n = (pa.concat_arrays([pa.array(np.repeat(v[at], length), kind), pa.nulls(len(c_tok), kind)])
                  for v, kind in ((cls, pa.int64()), (n, pa.int32())))
    return pa.table({"token": np.concatenate([(bucket << 32) + tok.astype(np.int64), c_tok]),
                     "cls": np.concatenate([cls, c_cls]), "n": np.concatenate([n, c_n]), "hub": hub, "hub_n": hub_n})


def _bitmap(s: np.ndarray) -> bytes:
    """XOR bitmap of a set, a power of two of bits, at least n."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    slot = (s >> np.uint64(20)) & np.uint64(bits - 1)
    parity = np.bincount(slot.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    """Halve a bitmap (slots are taken modulo the size) until ``size`` bytes are left."""
    while len(b) > size:
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return b


def _full_sets(k: int):
    def run(batches):
        for b in batches:
            cls, sets = [], []
            for s in shingle_sets(b.column("text"), k):
                if len(s):
                    cls.append(class_of(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "set"])
    return run


def _bitmap_filter(batches):
    """Keep pairs whose overlap bound (nx + ny - |bits differ|) / 2 reaches the need."""
    for b in batches:
        nx, ny = (b.column(c).to_numpy().astype(np.int64) for c in ("nx", "ny"))
        diff = np.zeros(b.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(b.column("bx").to_pylist(), b.column("by").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            diff[i] = int.from_bytes((_fold(x, size) ^ _fold(y, size)).tobytes(), "little").bit_count()
        ok = pa.array((nx + ny - diff) // 2 >= required(nx, ny))
        yield b.select(["x", "y"]).filter(ok)


def _block_candidates(key: tuple[pa.Scalar, ...], t: pa.Table):
    """Within the pair of blocks ``key`` of one list: per left row the right rows in other
    components whose bitmap bound reaches the need."""
    _, a, b = (x.as_py() for x in key)
    blk, cls, comp = (t.column(c).to_numpy() for c in ("block", "cls", "comp"))
    n = t.column("n").to_numpy().astype(np.int64)
    raw = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
    size = np.array([len(x) for x in raw])
    folded = {w: np.stack([_fold(x, w) if len(x) >= w else np.zeros(w, np.uint64) for x in raw]) for w in np.unique(size)}
    right = np.flatnonzero(blk == b)
    for i in np.flatnonzero(blk == a):
        j = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= MIN_JACCARD * np.maximum(n[right], n[i]))]
        j = j[cls[j] > cls[i]] if a == b else j
        found = []
        for w in np.unique(np.minimum(size[j], size[i])):
            k = j[np.minimum(size[j], size[i]) == w]
            diff = np.bitwise_count(folded[w][k] ^ folded[w][i]).sum(axis=1, dtype=np.int64)
            found.append(k[(n[i] + n[k] - diff) // 2 >= required(n[i], n[k])])
        if found and len(k := np.concatenate(found)):
            yield i, k


def _list_members(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """What a pair of blocks leaves to check, at most ``PAIRS_A_MEMBER`` rows a member: its
    candidate pairs (``cls``, ``other``), or, where they are more, the members that have
    candidates (``other`` null)."""
    cls = t.column("cls").to_numpy()
    some, x, y, n = np.zeros(t.num_rows, dtype=bool), [], [], 0
    for i, k in _block_candidates(key, t):
        some[i] = some[k] = True
        n += len(k)
        if n <= PAIRS_A_MEMBER * t.num_rows:
            x.append(np.full(len(k), cls[i]))
            y.append(cls[k])
    names = ["token", "a", "b", "block", "cls", "comp", "n", "bits"]
    if n <= PAIRS_A_MEMBER * int(some.sum()):
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
        nothing = {c: pa.nulls(len(x), t.schema.field(c).type) for c in names}
        return pa.table(nothing | {"cls": np.minimum(x, y), "other": np.maximum(x, y)})
    t = t.filter(pa.array(some)).select(names)
    return t.append_column("other", pa.nulls(t.num_rows, pa.int64()))


def _list_forest(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Search within a pair of blocks with the whole sets at hand; of the links found those
    that join what was not yet joined: fewer than members."""
    sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    cls, comp = t.column("cls").to_pylist(), t.column("comp").to_pylist()
    joined, u, v = UnionFind(), [], []
    for i, k in _block_candidates(key, t):
        k = [j for j in k.tolist() if joined.find(comp[j]) != joined.find(comp[i])]
        if not k:
            continue
        for hit in divide_skip(sets[i], [sets[j] for j in k]).tolist():
            if joined.union(comp[i], comp[k[hit]]):
                u.append(cls[i])
                v.append(cls[k[hit]])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Indexes of the sets whose overlap with ``query`` reaches ``required``.

    Inverted lists (query shingle -> ascending set indexes) are split: the L
    longest are set aside, the others merged into occurrence counts; sets whose
    count reaches T - L are looked up in the long lists by binary search."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    need = required(len(query), sizes)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # merge of runs: owners stay ascending in each list
    owner = owner[order]
    lengths = np.bincount(at, minlength=len(query))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    longest = int(lengths.max(initial=0))
    n_long = min(int(need.min() / (LONG_LIST_MU * math.log2(longest + 1) * len(query) + 1)), len(query)) if longest else 0
    by_length = np.argsort(lengths, kind="stable")
    long_ids = by_length[len(query) - n_long:]
    is_long = np.zeros(len(query), dtype=bool)
    is_long[long_ids] = True
    counts = np.bincount(owner[~np.repeat(is_long, lengths)], minlength=len(sets))
    cand = np.flatnonzero(counts >= need - n_long)
    for q in long_ids:
        if len(cand) == 0:
            break
        lst = owner[bounds[q]:bounds[q + 1]]
        if len(lst):
            pos = np.minimum(np.searchsorted(lst, cand), len(lst) - 1)
            counts[cand[lst[pos] == cand]] += 1
    return cand[counts[cand] >= need[cand]]


def _search(left: pa.Table, right: pa.Table) -> pa.Table:
    """One query class against one block of candidate classes."""
    if left.num_rows == 0 or right.num_rows == 0:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    query = np.frombuffer(left.column("query_set")[0].as_py(), np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in right.column("set").to_pylist()]
    found = right.column("y").to_numpy()[divide_skip(query, sets)]
    return pa.table({"u": np.full(len(found), left.column("query")[0].as_py(), dtype=np.int64), "v": found})


def bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs ``(x, y)`` that pass the bitmap bound."""
    pairs = written(pairs, "candidates")
    ids, bits = _small(pairs), classes.select("cls", "n", "bits")
    p = bits.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx")).join(ids(pairs), "x")
    y = bits.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    p = p.join(y.join(ids(pairs.select("y").distinct()), "y", "left_semi"), "y")
    return p.select("x", "y", "nx", "ny", "bx", "by").mapInArrow(_bitmap_filter, "x long, y long")


def _small(rows: DataFrame):
    """How a join takes these rows of ids: sent to every task if they are few."""
    return F.broadcast if rows.count() <= BROADCAST_ROWS else lambda d: d


def _fits(n, m):
    """Whether sets of n and m shingles may link."""
    return F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * MIN_JACCARD


def _share_many(n, m, lists):
    """Whether so many lists are at least half those that linked sets of n and m shingles
    share: their overlap less the longer one's suffix."""
    least, most = (f(n, m).cast("long") for f in (F.least, F.greatest))
    need = F.ceil(MIN_JACCARD * (least + most) / (100 + MIN_JACCARD)) - F.ceil(MIN_JACCARD * most / 100) + 1
    return lists * 2 >= need


def sharing(met: DataFrame) -> DataFrame:
    """Of ``(x, y, n, m, lists)``, classes of n and m shingles met in so many lists, the pairs of
    fitting size that share many lists.  Some lists of a pair may not be told here, so a pair
    left out may still be linked."""
    met = met.where(_fits("n", "m")).groupBy("x", "y").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.sum("lists").alias("lists"))
    return met.where(_share_many("n", "m", F.col("lists"))).select("x", "y")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Members with the hub of their lists, ``(x, y)``, that share many of its lists."""
    known = lists.where("hub is not null")
    common = lists.where("hub is null").select("token", "cls", "n")
    hubs = common.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("h")).select(
        "token", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"))
    listed = known.union(common.join(hubs, "token").select(*known.columns)).where("cls <> hub")
    return sharing(listed.select(F.col("hub").alias("x"), F.col("cls").alias("y"), "n", F.col("hub_n").alias("m"), F.lit(1).alias("lists")))


def open_lists(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the lists ``(token, cls, comp, n)`` those whose members are in different components,
    lists with the same members once: their members, and ``(token, m, shingles, hub, lists)``."""
    lists = rest.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.min("cls").alias("hub"), F.bit_xor(F.xxhash64("cls")).alias("g"),
        F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi") \
        .groupBy("m", "shingles", "hub", "g", "h").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("lists")) \
        .select("token", "m", "shingles", "hub", "lists")
    lists = written(lists, "open")
    return written(rest.join(_small(lists)(lists.select("token")), "token", "left_semi"), "opened"), lists


def joint_lists(rest: DataFrame, lists: DataFrame) -> DataFrame:
    """``(token, cls, comp, n, lists)`` with lists of one hub and like length taken as one: lists of
    one passage have nearly the same members, which are in the joint list once, with the
    number of its lists that hold them."""
    joint = lists.select("token", "lists", F.xxhash64("hub", F.floor(F.log2("m"))).alias("joint"))
    rest = rest.join(_small(lists)(joint), "token").groupBy(F.col("joint").alias("token"), "cls", "comp", "n").agg(F.sum("lists").alias("lists"))
    return written(rest, "joint")


def list_blocks(joint: DataFrame) -> DataFrame:
    """``(token, nb)``: in how many blocks of about ``BLOCK_SHINGLES`` a joint list is dealt."""
    return written(joint.groupBy("token").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("nb")), "blocks")


def pivot_pairs(joint: DataFrame, long: DataFrame) -> DataFrame:
    """Members of the long joint lists, ``(token)``, against their list's pivots, the members with the
    smallest hashes.  A class is in one list here, the one that stands for most of those that hold
    it, so there are at most ``PIVOTS`` rows a class; of them the join makes those that may share
    many lists, at most as many as either is in."""
    d = joint.join(_small(long)(long.select("token")), "token", "left_semi")
    d = d.groupBy("cls").agg(F.max(F.struct("lists", "token", "comp", "n")).alias("d")).select("cls", "d.*")
    d = written(d, "main")
    lowest = [F.min(F.struct(F.xxhash64(F.lit(i), "cls").alias("h"), "cls", "comp", "n", "lists")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = d.groupBy("token").agg(*lowest).select("token", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("p"))
    pivots = written(pivots.select("token", "p.cls", "p.comp", "p.n", "p.lists").distinct().toDF("token", "x", "x_comp", "m", "x_lists"), "pivots")
    near = (F.col("comp") != F.col("x_comp")) & _fits("n", "m") & _share_many("n", "m", F.least("lists", "x_lists"))
    return d.join(_small(pivots)(pivots), "token").where(near).select("x", F.col("cls").alias("y"))


def cross_links(joint: DataFrame, blocks: DataFrame, src: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Links between members of one joint list in different components, as forests.  A list is
    dealt as pairs of its blocks.  Bitmaps choose candidates; few pairs
    are checked once for all lists, in dense blocks the members bring their sets."""
    d = joint.join(_small(blocks)(blocks), "token").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    d = d.join(classes.select("cls", "bits"), "cls")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    d = d.select("token", "block", other.alias("o"), "cls", "comp", "n", "bits") \
        .withColumn("a", F.least("block", "o")).withColumn("b", F.greatest("block", "o")).drop("o")
    d = d.groupBy("token", "a", "b").applyInArrow(_list_members, MEMBER_SCHEMA)
    d = written(d, "members")
    few = d.where("other is not null").select(F.col("cls").alias("x"), F.col("other").alias("y")).distinct()
    many = d.where("other is null").drop("other")
    sets = class_sets(many.select("cls").distinct(), src, classes, k)
    many = many.join(sets, "cls").groupBy("token", "a", "b").applyInArrow(_list_forest, "u long, v long")
    return verified_links(few, src, classes, k).union(many)


def class_sets(wanted: DataFrame, src: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``(cls, set)`` of the wanted classes, from their smallest document's text."""
    texts = written(classes.join(wanted, "cls", "left_semi").select("rep", "cls"), "wanted")
    reps = texts.select("rep").distinct()
    if texts.count() <= BROADCAST_ROWS:
        reps = F.broadcast(reps)
    sets = src.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = sets.mapInArrow(_full_sets(k), "cls long, set binary")
    # a doc_id on several rows may bring other classes, or one class twice
    return written(sets.join(texts.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def verified_links(pairs: DataFrame, src: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Links ``(u, v)`` among candidate pairs ``(x, y)`` of classes."""
    p = written(pairs, "pairs")
    ids = _small(p)
    sets = class_sets(p.select(F.col("x").alias("cls")).union(p.select(F.col("y").alias("cls"))).distinct(), src, classes, k)
    # a query with many candidates is dealt over several blocks, its set once to each
    blocks = p.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    cand = p.join(blocks, "x").withColumn("block", F.pmod(F.xxhash64("y"), F.col("nb")).cast("int"))
    cand = ids(cand.select("x", "block", "y")).join(sets.select(F.col("cls").alias("y"), "set"), "y") \
        .select(F.col("x").alias("x"), F.col("block").alias("block"), F.col("y").alias("y"), F.col("set").alias("set"))
    query = ids(blocks).join(sets.select(F.col("cls").alias("x"), "set"), "x")
    query = query.select(F.col("x").alias("query"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part"),
                         F.col("set").alias("query_set"))
    return query.groupBy("query", "part").cogroup(cand.groupBy("x", "block")).applyInArrow(_search, "u long, v long")


def _still_open(rest: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists that hold more than one component: their members with components, and the lists."""
    rest = rest.join(comp, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    return open_lists(written(rest, "rest"))


def ngram_jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                             k: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = written(src.mapInArrow(_signatures(k), SIGNATURE), "signatures")
    heavy = spark.sparkContext.broadcast(heavy_shingles(sig))  # at most 1 / HEAVY_SHARE shingles
    texts = sig.where("n is not null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("cls").alias("c"))
    classes = written(sig.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")

    total = classes.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    buckets = max(1, int(total // BUCKET_POSTINGS))
    posted = src.select("text").mapInArrow(_postings(k, heavy, buckets), POSTINGS)
    lists = written(posted.groupBy("bucket").applyInArrow(_lists, LIST_SCHEMA), "lists")

    links = written(verified_links(bounded_pairs(hub_pairs(lists), classes), src, classes, k), "links1")
    comp = written(connected_components(links), "comp1")

    # members of one list still in different components: against pivots where several blocks
    # would be compared, then all that is left
    opened, todo = _still_open(lists.select("token", "cls", "n"), comp)
    joint = joint_lists(opened, todo)
    blocks = list_blocks(joint)
    long = blocks.where("nb > 1")
    if long.count():
        more = written(verified_links(bounded_pairs(pivot_pairs(joint, long), classes), src, classes, k), "links2")
        links = links.union(more)
        comp = written(connected_components(links), "comp2")
        joint = joint_lists(*_still_open(opened.drop("comp"), comp))  # a closed list stays closed
        blocks = list_blocks(joint)
    links = links.union(written(cross_links(joint, blocks, src, classes, k), "links3"))
    comp = written(connected_components(links), "comp3")

    named = classes.select("cls", "rep").join(comp, F.col("cls") == F.col("node"), "left") \
        .select("cls", "rep", F.coalesce("component", "cls").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "comp").select("cls", "component_id")
    out = texts.join(named, F.col("c") == F.col("cls"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
