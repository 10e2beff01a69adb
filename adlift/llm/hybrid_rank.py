"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

``rank_documents`` ranks all documents for every item and returns each item's ``k`` best.

1. One pass over the texts builds a posting index of the items' terms: a row per block of
   documents, in the shared folder.  The same rows give the collection's figures (documents
   with a term, words in all, documents per term).
2. Each task walks through its blocks with one list of ``k`` best per item, so what one block
   has reached prunes the next.  In a block an item's short lists are summed term at a time
   into accumulators; these then are one more iterator, bounded by their largest sum.  It and
   the long lists are walked document at a time, a range of documents per step.  A range is
   skipped if the bounds of its lists cannot reach the k-th score; otherwise the lists that
   a top document must be in (MaxScore) give candidates, and the others are only probed by
   binary search, as long as a candidate can still reach the k-th score.
3. The tasks' best are merged in rounds of at most ``FAN_IN`` partitions each.

Score, all in 64-bit integers: see the constants.  A document whose score equals the k-th
one is never pruned, so ties fall to the smaller doc_id.

Scale: the items are handled in groups of about ``GROUP_BYTES`` of text, one pass over the
documents for each, so what the driver and the tasks hold of them is bounded; of a task's
blocks one is in memory at a time, bounded in documents and postings.

Edge cases: a null or blank document has no terms, does not count and is never returned; an
item without terms, or whose terms no document holds, gives no row; rows that repeat a doc_id
are documents of their own, a null doc_id comes last among equal scores; each item row is
ranked for itself, also where item_ids repeat or are null; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlift.llm.store import written
from adlift.llm.textops import utf8_chunks

TOP = 20
GROUP_BYTES = 4 << 20     # text of the items handled together
BLOCK_DOCS = 8192         # documents of a block
BLOCK_POSTINGS = 1 << 20  # postings after which a block ends
RANGE_DOCS = 1024         # documents looked at in one step
SHORT_SHARE = 32          # a list is short up to block's documents / SHORT_SHARE
FAN_IN = 64
# score of a term in a document: weight * (TF_SCALE * tf div (1000 * tf + 12 * m)), m about 100 for a text of mean length
TF_SCALE, TF_STEP, LENGTH_STEP, LENGTH_BASE, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 12, 75, 25, 1000

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def text_terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Terms of a block of texts in order and their offsets per text: runs of ASCII letters,
    digits and all other characters from U+0080 on, A-Z in lower case."""
    ink = _WORD[data]
    begins = ink.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        begins[1:] &= ~ink[:-1] | edge[1:-1]
    at = np.flatnonzero(begins)
    kept = np.cumsum(ink)
    bounds = np.append(kept[at] - 1, kept[-1] if len(data) else 0).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[ink]])])
    return terms, np.searchsorted(at, off)


# -- index ------------------------------------------------------------------

INDEX = ("n_docs long, n_terms long, ids binary, known binary, lengths binary, terms array<int>, sizes array<int>, "
         "docs binary, tfs binary")


class _Block:
    """Postings of a block of documents, gathered chunk by chunk."""

    def __init__(self) -> None:
        self.ids, self.known, self.lengths, self.postings = [], [], [], []
        self.rows = self.size = 0

    def add(self, ids: pa.Array, data: np.ndarray, off: np.ndarray, vocabulary: pa.Array) -> None:
        terms, upto = text_terms(data, off)
        n = np.diff(upto)
        found = pc.index_in(terms, value_set=vocabulary)
        doc = np.repeat(np.arange(len(n)), n)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        term = found.fill_null(0).to_numpy()[hit].astype(np.int64)
        pairs, tf = np.unique(term * len(n) + doc[hit], return_counts=True)
        term, doc = np.divmod(pairs, max(len(n), 1))
        self.postings.append((term.astype(np.int32), (doc + self.rows).astype(np.int32), tf.astype(np.int32)))
        self.ids.append(ids.fill_null(0).to_numpy())
        self.known.append(ids.is_valid().to_numpy(zero_copy_only=False))
        self.lengths.append(n)
        self.rows += len(n)
        self.size += len(pairs)

    def row(self) -> pa.RecordBatch:
        ids, known, n = (np.concatenate(x) for x in (self.ids, self.known, self.lengths))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        used, doc = np.unique(doc, return_inverse=True)  # only documents with a posting can be returned
        order = np.lexsort((doc, term))
        terms, sizes = np.unique(term, return_counts=True)
        blob = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), blob(ids[used], "<i8"),
            blob(known[used], "u1"), blob(n[used], "<i8"), pa.array([terms.tolist()], pa.list_(pa.int32())),
            pa.array([sizes.tolist()], pa.list_(pa.int32())), blob(doc[order], "<i4"), blob(tf[order], "<i4")],
            ["n_docs", "n_terms", "ids", "known", "lengths", "terms", "sizes", "docs", "tfs"])


def _index(vocabulary: pa.Array):
    def run(batches):
        block = _Block()
        for b in batches:
            for i, j, data, off in utf8_chunks(b.column(1)):
                block.add(b.column(0).slice(i, j - i), data, off, vocabulary)
                if block.rows >= BLOCK_DOCS or block.size >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.rows:
            yield block.row()
    return run


# -- search -----------------------------------------------------------------

class Best:
    """The ``k`` highest (score, doc_id) met so far; equal scores by ascending doc_id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A document with a lower score cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        s, i, n = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.known, known)
        top = np.lexsort((i, ~n, -s))[:self.k]
        self.scores, self.ids, self.known = s[top], i[top], n[top]


class Postings:
    """A decoded block: per term its documents, their scores and the largest score per range."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], "u1").astype(bool)
        n = np.frombuffer(row["lengths"], "<i8")
        m = LENGTH_BASE + (LENGTH_SHARE * n * n_docs) // n_terms
        docs, tf = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tfs"], "<i4").astype(np.int64)
        sizes = np.array(row["sizes"], np.int64)
        score = np.repeat(weights[row["terms"]], sizes) * ((TF_SCALE * tf) // (TF_STEP * tf + LENGTH_STEP * m[docs]))
        ends = np.cumsum(sizes)
        self.lists = {t: (docs[b - s:b], score[b - s:b]) for t, s, b in zip(row["terms"], sizes.tolist(), ends.tolist(), strict=True)}
        self.ranges = -(-len(self.ids) // RANGE_DOCS)

    def bounds(self, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Largest score of a list in every range."""
        out = np.zeros(self.ranges, np.int64)
        np.maximum.at(out, docs // RANGE_DOCS, scores)
        return out


def search_block(block: Postings, query: list[tuple[int, int]], best: Best) -> int:
    """Add to ``best`` what the block holds for ``query`` (term, repeats); returns the
    number of documents that were scored."""
    lists = [(docs, scores * r) for t, r in query if t in block.lists for docs, scores in [block.lists[t]]]
    limit = len(block.ids) // SHORT_SHARE
    short, walked = [x for x in lists if len(x[0]) <= limit], [x for x in lists if len(x[0]) > limit]
    if short:  # term at a time: one accumulator per document of a short list
        docs, at = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([x[1] for x in short]))
        walked.append((docs, sums))
    if not walked:
        return 0
    bounds = np.array([block.bounds(*x) for x in walked])
    cuts = np.array([np.searchsorted(x[0], np.arange(block.ranges + 1) * RANGE_DOCS) for x in walked])
    reach, looked = bounds.sum(axis=0), 0
    for r in range(block.ranges):
        floor = best.floor
        if reach[r] < floor:
            continue
        order = np.argsort(bounds[:, r], kind="stable")
        upto = np.cumsum(bounds[order, r])  # reach of the lists so far, the weakest first
        first = int(np.searchsorted(upto, floor))  # a top document is in one of the lists from here on
        sums = np.zeros(RANGE_DOCS, np.int64)
        for x in order[first:]:
            a, b = cuts[x, r], cuts[x, r + 1]
            sums[walked[x][0][a:b] - r * RANGE_DOCS] += walked[x][1][a:b]
        docs = np.flatnonzero(sums)
        sums = sums[docs]
        for i in range(first - 1, -1, -1):
            able = sums + upto[i] >= floor
            docs, sums = docs[able], sums[able]
            a, b = cuts[order[i], r], cuts[order[i], r + 1]
            if a == b or not len(docs):
                continue
            where, what = walked[order[i]][0][a:b] - r * RANGE_DOCS, walked[order[i]][1][a:b]
            at = np.minimum(np.searchsorted(where, docs), b - a - 1)
            sums = sums + np.where(where[at] == docs, what[at], 0)
        looked += len(docs)
        able = sums >= floor
        if able.any():
            docs = docs[able] + r * RANGE_DOCS
            best.add(sums[able], block.ids[docs], block.known[docs])
    return looked


RESULT = "query int, item_id long, doc_id long, score long"


def _search(queries: list[tuple[int | None, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches):
        best = [Best(k) for _ in queries]
        for b in batches:
            for i in range(b.num_rows):
                block = Postings(b.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms)
                for (_, query), top in zip(queries, best, strict=True):
                    search_block(block, query, top)
        for q, ((item, _), top) in enumerate(zip(queries, best, strict=True)):
            n = len(top.scores)
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array([q] * n, pa.int32()), pa.array([item] * n, pa.int64()),
                    pa.array(top.ids, pa.int64(), mask=~top.known), pa.array(top.scores, pa.int64())],
                    ["query", "item_id", "doc_id", "score"])
    return run


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per query of rows of many partitions, in rounds."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = rows.rdd.getNumPartitions()
    part = F.spark_partition_id()
    while parts > FAN_IN:
        w = Window.partitionBy("query", "part").orderBy(*order)
        rows = rows.withColumn("part", F.floor(part / FAN_IN).cast("int"))
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
        part, parts = F.col("part"), -(-parts // FAN_IN)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _rank_group(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int) -> DataFrame | None:
    texts = pa.array([t for _, t in items], pa.large_binary())
    vocabulary, queries = {}, []
    for (item, _), (_, _, data, off) in zip(items, (c for i in range(len(items)) for c in utf8_chunks(texts.slice(i, 1).cast(pa.large_string()))), strict=True):
        terms, counts = np.unique(np.array(text_terms(data, off)[0].to_pylist(), object), return_counts=True)
        queries.append((item, [(vocabulary.setdefault(t, len(vocabulary)), int(n)) for t, n in zip(terms, counts, strict=True)]))
    if not vocabulary:
        return None
    index = written(docs.mapInArrow(_index(pa.array(list(vocabulary), pa.binary())), INDEX), "postings")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    if not total["l"]:
        return None
    sizes = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in sizes.collect():  # the terms of one group of items
        weights[r["terms"]] = math.floor(WEIGHT_SCALE * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    return _merge(index.mapInArrow(_search(queries, weights, total["n"], total["l"], k), RESULT), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` highest-scoring documents."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // group_bytes)
    out = []
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        rows = part.select("item", F.col("text").cast("binary")).sort("item", "text").collect()  # about group_bytes
        if rows:
            out.append(_rank_group(src, [(r[0], bytes(r[1])) for r in rows], k))
    out = [x for x in out if x is not None]
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


SQL = """
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
size AS (SELECT r, doc_id, count(*) AS n FROM words GROUP BY r, doc_id),
total AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM size),
tf AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, all_docs),
hit AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))) AS s
  FROM tf JOIN size USING (r) JOIN weight USING (term), total),
score AS (
  SELECT item_id, doc_id, r, sum(s)::BIGINT AS score FROM asked JOIN hit USING (term) GROUP BY item_id, doc_id, r HAVING sum(s) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM score QUALIFY rank <= 20
"""
