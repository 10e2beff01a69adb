"""Ranked search against a plain version."""

import math
import random
import re

import numpy as np

from adlift.llm import hybrid_rank as H

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def _plain(docs, items, k=20):
    words = [(d, _terms(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, w in words:
            m = 75 + 25 * len(w) * n_docs // n_terms
            s = 0
            for t in _terms(text):
                if tf := w.count(t):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def _ranked(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, score long, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, H.rank_documents(d, q, **how).collect()), key=repr)


def _corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["The", "de", "É9", "東京", "a-b"]
    rate = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, rate, k=rng.choice([3, 20, 60])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(25)]
    return docs, items


def test_equals_a_plain_search(spark, monkeypatch):
    docs, items = _corpus()
    docs += [(None, docs[0][1]), (None, None), (2000, None), (2001, ""), (2002, " .,\n\t"), (2003, "x" * 200_000), (2004, "w1 " * 30_000)]
    docs += [(3000 + i, "rare tie") for i in range(40)] + [(3000, "rare tie"), (None, "rare tie")]
    items += [(900, None), (901, ""), (902, "!!"), (903, "nowhere"), (904, "RARE tie tie"), (904, "w3"), (None, "w1 w2")]
    for limit, size in ((64, 128), (1024, 8192)):  # many ranges and blocks, then the usual ones
        monkeypatch.setattr(H, "RANGE_DOCS", limit)
        monkeypatch.setattr(H, "BLOCK_DOCS", size)
        monkeypatch.setattr(H, "FAN_IN", 2)
        assert _ranked(spark, docs, items) == _plain(docs, items)


def test_item_groups_give_the_same(spark):
    docs, items = _corpus(120, seed=2)
    assert _ranked(spark, docs, items, group_bytes=200, k=3) == _plain(docs, items, k=3)


def test_skipping_scores_few_documents_and_loses_none():
    rng = np.random.default_rng(4)
    n = 8192
    best, weights = H.Best(20), np.array([9000, 40, 30, 2500], np.int64)
    lists = [rng.choice(n, 900, False), np.arange(n), np.arange(0, n, 2), rng.choice(n, 60, False)]
    docs = np.concatenate([np.sort(x) for x in lists])
    row = {"ids": np.arange(n).astype("<i8").tobytes(), "known": np.ones(n, "u1").tobytes(), "lengths": np.full(n, 100, "<i8").tobytes(),
           "terms": [0, 1, 2, 3], "sizes": [len(x) for x in lists], "docs": docs.astype("<i4").tobytes(),
           "tfs": rng.integers(1, 9, len(docs)).astype("<i4").tobytes()}
    block = H.Postings(row, weights, n, 100 * n)
    looked = H.search_block(block, [(0, 1), (1, 1), (2, 2), (3, 1)], best)
    total = np.zeros(n, np.int64)
    for t, r in ((0, 1), (1, 1), (2, 2), (3, 1)):
        np.add.at(total, block.lists[t][0], block.lists[t][1] * r)
    top = np.lexsort((np.arange(n), -total))[:20]
    assert best.ids.tolist() == top.tolist() and best.scores.tolist() == total[top].tolist()
    assert looked < n // 4  # the two lists that all documents share are only probed


def test_empty_tables(spark):
    docs, items = _corpus(20)
    assert _ranked(spark, [], items) == [] and _ranked(spark, docs, []) == [] and _ranked(spark, [(1, None)], items) == []
    d = H.rank_documents(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert d.columns == ["item_id", "rank", "doc_id", "score"]
