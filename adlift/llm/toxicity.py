"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words (and productive word stems)
whose documents are nearly all toxic.  Its trie is intersected with Levenshtein
automata - edits allowed grow with the entry's length - and the product is
determinised lazily: a state is the set of (trie node, edits) pairs still alive,
so a word is checked in one walk and most words die after two letters.

Each hit opens a window of words.  Quotation marks around it or a reporting word
beside it mark quotation, a second-person word marks abuse; the hit's weight is
scaled accordingly.  A logistic model over the window sums gives the score.

Training reads at most ``TRAIN_ROWS`` labelled rows (smallest hashes of the key;
a documented bound), near copies thinned by their smallest shingle.  Labels,
language, source and key never enter a score.

Edge cases: null or blank text -> no hits, the score of the intercept; labels
that are null are not used; no labels at all -> an empty lexicon and score 0.0 to
the prior; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm.textops import shingle_sets

TRAIN_ROWS = 20_000
MIN_TOXIC_DOCS = 8     # toxic training texts that hold an entry
MIN_PURITY = 0.9       # share of an entry's texts that are toxic (smoothed)
STEMS = (4, 5)         # stem lengths tried
MIN_STEM_WORDS = 4     # distinct words of a stem in toxic texts
WINDOW = 6
DFA_STATES = 200_000   # determinised states remembered by a worker
QUOTED_WEIGHT, DIRECT_WEIGHT, FUZZY_WEIGHT = 0.3, 1.5, 0.6

#: fixed values: words that report speech, words that address the reader, quotation marks
REPORTING = frozenset("said says wrote writes quoted quote called term word slur insult".split())
DIRECT = frozenset("you your you're youre u ur du dich dein tu te ton vous usted tú".split())
QUOTES = frozenset("\"“”„«»‹›‘")

_WORD = re.compile(r"[^\W\d_]+")


def allowed_edits(length: int) -> int:
    """Edits a lexicon entry of this length tolerates."""
    return 0 if length < 5 else 1 if length < 8 else 2


@dataclass
class FuzzyLexicon:
    """Lexicon trie x Levenshtein automata, determinised on demand."""

    entries: list[tuple[str, bool, float]]  # text, is a stem, weight
    states: list[frozenset] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.most: list[int] = [0]  # edits any entry below still tolerates
        for i, (text, stem, _) in enumerate(self.entries):
            node, k = 0, 0 if stem else allowed_edits(len(text))
            self.most[0] = max(self.most[0], k)
            for ch in text:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][ch] = nxt
                    self.children.append({}), self.word_at.append(-1), self.stem_at.append(-1), self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], k)
            (self.stem_at if stem else self.word_at)[node] = i
        self._reset()

    def __getstate__(self):
        return {"entries": self.entries}

    def __setstate__(self, s):
        self.entries, self.states = s["entries"], []
        self.__post_init__()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states, self.moves, self.ends = [], [], []
        self.start = self._state({(0, 0)})
        self.two: dict[str, int] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Id of the state, closed under letters missing from the word; -1 if dead."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            for c in self.children[node].values():
                if e < self.most[c] and (c, e + 1) not in pairs:
                    pairs.add((c, e + 1))
                    todo.append((c, e + 1))
        best: dict[int, int] = {}
        for node, e in pairs:
            best[node] = min(e, best.get(node, e))
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, -self.entries[self.word_at[n]][2], self.word_at[n]) for n, e in best.items()
                    if self.word_at[n] >= 0 and e <= allowed_edits(len(self.entries[self.word_at[n]][0]))]
            stems = [(0, -self.entries[self.stem_at[n]][2], self.stem_at[n]) for n, e in best.items()
                     if self.stem_at[n] >= 0 and e == 0]
            self.ends.append((min(ends, default=None), min(stems, default=None)))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            nxt = self.children[node].get(ch)
            if nxt is not None and e <= self.most[nxt]:
                pairs.add((nxt, e))
            if e < self.most[node]:
                pairs.add((node, e + 1))  # an extra letter in the word
            for c, n in self.children[node].items():
                if c != ch and e < self.most[n]:
                    pairs.add((n, e + 1))  # another letter
        out = self.moves[state][ch] = self._state(pairs)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the closest entry, the heaviest of ties, or None."""
        state, stem = self.start, None
        for ch in word:
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self._move(state, ch)
            if nxt < 0:
                return (stem[2], 0) if stem else None
            state = nxt
            stem = self.ends[state][1] or stem
        end = self.ends[state][0]
        if end and (not stem or end[0] == 0):
            return end[2], end[0]
        return (stem[2], 0) if stem else None

    def hits(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Distinct words that match."""
        if len(self.states) > DFA_STATES:
            self._reset()
        two, out = self.two, {}
        for w in set(words):
            head = w[:2]
            alive = two.get(head)
            if alive is None:
                s = self.start
                for ch in head:
                    s = self.moves[s][ch] if ch in self.moves[s] else self._move(s, ch)
                    if s < 0:
                        break
                alive = two[head] = s >= 0
            if alive and (m := self.match(w)):
                out[w] = m
        return out


FEATURES = ["abuse", "exact", "fuzzy1", "fuzzy2", "quoted", "any_exact", "some_exact", "density"]


def features(lex: FuzzyLexicon, text: str | None) -> list[float]:
    """Window sums of one text."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    found = lex.hits(words) if lex.entries else {}
    if not found:
        return [0.0] * len(FEATURES)
    spans = [m.span() for m in _WORD.finditer(low)]
    abuse, by_edits, quoted = 0.0, [0, 0, 0], 0
    for i, w in enumerate(words):
        m = found.get(w)
        if m is None:
            continue
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        near = words[a:b]
        before, after = low[spans[a][0]:spans[i][0]], low[spans[i][1]:spans[b - 1][1] + 1]
        in_quotes = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
        is_quoted = in_quotes or any(x in REPORTING for x in near)
        weight = lex.entries[m[0]][2] * FUZZY_WEIGHT ** m[1]
        weight *= QUOTED_WEIGHT if is_quoted else DIRECT_WEIGHT if any(x in DIRECT for x in near) else 1.0
        abuse += weight
        by_edits[min(m[1], 2)] += 1
        quoted += is_quoted
    return [math.log1p(abuse), math.log1p(by_edits[0]), math.log1p(by_edits[1]), math.log1p(by_edits[2]),
            math.log1p(quoted), float(by_edits[0] > 0), float(by_edits[0] > 1), math.log1p(100 * abuse / len(words))]


@dataclass
class ToxicityModel:
    lexicon: FuzzyLexicon
    coef: list[float]
    mean: list[float]
    scale: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.coef[0] + ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.coef[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _training_words(batches):
    for b in batches:
        word, toxic = [], []
        for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            ws = set(_WORD.findall((t or "").lower()))
            word += ws
            toxic += [y] * len(ws)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def _with_smallest_shingle(batches):
    for b in batches:
        low = [int(s[0]) % (1 << 62) if len(s) else 0 for s in shingle_sets(b.column("text"), 3)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int64())], [*b.schema.names, "low"])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids' texts ``(doc_id, text, toxic)``; of near copies that
    share the smallest shingle and label the one of the smallest (hash, doc_id) stays."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # <= rows x 12 bytes: broadcast is bounded
    j = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(lab), "doc_id").select("doc_id", "text", "toxic")
    first = F.min_by(F.struct("doc_id", "text"), F.struct(F.xxhash64("doc_id"), "doc_id", F.md5("text"))).alias("first")
    return j.mapInArrow(_with_smallest_shingle, "doc_id long, text string, toxic int, low long") \
        .groupBy("low", "toxic").agg(first).select("first.*", "toxic")


def learn_lexicon(sample: DataFrame) -> FuzzyLexicon:
    """Words and stems found nearly only in toxic texts, with log-odds weights.

    A word under a stem stays an entry: the stem has no edits, the word keeps its own."""
    n = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = n["t"] or 0, (n["n"] or 0) - (n["t"] or 0)
    if not toxic:
        return FuzzyLexicon([])
    w = sample.select("text", "toxic").mapInArrow(_training_words, "word string, toxic int")
    w = w.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t > 0 or c > 0")
    stems = w.select("t", "c", F.explode(F.array(*[
        F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS])).alias("stem")).where("stem is not null")
    stems = stems.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"),
                                      F.count_if(F.col("t") > 0).alias("kinds"))
    pure = (F.col("t") >= MIN_TOXIC_DOCS) & (F.col("t") >= MIN_PURITY * (F.col("t") + F.col("c") + 0.5))
    words = w.where(pure).select(F.col("word").alias("entry"), F.lit(False).alias("stem"), "t", "c")
    stems = stems.where(pure & (F.col("kinds") >= MIN_STEM_WORDS)).select(
        F.col("stem").alias("entry"), F.lit(True).alias("stem"), "t", "c")
    got = words.unionByName(stems).collect()  # each in at least MIN_TOXIC_DOCS of the bounded sample's texts
    stem_set = sorted({r["entry"] for r in got if r["stem"]}, key=len)
    stem_set = {s for s in stem_set if not any(s != o and s.startswith(o) for o in stem_set)}
    entries = []
    for r in sorted(got, key=lambda r: (r["entry"], r["stem"])):
        if r["stem"] and r["entry"] not in stem_set:  # a shorter stem matches all that it does
            continue
        odds = ((r["t"] + 0.5) / (toxic + 1)) / ((r["c"] + 0.5) / (clean + 1))
        entries.append((r["entry"], r["stem"], max(0.1, math.log(odds))))
    return FuzzyLexicon(entries)


def _feature_batches(lex):
    def run(batches):
        lx = lex.value
        for b in batches:
            x = [features(lx, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps for ridge logistic regression; the intercept is free."""
    a = np.hstack([np.ones((len(x), 1)), x])
    pen = np.diag([1e-6] + [ridge] * x.shape[1])
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pen, a.T @ (y - p) - pen @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn lexicon and weights from the labelled rows (bounded, see ``TRAIN_ROWS``)."""
    sample = training_sample(docs, labels, rows).checkpoint(eager=True)
    lex = learn_lexicon(sample)
    b = spark.sparkContext.broadcast(lex)
    got = sample.select("text", "toxic").mapInArrow(_feature_batches(b), "toxic int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = got.column("toxic").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # sums, and so the weights, do not depend on the order of tasks
    x, y = x[order], y[order]
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(FEATURES))
    coef = _logistic((x - mean) / scale, y) if len(x) and 0 < y.sum() < len(y) else np.array([-30.0] + [0.0] * len(FEATURES))
    return ToxicityModel(lex, coef.tolist(), mean.tolist(), scale.tolist())


def _score_batches(model):
    def run(batches):
        m = model.value
        for b in batches:
            x = np.array([features(m.lexicon, t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x))], ["doc_id", "score"])
    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text",
                   kind: str = "long") -> DataFrame:
    """``doc_id, score, predicted`` for every row, from its whole text alone; ``kind`` is the
    type of the key."""
    b = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(key).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_score_batches(b), f"doc_id {kind}, score double").select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key's text is divisible by 5; a null key is not held out."""
    return F.coalesce((F.crc32(F.col(key).cast("string")) % 5) == 0, F.lit(False))
