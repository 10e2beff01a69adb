"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every text is measured once (Arrow + numpy, whole text).  Each measure of each
(language, source) feeds a log-linear histogram sketch: integer per-mille values
fall into buckets of relative width 1/32, and a sketch is its bucket counts, so
partial sketches merge by adding counts - between tasks, from (language, source)
to language, and from language to all.  Unlike sampled sketches the merge is
exact and independent of order, so verdicts never change between runs.

Thresholds replace fixed cutoffs: upper = q75 + SPREADS * max(q75 - q25, floor),
lower (mean word length) likewise from q25.  A group with fewer than MIN_GROUP
texts uses its language's sketch, a small language the overall one.  Texts are
then joined with their group's thresholds and filtered.

Edge cases: null or blank text -> all counts 0, ``base_failed`` true; null
language or source is a group of its own; repeated rows count each time; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlift.llm.store import written
from adlift.llm.textops import utf8_chunks, window_hashes, word_hashes, word_spans
from adlift.session import ensure_checkpoint_dir

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_GROUP = 50
SPREADS = 3
SUB_BUCKETS = 32
#: per measure: smallest spread used (per mille)
FLOORS = {"word_len": 500, "symbols": 100, "dup_lines": 100, "repeats": 50}

FEATURES = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, " \
           "n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return c[off[1:]] - c[off[:-1]]


def _repeat_words(win: np.ndarray) -> int:
    """Words covered by windows whose hash occurs twice or more."""
    s = np.sort(win)
    dup = s[1:][s[1:] == s[:-1]]
    if len(dup) == 0:
        return 0
    at = np.flatnonzero(np.isin(win, dup))
    edge = np.zeros(len(win) + WINDOW, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches):
    for b in batches:
        parts: list[np.ndarray] = []
        for i, j, data, off in utf8_chunks(b.column("text")):
            s, e, woff = word_spans(data, off)
            words = word_hashes(data, s, e, lower=False)
            win, win_off = window_hashes(words, woff, WINDOW)
            ink = np.zeros(len(data) + 1, dtype=np.int64)
            ink[s] += 1
            ink[e] -= 1
            in_word = np.cumsum(ink[:-1]).astype(bool)
            raw = data.tobytes()
            lines = [_lines(raw[off[r]:off[r + 1]]) for r in range(j - i)]
            rep = [_repeat_words(win[win_off[r]:win_off[r + 1]]) for r in range(j - i)]
            parts.append(np.stack([
                np.diff(woff), _per_text(in_word & ((data & 0xC0) != 0x80), off), _per_text(_SYMBOL[data], off),
                np.array([x[0] for x in lines]), np.array([x[1] for x in lines]), np.array(rep)]).astype(np.int64))
        m = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), np.int64)
        names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"),
                                          *[pa.array(x) for x in m]], ["doc_id", "lang", "source", *names])


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             source: str = "source") -> DataFrame:
    """One row of counts per text."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"),
                      F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_measure, FEATURES)


def _ratios() -> dict:
    def per_mille(a, b):
        return F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}"))
    return {"word_len": per_mille("word_chars", "n_words"), "symbols": per_mille("n_symbols", "n_words"),
            "dup_lines": per_mille("n_dup_lines", "n_lines"), "repeats": per_mille("n_repeat_words", "n_words")}


def _bucket(v):
    """Lower end of the log-linear bucket of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(v)) - len(bin(SUB_BUCKETS)[2:]), F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return v - v % step


def sketches(m: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, c)`` of all texts that pass the base rule."""
    r = _ratios()
    cols = F.array(*[F.struct(F.lit(n).alias("measure"), _bucket(v).alias("bucket")) for n, v in r.items()])
    return m.where(~base_failed()).select("lang", "source", F.explode(cols).alias("s")) \
        .groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count(F.lit(1)).alias("c"))


def merge(sketch: DataFrame, *groups: str) -> DataFrame:
    """Merge sketches to coarser groups: counts add."""
    return sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("c").alias("c"))


def quartiles(sketch: DataFrame, *groups: str) -> DataFrame:
    """Per group and measure: n, q25, q75 (bucket ends), from cumulative counts."""
    w = Window.partitionBy(*groups, "measure")
    c = sketch.withColumn("n", F.sum("c").over(w)).withColumn(
        "upto", F.sum("c").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = {q: F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("bucket"))) for q, k in (("q25", 1), ("q75", 3))}
    return c.groupBy(*groups, "measure").agg(F.max("n").alias("n"), *[v.alias(q) for q, v in at.items()])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): lower and upper limit of every measure."""
    fine = quartiles(sketch, "lang", "source")
    by_lang = quartiles(merge(sketch, "lang"), "lang").select(
        F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"),
        *[F.col(c).alias("l_" + c) for c in ("n", "q25", "q75")])
    whole = quartiles(merge(sketch)).select(F.col("measure").alias("a_measure"), F.col("q25").alias("a_q25"),
                                            F.col("q75").alias("a_q75"))
    t = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))) \
        .join(whole, F.col("measure") == F.col("a_measure"))
    q = {x: F.when(F.col("n") >= MIN_GROUP, F.col(x)).when(F.col("l_n") >= MIN_GROUP, F.col("l_" + x))
         .otherwise(F.col("a_" + x)) for x in ("q25", "q75")}
    floor = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in FLOORS.items()])
    spread = SPREADS * F.greatest(q["q75"] - q["q25"], floor)
    t = t.select("lang", "source", "measure", (q["q25"] - spread).alias("lo"), (q["q75"] + spread).alias("hi"))
    return t.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in FLOORS for e in ("lo", "hi")])


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                     source: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, and the names of the adaptive rules that failed."""
    ensure_checkpoint_dir(docs.sparkSession)
    m = written(measures(docs, key, text, lang, source), "measures")
    t = thresholds(written(sketches(m), "sketches")).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    j = m.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    rules = [F.when(v > F.col(f"{n}_hi"), F.lit(n)) for n, v in _ratios().items()]
    rules.append(F.when(_ratios()["word_len"] < F.col("word_len_lo"), F.lit("word_len")))
    j = j.withColumn("failed_rules", F.array_compact(F.array(*rules))).withColumn("base_failed", base_failed())
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
                    F.concat_ws(",", "failed_rules").alias("failed_rules"))
