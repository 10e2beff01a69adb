"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language are fused in log space:

* text: byte-trigram likelihoods (hashed), tempered so that a long text counts as
  at most ``TEXT_WEIGHT`` independent trigrams;
* declared markup language: P(declared | language), learned by grouped sums of
  text posteriors per declared value;
* address suffix: P(suffix | language), likewise;
* host prior: P(language | host), smoothed towards its domain and that towards
  the whole collection, each level a grouped sum; a text's own posterior is taken
  out of its host's sums before use.

The trigram model is fitted on at most ``TRAIN_ROWS`` labelled texts (documented
bound, smallest hashes of the key).  The text pass is numpy over Arrow; all else
is grouped aggregation and joins on slim rows, so a hot host only adds partial
sums and its join is split by Spark's skew handling.

Edge cases: null or empty text has no text evidence; a null declared value, host
or suffix gives no evidence of that kind; ties go to the first language in
alphabetical order; repeated rows give a row each; empty tables an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.store import written
from adlift.llm.textops import utf8_chunks
from adlift.session import ensure_checkpoint_dir

TRAIN_ROWS = 8_000
GRAMS = 1 << 16
TEXT_WEIGHT = 60.0     # trigrams a long text counts as
SMOOTH = 0.5           # added to every trigram count
VALUE_SMOOTH = 1.0     # added to every (value, language) sum
HOST_STRENGTH = 20.0   # pseudo rows of the level above
MIN_CONFIDENCE = 0.5
MAX_MISFIT = 3.0       # nats a trigram below what is usual in the language: none of these languages

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


@dataclass
class TrigramModel:
    langs: list[str]
    logp: np.ndarray  # (len(langs), GRAMS) float32
    usual: np.ndarray  # mean log-likelihood of a training trigram of each language


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of a block and their per-text offsets (none cross texts)."""
    b = _LOWER[data]
    n = len(b)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    ok = np.ones(n - 2, dtype=bool)
    for k in (1, 2):  # positions whose trigram would run into the next text
        ends = off[1:-1] - k
        ok[ends[(ends >= 0) & (ends < n - 2)]] = False
    pos = np.flatnonzero(ok)
    return code[pos].astype(np.int64), np.searchsorted(pos, off)


def _count_grams(batches):
    for b in batches:
        counts: dict[str, np.ndarray] = {}
        langs = b.column("lang").to_pylist()
        for i, j, data, off in utf8_chunks(b.column("text")):
            g, go = _grams(data, off)
            for r in range(j - i):
                c = counts.setdefault(langs[i + r], np.zeros(GRAMS, np.int64))
                c += np.bincount(g[go[r]:go[r + 1]], minlength=GRAMS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])],
                                             ["lang", "gram", "c"])


def fit_trigrams(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                 rows: int = TRAIN_ROWS) -> TrigramModel:
    """Trigram model from a bounded sample of labelled texts; the sums are at most
    GRAMS x languages rows."""
    src = docs.where(F.col(lang).isNotNull())
    n = src.count()
    every = max(1, n // rows)
    sample = src.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    got = sample.mapInArrow(_count_grams, "lang string, gram long, c long").groupBy("lang", "gram").agg(
        F.sum("c").alias("c")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.full((len(langs), GRAMS), SMOOTH)
    counts[[at[x] for x in got.column("lang").to_pylist()], got.column("gram").to_numpy()] += got.column("c").to_numpy()
    logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    usual = ((counts - SMOOTH) * logp).sum(axis=1) / np.maximum((counts - SMOOTH).sum(axis=1), 1)
    return TrigramModel(langs, logp.astype(np.float32), usual)


_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)


def visible_text(page: str | None) -> str:
    """Markup taken out, entities decoded."""
    return html.unescape(_MARKUP.sub(" ", page or ""))


def _text_evidence(model, markup: bool):
    def run(batches):
        m: TrigramModel = model.value
        L = len(m.langs)
        for b in batches:
            col = b.column("text")
            if markup:
                col = pa.array([visible_text(x) for x in col.to_pylist()], pa.string())
            out, fit, got = np.zeros((b.num_rows, L)), np.zeros((b.num_rows, L)), np.zeros(b.num_rows, dtype=bool)
            for i, j, data, off in utf8_chunks(col):
                g, go = _grams(data, off)
                n = np.diff(go)
                scale = np.minimum(1.0, TEXT_WEIGHT / np.maximum(n, 1))
                for k in range(L):
                    c = np.concatenate(([0.0], np.cumsum(m.logp[k][g], dtype=np.float64)))
                    ll = c[go[1:]] - c[go[:-1]]
                    out[i:j, k] = ll * scale
                    fit[i:j, k] = ll / np.maximum(n, 1) - m.usual[k]
                got[i:j] = n > 0
            out -= out.max(axis=1, keepdims=True) if L else 0
            post = np.exp(out)
            post /= post.sum(axis=1, keepdims=True) if L else 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("key", "declared", "host", "suffix")],
                 *[pa.array(out[:, k]) for k in range(L)], *[pa.array(post[:, k]) for k in range(L)],
                 *[pa.array(fit[:, k], mask=~got) for k in range(L)]],
                ["key", "declared", "host", "suffix", *[f"{x}{k}" for x in ("ll", "p", "fit") for k in range(L)]])
    return run


def _value_evidence(t: DataFrame, value: str, L: int) -> DataFrame:
    """log P(value | language) for every value: grouped sums of text posteriors."""
    sums = t.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        *[F.sum(f"p{k}").alias(f"s{k}") for k in range(L)])
    total = sums.agg(F.count(F.lit(1)).alias("nv"), *[F.sum(f"s{k}").alias(f"t{k}") for k in range(L)]).first()
    return sums.select(F.col("v").alias(f"{value}_v"), *[
        F.log((F.col(f"s{k}") + VALUE_SMOOTH) / F.lit((total[f"t{k}"] or 0.0) + VALUE_SMOOTH * max(1, total["nv"])))
        .alias(f"{value}_{k}") for k in range(L)])


def domain_of(host):
    """Last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def identify_languages(rows: DataFrame, model: TrigramModel, key: str, text: str, declared=None, host=None,
                       suffix=None, markup: bool = False) -> DataFrame:
    """``key, language, confidence, text_language``, the posterior per language and
    ``text_fit``: nats a trigram by which the text falls short of (or exceeds) what is
    usual in ``language``, null without a trigram.  The posterior compares only the
    model's languages; a fit below ``-MAX_MISFIT`` or null speaks for none of them.

    ``declared``, ``host`` and ``suffix`` are columns (or None: no such evidence);
    ``markup`` strips tags from the text first."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    L = len(model.langs)
    nothing = F.lit(None).cast("string")
    src = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                      *[(nothing if c is None else c.cast("string")).alias(n)
                        for n, c in (("declared", declared), ("host", host), ("suffix", suffix))])
    if L == 0:
        return src.select("key", nothing.alias("language"), F.lit(0.0).alias("confidence"), nothing.alias("text_language"),
                          F.array().cast("array<double>").alias("posterior"), F.lit(None).cast("double").alias("text_fit"))
    kind = dict(src.dtypes)["key"]
    cols = ", ".join(f"{x}{k} double" for x in ("ll", "p", "fit") for k in range(L))
    t = src.mapInArrow(_text_evidence(spark.sparkContext.broadcast(model), markup),
                       f"key {kind}, declared string, host string, suffix string, {cols}")
    t = written(t.withColumn("domain", domain_of(F.col("host"))), "evidence")
    whole = t.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(L)]).first()
    n = whole["n"] or 0
    base = [((whole[f"s{k}"] or 0.0) + 1.0) / (n + L) for k in range(L)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(L)]]
    by_domain = t.where("domain is not null").groupBy("domain").agg(*sums).select(
        F.col("domain").alias("d_domain"), *[
            ((F.col(f"s{k}") + HOST_STRENGTH * base[k]) / (F.col("n") + HOST_STRENGTH)).alias(f"d{k}") for k in range(L)])
    by_host = t.where("host is not null").groupBy("host", "domain").agg(*sums).join(
        by_domain, F.col("domain") == F.col("d_domain")).select(
        F.col("host").alias("h_host"), F.col("n").alias("h_n"), *[F.col(f"s{k}").alias(f"h{k}") for k in range(L)],
        *[f"d{k}" for k in range(L)])
    j = t.join(by_host, F.col("host") == F.col("h_host"), "left")
    for v in ("declared", "suffix"):
        j = j.join(_value_evidence(t, v, L), F.col(v) == F.col(f"{v}_v"), "left")
    log_post = []
    for k in range(L):
        prior = F.when(F.col("h_n").isNotNull(), (F.greatest(F.col(f"h{k}") - F.col(f"p{k}"), F.lit(0.0)) + HOST_STRENGTH * F.col(f"d{k}"))
                       / (F.col("h_n") - 1 + HOST_STRENGTH)).otherwise(F.lit(base[k]))
        log_post.append(F.col(f"ll{k}") + F.log(prior) + F.coalesce(f"declared_{k}", F.lit(0.0))
                        + F.coalesce(f"suffix_{k}", F.lit(0.0)))
    j = j.select("key", *[f"p{k}" for k in range(L)], F.array(*[f"fit{k}" for k in range(L)]).alias("fits"),
                 F.array(*log_post).alias("lp"))
    j = j.withColumn("e", F.transform("lp", lambda x: F.exp(x - F.array_max("lp"))))
    j = j.withColumn("posterior", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)))
    names = F.array(*[F.lit(x) for x in model.langs])
    text_post = F.array(*[F.col(f"p{k}") for k in range(L)])
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return j.select("key", F.element_at(names, best).alias("language"),
                    F.array_max("posterior").alias("confidence"),
                    F.element_at(names, F.array_position(text_post, F.array_max(text_post)).cast("int")).alias("text_language"),
                    "posterior", F.element_at("fits", best).alias("text_fit"))
