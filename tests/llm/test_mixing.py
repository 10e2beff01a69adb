"""Mixtures against a plain version: exponents by direct entropy, rows dealt one by one."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from adlift.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _weights(tokens, a):
    top = max(tokens)
    powers = [(t / top) ** a for t in tokens]
    return [p / math.fsum(powers) for p in powers]


def _entropy(tokens, a):
    return -math.fsum(w * math.log(w) for w in _weights(tokens, a) if w > 0)


def _repeats(tokens, a, budget):
    return max(w * budget / t for w, t in zip(_weights(tokens, a), tokens, strict=True))


def _exponent(tokens, target=0.95, limit=4.0):
    """Smallest exponent within both limits by walking a fine grid outwards, then halving."""
    goal, budget = target * math.log(len(tokens)), sum(tokens)
    grid = [i / 64 for i in range(64 * 40)]
    held = [a for a in grid if _repeats(tokens, a, budget) <= limit * (1 + 1e-9)]
    both = next((a for a in held if _entropy(tokens, a) <= goal), None)
    if both == 0.0:
        return 0.0, True
    if both is not None:
        lo, hi = both - 1 / 64, both
        for _ in range(60):
            mid = (lo + hi) / 2
            ok = _entropy(tokens, mid) <= goal and _repeats(tokens, mid, budget) <= limit * (1 + 1e-12)
            lo, hi = (lo, mid) if ok else (mid, hi)
        return hi, True
    return None, False


@pytest.mark.parametrize("tokens", [
    [500] + [96] * 99, [1000, 10, 1], [5, 5, 5, 5], [7], [100 + i for i in range(20)], [1] * 50 + [100_000], [3, 3, 2],
    [10_000] * 3 + [1] * 40], ids=["dominant", "steep", "equal", "single", "near-equal", "tiny", "ties", "three"])
def test_exponent_meets_both_limits(spark, tokens):
    df = spark.createDataFrame(list(enumerate(tokens)), "source int, tokens long")
    a, met = mixing.solve_exponent(df, float(sum(tokens)))
    want, reachable = _exponent(tokens)
    assert _repeats(tokens, a, sum(tokens)) <= 4 * (1 + 1e-6)
    if reachable:
        assert met and a == pytest.approx(want, abs=1e-6)
    if met:
        assert _entropy(tokens, a) <= 0.95 * math.log(len(tokens)) + 1e-6


def test_repetition_wins_over_entropy(spark):
    """A dominant source that would have to be repeated beyond the limit stops at the limit."""
    tokens = [200] + [99] * 98
    a, met = mixing.solve_exponent(spark.createDataFrame(list(enumerate(tokens)), "source int, tokens long"), float(sum(tokens)), 0.5, 4.0)
    assert not met and a > 1
    assert _repeats(tokens, a, sum(tokens)) == pytest.approx(4.0, abs=1e-4)


def _hash(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def _brute(rows):
    """Counter of (doc_id, source, tokens, epoch), every row dealt in permuted order."""
    counted = [(k, s, len(WORD.findall(t or "")), hashlib.md5((t or "").encode()).hexdigest()) for k, t, s in rows]
    sums = Counter()
    for _, s, n, _ in counted:
        sums[s] += n
    some = sorted(v for v in sums.values() if v)
    a = _exponent(some)[0] if _exponent(some)[1] else 1.0
    weight = dict(zip([s for s in sums if sums[s]], _weights([v for v in sums.values() if v], a), strict=True))
    out = Counter()
    for s, total in sums.items():
        mine = [r for r in counted if r[1] == s]
        budget = math.floor(round(weight.get(s, 0), 12) * sum(some) + 0.5)
        full, rest = (budget // total, budget % total) if total else (1, 0)
        blocks = max(1, math.ceil(total / 4096))
        out.update((k, s, n, e) for k, _, n, _ in mine for e in range(full))
        order = sorted((_hash("mix", full, s, _hash("mix", "block", k, body) % blocks), _hash("mix", "text", k, body), n, repr(k), k)
                       for k, _, n, body in mine) if rest else []
        used = 0
        for _, _, n, _, k in order:
            used += n
            if used > rest:
                break
            out[(k, s, n, full)] += 1
    return out


def _table(kind):
    rnd = random.Random(kind)
    word = [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(rnd.choices(word, k=n))
    rows = [(i, text(rnd.randint(1, 60)), f"s{i % 7}") for i in range(200)]
    if kind == "copies":
        rows += [(None, "the same few words", "s0")] * 400 + [(77, "x y z", "hot")] * 300 + [(i, text(9), "hot") for i in range(30)]
    if kind == "blanks":
        rows += [(None, None, None), (900, "", None), (901, " \n", "empty"), (902, "a b", None), (None, text(5000), "s1")] * 3
    if kind == "skewed":
        rows += [(1000 + i, text(120), "s3") for i in range(300)] + [(2000, "one", "tiny")]
    return rows


@pytest.mark.parametrize("kind", ["copies", "blanks", "skewed"])
def test_rows_match_brute_force_and_sql(spark, kind):
    rows = _table(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df.withColumn("weight", F.lit(1)).withColumn("block", F.lit(2)).withColumn("row_hash", F.lit(3))).collect()
    assert Counter((r["doc_id"], r["source"], r["tokens"], r["epoch"]) for r in out) == _brute(rows)
    con = duckdb.connect()
    con.register("d", df.toPandas().astype({"doc_id": "Int64"}))
    sql = con.execute("SELECT doc_id, source, tokens, epoch, block, slot, target_met FROM (" + mixing.SQL.replace("{docs}", "d") + ")").fetchall()
    assert Counter(map(tuple, out)) == Counter(sql)


def test_rows_of_one_key_and_text_stay_apart(spark):
    """Copies that differ in another column are dealt one by one, whole, as many as mix_sources deals."""
    rows = [(5, "a b c d", "s", f"u{i % 90}") for i in range(120)] + [(i, "p q r " * (i % 5 + 1), f"t{i % 3}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, url string").withColumn("full", F.lit(1))
    whole, counts = mixing.mixed_rows(df), mixing.mix_sources(df)
    assert whole.columns == df.columns
    by = lambda d: Counter((r["doc_id"], r["source"]) for r in d.collect())
    assert by(whole) == by(counts)
    assert {tuple(r) for r in whole.collect()} <= {tuple(r) for r in df.collect()}
    each = Counter(r["url"] for r in whole.where("doc_id = 5 and source = 's'").collect())
    have = Counter(r[3] for r in rows if r[0] == 5)
    assert all(have[u] * (each.total() // 120) <= n <= have[u] * (each.total() // 120 + 1) for u, n in each.items())


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["epoch"], r["target_met"]) for r in mixing.mix_sources(df).collect()} == {(1, 0, False), (2, 0, False)}
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
