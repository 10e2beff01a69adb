"""Mixing sources to target weights, in DataFrame operations only.

Weights are the sources' token shares raised to a common exponent and normalised.
The exponent is the smallest at which the mixture's entropy is at most
``TARGET_ENTROPY * ln(sources)`` and no source is repeated more than ``MAX_REPEATS``
times.  Entropy falls with the exponent; the repeats of the smallest source fall up
to exponent 1, those of the largest rise from 1 on, so the limit holds on an
interval around 1.  Each of these three bounds is one monotone bisection, the
entropy's within a bracket doubled until it holds the root.  Where the limits
exclude each other repetition wins, and where no exponent reaches the entropy (as
many largest sources of equal size) the shares stay as they are; ``target_met``
tells.  A job evaluates the midpoints of the next five levels.

A source's weight gives it a token budget, to the nearest token (a source at the
repetition limit gets all its epochs).  Its texts are dealt into blocks by
hash; every epoch has its own permutation of the blocks (by hash), full epochs
take all blocks, the last one takes blocks in permuted order until the budget is
spent, the block on the border text by text, equal rows one by one.  The border is
found top down by 15 bits of the hash at a time - ranges, blocks, texts, copies - so
no task orders a whole source, however large; equal rows meet as a count.  Every
decision is then a comparison with the source's one plan row.

Edge cases: null or blank texts count 0 tokens; a null source is a source of its
own; a source without tokens is taken once; rows equal in key, text and source at
the border are interchangeable and as many are taken as fit; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.llm.store import written
from adlift.session import ensure_checkpoint_dir

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
LEVELS = 30            # bisection steps
LEVELS_PER_JOB = 5
BLOCK_TOKENS = 4096
SEED = "mix"
HASH_BITS = 60
STEP_BITS = 15         # hash bits a search step resolves: at most 32,768 ranges a source
DOUBLINGS = 64         # brackets 2^0 .. 2^63: shares are ratios of 64-bit counts
WORD = r"[^\x20\x09-\x0D]+"


def hash60(*parts: Column) -> Column:
    """First 15 hex digits of the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *also: Column) -> DataFrame:
    """``doc_id, source, tokens`` and the hashes that place a text: ``doc_hash`` of key and
    text, ``deal`` for its block; then the columns of ``also``."""
    at = F.col(key)
    body = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(at.alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
                       hash60(F.lit(SEED), F.lit("text"), at, body).alias("doc_hash"),
                       hash60(F.lit(SEED), F.lit("block"), at, body).alias("deal"), *also)


class Shares:
    """Entropy and repeats of the mixture at given exponents, one aggregate a call."""

    def __init__(self, sums: DataFrame, budget: float) -> None:
        self.sums = sums.where("tokens > 0")
        self.budget = budget
        head = self.sums.agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
        self.n, self.smallest, self.largest = head["n"], head["lo"], head["hi"]
        self.ratio = F.col("tokens") / F.lit(float(self.largest or 1))
        self.at: dict[float, tuple[float, float]] = {}

    def measure(self, points: list[float]) -> None:
        new = [p for p in dict.fromkeys(points) if p not in self.at]
        if not new:
            return
        power = F.pow("ratio", "a")
        rows = self.sums.select(self.ratio.alias("ratio"), F.explode(F.lit(new)).alias("a")).groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("ratio")).alias("e"))
        self.at.update((r["a"], (r["z"], r["e"])) for r in rows.collect())  # one row per exponent

    def entropy(self, a: float) -> float:
        z, e = self.at[a]
        return math.log(z) - a * e / z

    def repeats(self, a: float, tokens: int) -> float:
        return (tokens / self.largest) ** a / self.at[a][0] * self.budget / tokens


def bisect_least(shares: Shares, holds: Callable[[float], bool], lo: float, hi: float) -> float:
    """Smallest point (to 2^-LEVELS of the bracket) at which a condition that stays true holds; true at ``hi``."""
    for _ in range(LEVELS // LEVELS_PER_JOB):
        ends = [lo, hi]
        for _ in range(LEVELS_PER_JOB):  # the midpoints that the next levels may ask for
            ends = [x for a, b in zip(ends, ends[1:], strict=False) for x in (a, (a + b) / 2)] + [hi]
        shares.measure(ends[1:-1])
        for _ in range(LEVELS_PER_JOB):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if holds(mid) else (mid, hi)
    return hi


def solve_exponent(sums: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY,
                   max_repeats: float = MAX_REPEATS) -> tuple[float, bool]:
    """The exponent, and whether the mixture meets the entropy at it."""
    s = Shares(sums, budget)
    if not s.n:
        return 1.0, False
    goal, most = target_entropy * math.log(s.n), max_repeats * (1 + 1e-12)
    s.measure([0.0, 1.0] + [2.0 ** k for k in range(DOUBLINGS)])
    brackets = [0.0] + [2.0 ** k for k in range(DOUBLINGS)]
    top = next((i for i, a in enumerate(brackets) if s.entropy(a) <= goal), None)
    if top is None:
        a, met = 1.0, False
    elif top == 0:
        a, met = 0.0, True
    else:
        a, met = bisect_least(s, lambda x: s.entropy(x) <= goal, brackets[top - 1] if top > 1 else 0.0, brackets[top]), True
    if a < 1:
        if s.repeats(0.0, s.smallest) > most:
            a = max(a, bisect_least(s, lambda x: s.repeats(x, s.smallest) <= most, 0.0, 1.0))
    elif a > 1:
        s.measure([a])
        if s.repeats(a, s.largest) > most:  # the last point below the first one over the limit
            over = bisect_least(s, lambda x: s.repeats(x, s.largest) > most, 1.0, a)
            a, met = over - (a - 1.0) / 2 ** LEVELS, False
    return a, met


def source_plan(tokens: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
                budget_share: float = 1.0) -> DataFrame:
    """One row per source: weight, token budget, full epochs, tokens left for the last
    epoch, number of blocks, the border of the last epoch and ``target_met``."""
    sums = written(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    budget = float(int(min(budget_share, max_repeats) * total))
    a, met = solve_exponent(sums, budget, target_entropy, max_repeats)
    largest = F.lit(float(sums.agg(F.max("tokens")).first()[0] or 1))
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / largest, F.lit(a))).otherwise(0.0)
    z = sums.agg(F.sum(power)).first()[0] or 1.0
    plan = sums.withColumn("weight", F.round(power / F.lit(z), 12)).withColumn("target_met", F.lit(met))
    plan = plan.withColumn("budget", F.floor(F.col("weight") * F.lit(budget) + F.lit(0.5)).cast("long"))
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens"))
                           .otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(float(BLOCK_TOKENS)))).cast("long"))
    return written(plan.withColumnRenamed("source", "p_source").withColumnRenamed("tokens", "source_tokens"), "plan")


def _placed(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """Texts with their block and its hash in the last epoch."""
    d = tokens.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    return d.withColumn("block", F.pmod("deal", "blocks")).withColumn("block_hash", block_hash(F.col("full")))


def block_hash(epoch: Column) -> Column:
    return hash60(F.lit(SEED), epoch, F.col("source"), F.col("block"))


def _step(rows: DataFrame, at: Column) -> DataFrame:
    """The rows of each source whose ``at`` is the first at which the running tokens pass
    ``left``; ``left`` is then what the rows before them leave."""
    sums = rows.groupBy("source", at.alias("at")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("sum"), F.first("left").alias("left"))
    w = Window.partitionBy("source").orderBy("at")
    upto = F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).where("upto > left")
    hit = over.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(
        F.col("source").alias("h_source"), F.col("at").alias("h_at"), (F.col("left") - F.col("upto") + F.col("sum")).alias("h_left"))
    inside = rows.join(hit, F.col("source").eqNullSafe(F.col("h_source")) & (at == F.col("h_at")))
    return inside.withColumn("left", F.col("h_left")).drop("h_source", "h_at", "h_left")


def _borders(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the first text (in permuted order) whose copies do not all fit the last
    epoch's rest, and ``cut_take``, how many of them do."""
    rows = _placed(tokens.where("tokens > 0"), plan).where("rest > 0").select(
        "source", "doc_id", "tokens", "block_hash", "doc_hash", "row_hash", F.lit(1).alias("copies"), F.col("rest").alias("left"))
    rows = written(_step(rows, F.shiftright("block_hash", HASH_BITS - STEP_BITS)), "border")
    same = ["source", "doc_id", "tokens", "block_hash", "doc_hash", "row_hash", "left"]
    rows = rows.groupBy(*same).agg(F.sum("copies").alias("copies"))
    for at in (F.shiftright("block_hash", HASH_BITS - 2 * STEP_BITS), F.col("block_hash"), F.col("doc_hash"),
               F.shiftright("row_hash", HASH_BITS - STEP_BITS), F.col("row_hash")):
        rows = written(_step(rows, at), "border")  # a step reads its rows twice
    return rows.select(F.col("source").alias("b_source"), F.col("block_hash").alias("cut_block"), F.col("doc_hash").alias("cut_doc"),
                       F.col("row_hash").alias("cut_row"), F.expr("left div tokens").alias("cut_take"))


def mixture_plan(tokens: DataFrame, **limits) -> DataFrame:
    plan = source_plan(tokens, **limits)
    return written(plan.join(_borders(tokens, plan), F.col("p_source").eqNullSafe(F.col("b_source")), "left").drop("b_source"), "mixture")


def occurrences(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row of ``rows`` (as of ``token_counts``, with ``row_hash``) once per epoch that
    takes it: adds ``epoch``, ``block`` and ``slot``, its place in the mixed order: epoch plus
    block hash in [0, 1), over the source's epochs by budget.  It passes 1 where the last
    epoch's blocks lie further out in hash space than their share of tokens (sources of few
    blocks).  Equal rows on the border are merged and repeated as often as they fit."""
    d = _placed(rows, plan)
    order = [("block_hash", "cut_block"), ("doc_hash", "cut_doc"), ("row_hash", "cut_row")]
    before, equal = F.lit(False), F.lit(True)
    for at, cut in order:
        before, equal = before | (equal & (F.col(at) < F.col(cut))), equal & (F.col(at) == F.col(cut))
    none = F.array().cast("array<bigint>")
    full = F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(none)
    last = F.when(F.coalesce(before, F.lit(False)), F.array("full")).otherwise(none)
    taken = d.withColumn("epoch", F.explode(F.concat(full, last)))
    if not plan.where("cut_take > 0").isEmpty():
        some = d.where(F.coalesce(equal, F.lit(False)) & (F.col("cut_take") > 0))
        one = some.groupBy("source", *[at for at, _ in order]).agg(F.first(F.struct(*d.columns)).alias("one")).select("one.*")
        taken = taken.unionByName(one.withColumn("epoch", F.explode(F.array_repeat("full", F.col("cut_take").cast("int")))))
    rate = F.when(F.col("source_tokens") > 0, F.col("budget") / F.col("source_tokens")).otherwise(F.lit(1.0))
    at = F.col("epoch") + block_hash(F.col("epoch")) / F.lit(float(2 ** HASH_BITS))
    return taken.withColumn("slot", F.round(at / rate, 9))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **limits) -> DataFrame:
    """``doc_id, source, tokens, epoch, block, slot, target_met``: one row per occurrence in
    the mixture."""
    ensure_checkpoint_dir(docs.sparkSession)
    tokens = written(token_counts(docs, key, text, source), "tokens").withColumn("row_hash", F.lit(0).cast("long"))
    return occurrences(tokens, mixture_plan(tokens, **limits)).select("doc_id", "source", "tokens", "epoch", "block", "slot", "target_met")


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` themselves, repeated or left out as the mixture says; same columns.
    Rows of one key, text and source that differ elsewhere are told apart by a hash of the whole row."""
    ensure_checkpoint_dir(docs.sparkSession)
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    rest = F.to_json(F.struct(*[v for c, v in columns.items() if c != text]))
    rows = token_counts(docs, key, text, source, F.struct(*columns.values()).alias("row"), hash60(rest).alias("row_hash"))
    tokens = written(rows.drop("row"), "tokens")
    return occurrences(rows, mixture_plan(tokens, **limits)).select("row.*")


#: DuckDB twin of ``mix_sources`` over a relation ``{docs}`` (doc_id, source, text)
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
  coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS name FROM {docs}),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),
h AS (SELECT count(*) FILTER (tokens > 0) AS n, sum(tokens)::DOUBLE AS total,
  list(tokens) FILTER (tokens > 0) AS ts FROM s),
g AS (SELECT n, total, floor(least(1.0, 4.0) * total) AS budget, 0.95 * ln(greatest(n, 1)) AS goal, 4.0 * (1 + 1e-12) AS most,
  list_min(ts)::DOUBLE AS tn, list_max(ts)::DOUBLE AS tx, list_transform(ts, lambda t: t / list_max(ts)) AS rs FROM h),
br AS (SELECT k, a, (ln(z) - a * e / z <= goal) AS ok FROM (
  SELECT k, a, goal, list_sum(list_transform(rs, lambda x: pow(x, a))) AS z,
    list_sum(list_transform(rs, lambda x: pow(x, a) * ln(x))) AS e
  FROM g, (SELECT k, CASE WHEN k < 0 THEN 0.0 ELSE pow(2.0, k) END AS a FROM (SELECT unnest(range(-1, 64)) AS k)))),
top AS (SELECT min(k) AS k FROM br WHERE ok),
-- the entropy's root, and the left end of the interval in which repeats keep the limit
bis(i, lo, hi, l_lo, l_hi) AS (
  SELECT 0, CASE WHEN k > 0 THEN pow(2.0, k - 1) ELSE 0.0 END, CASE WHEN k IS NULL THEN 1.0 WHEN k < 0 THEN 0.0 ELSE pow(2.0, k) END,
    0.0::DOUBLE, 1.0::DOUBLE FROM top
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END,
    CASE WHEN l_ok THEN l_lo ELSE l_mid END, CASE WHEN l_ok THEN l_mid ELSE l_hi END FROM (
    SELECT i, lo, hi, mid, l_lo, l_hi, l_mid, (ln(z) - mid * e / z <= goal) AS ok,
      (pow(tn / tx, l_mid) / l_z * budget / tn <= most) AS l_ok FROM (
      SELECT i, lo, hi, (lo + hi) / 2 AS mid, l_lo, l_hi, (l_lo + l_hi) / 2 AS l_mid, goal, budget, most, tn, tx,
        list_sum(list_transform(rs, lambda x: pow(x, (lo + hi) / 2))) AS z,
        list_sum(list_transform(rs, lambda x: pow(x, (lo + hi) / 2) * ln(x))) AS e,
        list_sum(list_transform(rs, lambda x: pow(x, (l_lo + l_hi) / 2))) AS l_z
      FROM bis, g WHERE i < 30))),
a0 AS (SELECT CASE WHEN k IS NULL THEN 1.0 WHEN k < 0 THEN 0.0 ELSE hi END AS a, k IS NOT NULL AS met,
  l_hi FROM bis, top WHERE i = 30),
a1 AS (SELECT CASE WHEN a < 1 AND budget / tn / n > most THEN greatest(a, l_hi) ELSE a END AS a, met FROM a0, g),
-- the right end, where the entropy's root lies beyond it
bir(i, lo, hi) AS (
  SELECT 0, 1.0::DOUBLE, a FROM a1
  UNION ALL
  SELECT i + 1, CASE WHEN over THEN lo ELSE mid END, CASE WHEN over THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, (1.0 / z * budget / tx > most) AS over FROM (
      SELECT i, lo, hi, (lo + hi) / 2 AS mid, budget, most, tx,
        list_sum(list_transform(rs, lambda x: pow(x, (lo + hi) / 2))) AS z FROM bir, g WHERE i < 30))),
a AS (SELECT CASE WHEN crossed THEN hi - (a - 1.0) / pow(2.0, 30) ELSE a END AS a, met AND NOT crossed AS met FROM (
  SELECT a, hi, met, coalesce(a > 1 AND 1.0 / list_sum(list_transform(rs, lambda x: pow(x, a))) * budget / tx > most, false) AS crossed
  FROM a1, bir, g WHERE i = 30)),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / tx, a) ELSE 0.0 END AS pw, budget, coalesce(met, false) AS target_met FROM s, g, a),
pl AS (SELECT source, target_met, tokens AS st, floor(round(pw / sum(pw) OVER (), 12) * budget + 0.5)::BIGINT AS budget FROM w),
plan AS (SELECT source, target_met, st, budget, CASE WHEN st > 0 THEN budget // st ELSE 1 END AS full_epochs,
  CASE WHEN st > 0 THEN budget - (budget // st) * st ELSE 0 END AS rest,
  greatest(1, ceil(st / 4096.0))::BIGINT AS blocks FROM pl),
q AS (SELECT d.*, plan.* EXCLUDE (source),
  ('0x' || substr(md5('mix|text|' || name), 1, 15))::BIGINT AS dh,
  ('0x' || substr(md5('mix|block|' || name), 1, 15))::BIGINT % blocks AS block
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
b AS (SELECT *, ('0x' || substr(md5('mix|' || full_epochs || '|' || coalesce(source, '') || '|' || block), 1, 15))::BIGINT AS bh FROM q),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bh, dh, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM b),
o AS (SELECT *, unnest(range(full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, block::BIGINT AS block,
  round((epoch + ('0x' || substr(md5('mix|' || epoch || '|' || coalesce(source, '') || '|' || block), 1, 15))::BIGINT
    / 1152921504606846976.0::DOUBLE) / CASE WHEN st > 0 THEN budget / st ELSE 1.0 END, 9) AS slot, target_met FROM o
"""
