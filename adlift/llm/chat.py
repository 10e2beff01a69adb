"""Preference formatting: common prompt, paired masked completions.

Chosen and rejected conversations are tables of turns.  Turns are aligned by
(pair, turn); the longest common prefix ends before the first turn that differs in
role or text or that one side lacks - one minimum per pair.  Turns of the prefix
are rendered once as prompt, the others as completions of their side.  A rendered
turn is a header and a body; loss is taken on the bodies of assistant turns of the
completions only, and ``header_chars`` / ``trained`` say so per segment.

Segments stay rows, so a pair of any length needs no single task; ``rendered_pairs``
joins them to one string per part for consumers that want that.

Edge cases: a null text is empty, a null role is "unknown"; repeated turns keep
their number and are ordered by role and text; null pair or turn values are values
of their own; equal conversations give a prompt and no completions; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: fixed values of the template: before the role, after the role, after the body
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(t: DataFrame, side: str) -> DataFrame:
    t = t.select("pair", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    copy = F.row_number().over(Window.partitionBy("pair", "turn").orderBy("role", "text"))
    return t.withColumn("copy", copy).select(*[F.col(c).alias(f"{side}_{c}") for c in ("pair", "turn", "copy", "role", "text")])


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments ``pair, part, turn, copy, role, rendered, header_chars, trained`` of two
    turn tables ``(pair, turn, role, text)``; part is prompt, chosen or rejected."""
    c, r = _turns(chosen, "c"), _turns(rejected, "r")
    j = c.join(r, F.col("c_pair").eqNullSafe(F.col("r_pair")) & F.col("c_turn").eqNullSafe(F.col("r_turn"))
               & (F.col("c_copy") == F.col("r_copy")), "full")
    on_c = F.col("c_copy").isNotNull()
    j = j.select(F.when(on_c, F.col("c_pair")).otherwise(F.col("r_pair")).alias("pair"),
                 F.when(on_c, F.col("c_turn")).otherwise(F.col("r_turn")).alias("turn"),
                 F.coalesce("c_copy", "r_copy").alias("copy"), "c_role", "c_text", "r_role", "r_text",
                 on_c.alias("has_c"), F.col("r_copy").isNotNull().alias("has_r"))
    same = F.col("has_c") & F.col("has_r") & (F.col("c_role") == F.col("r_role")) & (F.col("c_text") == F.col("r_text"))
    place = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("t"), F.col("copy").alias("c"))
    j = j.withColumn("place", place).withColumn("same", same)
    cut = j.groupBy("pair").agg(F.min(F.when(~F.col("same"), F.col("place"))).alias("cut")).withColumnRenamed("pair", "k")
    j = j.join(cut, F.col("pair").eqNullSafe(F.col("k")))
    shared = F.col("cut").isNull() | (F.col("place") < F.col("cut"))

    def part(name: str, role: str, text: str) -> Column:
        return F.struct(F.lit(name).alias("part"), F.col(role).alias("role"),
                        F.concat(_header(F.col(role)), F.col(text), F.lit(CLOSE)).alias("rendered"),
                        F.length(_header(F.col(role))).cast("long").alias("header_chars"),
                        (F.lit(name != "prompt") & (F.col(role) == ASSISTANT)).alias("trained"))
    parts = F.array_compact(F.array(
        F.when(shared, part("prompt", "c_role", "c_text")),
        F.when(~shared & F.col("has_c"), part("chosen", "c_role", "c_text")),
        F.when(~shared & F.col("has_r"), part("rejected", "r_role", "r_text"))))
    return j.select("pair", "turn", "copy", F.explode(parts).alias("p")).select(
        "pair", "p.part", "turn", "copy", "p.role", "p.rendered", "p.header_chars", "p.trained")


def rendered_pairs(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected strings, and for both completions the
    (start, end) character spans that loss is taken on."""
    s = F.struct("turn", "copy", "rendered", "header_chars", "trained")
    g = segments.groupBy("pair").pivot("part", ["prompt", "chosen", "rejected"]).agg(F.sort_array(F.collect_list(s)))
    text = {p: F.concat_ws("", F.transform(p, lambda x: x["rendered"])) for p in ("prompt", "chosen", "rejected")}

    def spans(p: str) -> Column:
        ends = F.aggregate(p, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("xs")),
                           lambda a, x: F.struct((a["at"] + F.length(x["rendered"])).alias("at"), F.when(
                               x["trained"], F.concat(a["xs"], F.array(F.struct((a["at"] + x["header_chars"]).alias("s"),
                                                                               (a["at"] + F.length(x["rendered"])).alias("e")))))
                               .otherwise(a["xs"]).alias("xs")))
        return F.coalesce(ends["xs"], F.array().cast("array<struct<s:bigint,e:bigint>>"))
    return g.select("pair", text["prompt"].alias("prompt"), text["chosen"].alias("chosen"), text["rejected"].alias("rejected"),
                    spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def swapped_replies(turns: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turn tables from plain conversations: chosen is a conversation,
    rejected is its context (the turns before its last assistant turn) answered with the
    last assistant turn of its neighbour ``key xor 1``."""
    t = turns.select(F.col(key).cast("long").alias("pair"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = t.groupBy("pair").agg(F.max(F.when(F.col("role") == ASSISTANT, F.col("turn"))).alias("last"),
                                 F.max("turn").alias("top")).withColumnRenamed("pair", "k")
    j = t.join(last, F.col("pair").eqNullSafe(F.col("k")))
    context = j.where(F.col("last").isNull() | F.coalesce(F.col("turn") < F.col("last"), F.lit(True))).select("pair", "turn", "role", "text")
    reply = j.where((F.col("turn") == F.col("last")) & (F.col("role") == ASSISTANT)).groupBy("pair").agg(F.min("text").alias("text")) \
        .select(F.col("pair").bitwiseXOR(F.lit(1)).alias("to"), "text")
    answered = last.join(reply, F.col("k") == F.col("to")).select(
        F.col("k").alias("pair"), F.coalesce(F.col("last"), F.col("top") + 1).alias("turn"), F.lit(ASSISTANT).alias("role"), "text")
    return t, context.unionByName(answered)


#: DuckDB twin of ``preference_segments(*swapped_replies(conversations))``, texts as md5
SQL = r"""
WITH t AS (SELECT conv_id AS pair, turn, role, text FROM conversations),
l AS (SELECT pair, max(turn) FILTER (role = 'assistant') AS last, max(turn) AS top FROM t GROUP BY pair),
ctx AS (SELECT t.* FROM t JOIN l ON t.pair = l.pair WHERE l.last IS NULL OR t.turn < l.last),
rep AS (SELECT xor(t.pair, 1) AS to_pair, min(t.text) AS text FROM t JOIN l ON t.pair = l.pair
  WHERE t.turn = l.last AND t.role = 'assistant' GROUP BY t.pair),
rej AS (SELECT * FROM ctx UNION ALL
  SELECT l.pair, coalesce(l.last, l.top + 1), 'assistant', rep.text FROM l JOIN rep ON l.pair = rep.to_pair),
c AS (SELECT pair, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY pair, turn ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) AS cp FROM t),
r AS (SELECT pair, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY pair, turn ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) AS cp FROM rej),
j AS (SELECT coalesce(c.pair, r.pair) AS pair, coalesce(c.turn, r.turn) AS turn, coalesce(c.cp, r.cp) AS cp,
  c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt,
  coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM c FULL JOIN r ON c.pair = r.pair AND c.turn = r.turn AND c.cp = r.cp),
m AS (SELECT *, min(CASE WHEN NOT same THEN turn * 1000000 + cp END) OVER (PARTITION BY pair) AS cut FROM j),
s AS (
  SELECT pair, 'prompt' AS part, turn, cp, cr AS role, ct AS text FROM m WHERE cut IS NULL OR turn * 1000000 + cp < cut
  UNION ALL SELECT pair, 'chosen', turn, cp, cr, ct FROM m WHERE turn * 1000000 + cp >= cut AND cr IS NOT NULL
  UNION ALL SELECT pair, 'rejected', turn, cp, rr, rt FROM m WHERE turn * 1000000 + cp >= cut AND rr IS NOT NULL)
SELECT pair, part, turn, cp::BIGINT AS copy, role, md5('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)) AS rendered_md5,
  length('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10))::BIGINT AS rendered_chars,
  (length(role) + 5)::BIGINT AS header_chars, (part <> 'prompt' AND role = 'assistant') AS trained FROM s
"""
