"""Corpus pipeline: language ID, toxicity, n-gram Jaccard join, source mixing, segmentation.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and hands the reread rows to the next.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm import langid, lattice, mixing, toxicity
from adlift.llm.ngram_join import ngram_jaccard_components
from adlift.llm.queries import segmentation_digests, tokenizer_path
from adlift.llm.store import table, written


def free_name(docs: DataFrame) -> str:
    """A column name that the input does not have."""
    row = "row"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    return row


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The stage's input with a number per row, written so that every use sees the same
    numbers; and the name of that column."""
    row = free_name(docs)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def named(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """The stage's input with a SHA-256 of the columns that alone decide whether a row stays,
    so that no copy of the input is written for it; and the name of that column."""
    row = free_name(docs)
    parts = [F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("null")) for c in columns]
    return docs.withColumn(row, F.unhex(F.sha2(F.concat_ws(" ", *parts), 256))), row


def kept(rows: DataFrame, row: str, keep: DataFrame) -> DataFrame:
    """The rows whose number or name is in the one column of ``keep``."""
    return rows.join(keep.toDF(row).distinct(), row, "left_semi").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language is known with confidence; the declared language and
    the source (as host) are evidence beside the text.  A text without a trigram, or one
    whose trigrams are not usual in the language found, is in none of the languages,
    whatever it declares (as long as such texts are few among the labelled ones).

    Null and empty texts go; a null language or source is no evidence; every row is decided
    for itself, also where doc_ids repeat or are null; other columns pass through."""
    rows, row = named(docs, "text", "lang", "source")
    model = langid.fit_trigrams(docs.select("text", "lang", "doc_id"))
    told = rows.select(row, "text", "lang", "source")
    found = langid.identify_languages(told, model, row, "text", declared=F.col("lang"), host=F.col("source"))
    known = (F.col("confidence") >= langid.MIN_CONFIDENCE) & (F.col("text_fit") >= -langid.MAX_MISFIT)
    return kept(rows, row, found.where(known).select("key"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts scored toxic (model fitted on labelled rows of this stage's input).

    Every row is decided by its own text, also where doc_ids repeat or are null; a null or
    empty text is scored as an empty one; other columns pass through."""
    rows, row = named(docs, "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.fit_toxicity(spark, docs.select("doc_id", "text"), labels)
    scores = toxicity.score_toxicity(rows.select(row, "text"), model, key=row, kind="binary")
    return kept(rows, row, scores.where("predicted = 0").select("doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked texts one row: that of the smallest doc_id (null last),
    among rows that share it the first.  Texts without words link with nothing and all stay;
    other columns pass through."""
    rows, row = numbered(docs)
    groups = ngram_jaccard_components(rows.select(row, "text"), key=row).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    keep = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(first.alias("first"))
    return kept(rows, row, keep.select(f"first.{row}"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out texts so that sources reach their target weights (null source: one
    of its own; texts without words count nothing); all columns pass through."""
    return mixing.mixed_rows(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations per row, as digests of their piece ids; null and empty texts
    have no pieces, a null doc_id stays null."""
    return segmentation_digests(lattice.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("ngram_join", near_copies), ("mixing", mix),
          ("segmentation", segment)]

#: the segmentation, toxicity and language stages are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
