"""The registered queries of this package and their DuckDB twins.

Each query applies its operator with production parameters to the whole of its
table; digest columns are derived from the operator's own outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm import chat, hybrid_rank, langid, lattice, lexicon, mixing, prefix_trie, quality, tokenstore, toxicity, vecdedup, warc
from adlift.llm.ngram_join import ngram_jaccard_components
from adlift.llm.store import scratch, table, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.vector_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``pages``, the text model fitted on labelled ``documents``."""
    model = langid.fit_trigrams(table(spark, sf_dir, "documents"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1))
    out = langid.identify_languages(table(spark, sf_dir, "pages"), model, "page_id", "html",
                                    declared=F.when(declared != "", declared), host=host,
                                    suffix=F.substring_index(host, ".", -1), markup=True)
    return out.select(F.col("key").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "text_language")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    tokenstore.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"),
                            special_ids=True)
    return tokenstore.read_tokens(spark, folder, digest=True).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), folder)
    r = warc.read_warc(spark, folder)
    response = F.col("record_type") == "response"
    return r.where(F.col("record_type").isin("response", "revisit")).select(
        F.regexp_extract("record_id", r"^urn:x-page:(-?\d+)$", 1).try_cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.regexp_extract("refers_to", r"^urn:x-page:(-?\d+)$", 1).try_cast("long").alias("refers_to"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(spark, docs, labels.where(~toxicity.held_out()))
    s = toxicity.score_toxicity(docs, model)
    return s.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chat.preference_segments(*chat.swapped_replies(table(spark, sf_dir, "conversations")))
    return s.select("pair", "part", "turn", F.col("copy").cast("long").alias("copy"), "role", F.md5("rendered").alias("rendered_md5"),
                    F.length("rendered").cast("long").alias("rendered_chars"), "header_chars", "trained")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lattice.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return segmentation_digests(s)


def segmentation_digests(s: DataFrame) -> DataFrame:
    return s.select(F.col("key").alias("doc_id"), "sample", "n_pieces", F.round("log_prob", 6).alias("log_prob"),
                    F.round("log_inclusion", 6).alias("log_inclusion"), F.crc32("ids").alias("ids_crc32"),
                    (F.col("decoded_crc32") == F.col("text_crc32")).alias("decodes"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    ids = lexicon.encode_texts(docs, tokenizer, lexicon.fit_lexicon(docs, tokenizer))
    ids = written(ids, "ids")  # a task runs one Python process at a time: the encoder's, then the decoder's
    return lexicon.decode_ids(ids, tokenizer).select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op12_hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_source_mixing, op2_embedding_dedup, op3_language_id, op4_token_store, op5_warc, op6_toxicity,
    op7_preference_pairs, op8_quality_rules, op9_sampled_segmentation, op10_ngram_join,
    op11_lexicon_bpe, op12_hybrid_rank, op13_prefix_trie)}

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

ORACLES = {
    "op1_source_mixing": mixing.SQL.replace("{docs}", "documents"),
    "op5_warc": WARC_SQL,
    "op7_preference_pairs": chat.SQL,
    "op12_hybrid_rank": hybrid_rank.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
