"""The operators applied to the given tables, one query for each, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    conversations,
    decontaminate,
    embed_dedup,
    exact_dedup,
    html_text,
    jaccard_join,
    langid,
    licenses,
    quality,
    sentencepiece_codec,
    sharding,
    token_files,
    whitening,
)
from tallyspark.llm.common import crc_mod, table

ACCEPT = 0.3  # quality score from which a document counts as good
MIN_LANGUAGE_SCORE = 0.2  # below this a text is far from every profile
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and tells whether the same text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(PIECES)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path)
    return both.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.crc32(F.coalesce("decoded", F.lit("")).cast("binary")).alias("decoded_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end_id=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.to_json("notices"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.with_links(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    profiles = langid.learn(docs.where(~held_out))
    return langid.identify(docs, profiles, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found, rows = conversations.repair(conversations.damaged(given))
    both = conversations.joined(found, conversations.digests(rows), ["conv_id"], "left")
    result = conversations.joined(given.select("conv_id").distinct(), both, ["conv_id"], "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return result.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors, 4))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_quality,
        op3_token_files,
        op4_decontamination,
        op5_embedding_dedup,
        op6_sharding,
        op7_license_scan,
        op8_html_text,
        op9_jaccard_join,
        op10_language_id,
        op11_conversation_repair,
        op12_whitening,
        op13_exact_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op13_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
""",
}
