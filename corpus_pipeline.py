"""A training corpus in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, jaccard_join, langid, quality, sentencepiece_codec
from tallyspark.llm.catalog import ACCEPT, MIN_LANGUAGE_SCORE, PIECES
from tallyspark.llm.common import crc_mod, cut, table


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no name used on the way meets one of theirs."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("packed"), *rest).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that packed took, as they were."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.scored(packed(docs), model, "_score", min_score=ACCEPT), docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those far from the profile of every language, go."""
    profiles = langid.learn(docs.where(crc_mod("doc_id", 4) != 2))
    rows = packed(docs)
    return unpacked(langid.identify(rows, profiles, keep=rows.columns, min_score=MIN_LANGUAGE_SCORE), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows exactly one stays: the one with the smallest id, null ids last. Rows are told apart by a
    key of their own, so repeated, null and shared ids count as other rows; rows without words stay."""
    keyed = cut(packed(docs).withColumn("_row", F.monotonically_increasing_id()))
    found = jaccard_join.join(keyed, "_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_comp"))
    found = cut(found)
    shared = found.where("_row <> _comp").select("_comp").distinct()
    ids = keyed.select("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row").alias("_rank"))
    grouped = cut(found.join(shared, "_comp").join(ids, "_row"))
    stays = grouped.groupBy("_comp").agg(F.min("_rank").alias("_stays"))
    gone = cut(grouped.join(stays, "_comp").where("_row <> _stays._row").select("_row"))
    return unpacked(keyed.join(gone, "_row", "left_anti"), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return unpacked(decontaminate.clean(packed(docs), table(spark, sf_dir, "benchmark")), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids of the text as `ids`; a column of that name gives way."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
