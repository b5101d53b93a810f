"""Exact duplicates by progressive refinement: rows are grouped by length, then by a hash of their first characters, and only
rows whose group still holds several have their whole text hashed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut

WHITE = r"[\x20\x09-\x0D]+"
PREFIX = 64  # characters of the second refinement


def normalised(text: Column) -> Column:
    """The text without blanks and the controls from tab to carriage return; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The values of keys that stand in several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. No other column of docs is read.

    Texts are equal when they are the same without white space; null counts as empty, so all empty rows are equal. Of equal
    ones the row with the most code points stays, then the smallest id (null last), then any one of rows that agree in both,
    so exactly one row of a group is kept, repeated ids too. text_sha256 is the hash by which equal texts were told: null
    where length or first characters already set a row apart, unless digests asks for it in every row.

    Texts are read once. What the refinement needs is written as narrow columns, where only the last step reads the body (the
    hash, or the text to be hashed). Groups are reduced by partial aggregation, so one with a third of all rows is not
    gathered; a key with many rows meets one row in each join.
    """
    raw = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.length(raw).alias("points"), normalised(F.col(text_column)).alias("body"))
    measured = cut(
        texts.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "points",
            F.length("body").alias("size"),
            F.xxhash64(F.substring("body", 1, PREFIX)).alias("prefix"),
            (F.sha2("body", 256) if digests else F.col("body")).alias("body"),
        )
    )
    of_size = measured.select("size", "prefix").join(repeated(measured, "size"), "size", "left_semi")
    open_groups = repeated(of_size, "size", "prefix").withColumn("open", F.lit(True))
    joined = measured.join(open_groups, ["size", "prefix"], "left").withColumn("open", F.col("open").isNotNull())
    digest = F.col("body") if digests else F.when(F.col("open"), F.sha2("body", 256))
    hashed = cut(joined.select("_row", "doc_id", "points", "open", digest.alias("text_sha256")))

    rank = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    groups = hashed.where("open").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(rank).alias("stays"))
    equal = hashed.where("open").join(groups, "text_sha256")
    equal = equal.select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("stays._row")).alias("kept"), "text_sha256"
    )
    alone = hashed.where("not open").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return equal.unionByName(alone)
