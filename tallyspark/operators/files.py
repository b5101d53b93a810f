"""Rules and inventories over file listings (filename, length, modificationTime)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv


def extension(filename: Column) -> Column:
    """Lower-cased last suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]+)$", 1))


def reject_reason(filename: Column, length: Column) -> Column:
    """Why an upload is refused, null when it is accepted."""
    return (
        F.when(~F.coalesce(filename != "", F.lit(False)), "Filename is required")
        .when(~extension(filename).isin(fv.UPLOAD_EXTENSIONS), "Unsupported file type")
        .when(length > fv.MAX_UPLOAD_BYTES, "File too large")
    )


def inventory(files: DataFrame) -> DataFrame:
    """Per extension the number of files and their size, and the share of all bytes."""
    by_ext = files.groupBy(extension(F.col("filename")).alias("extension")).agg(
        F.count("*").alias("n_files"), F.sum("length").alias("bytes")
    )
    return by_ext.withColumn("size_mb", F.round(F.col("bytes") / F.lit(1048576.0), 2))


def with_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files whose name ends in one of the given suffixes, sorted by name."""
    hit = F.lit(False)
    for ext in extensions:
        hit = hit | F.col("filename").endswith(ext)
    return files.where(hit).orderBy("filename")


def content_hashes(documents: DataFrame, content: str) -> DataFrame:
    """MD5 of each content with the number of rows that share it and the first of them."""
    hashed = documents.select("doc_id", F.md5(F.col(content)).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def aged(files: DataFrame, now: str, days: int, archive: str) -> DataFrame:
    """Files older than `days` with the dated archive path they would move to; nothing is moved."""
    moment = F.lit(now).cast("timestamp")
    old = files.where(F.col("modificationTime") < moment - F.expr(f"INTERVAL {days * 24} HOURS"))
    day = F.date_format(moment, "yyyy-MM-dd")
    return old.withColumn("target", F.concat(F.lit(archive + "/"), day, F.lit("/"), F.col("filename")))


def page_quality(sharpness: Column, contrast: Column, brightness: Column) -> Column:
    """Mean of the three capped measures."""
    one = F.lit(1.0)
    parts = F.least(sharpness / 1000, one) + F.least(contrast / 128, one) + (one - F.abs(brightness - 128) / 128)
    return parts / 3


def page_suitable(sharpness: Column, contrast: Column, brightness: Column) -> Column:
    return (sharpness >= 100) & (contrast >= 20) & (page_quality(sharpness, contrast, brightness) >= 0.3)
