"""Folders the jobs may write to, and the sources and sinks that use them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators.responses import RAW_INVOICE, typed_invoices


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that spark.checkpoint.dir or the context's checkpoint folder names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str, drop_shuffles: bool = False) -> DataFrame:
    """The table, written to the shared folder and read again: a lost executor repeats nothing that came before. With
    drop_shuffles Spark removes the shuffle files as soon as the table is written, not when the driver collects its garbage."""
    spark = df.sparkSession
    path, before = work_folder(spark, purpose), spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


# --- sources -------------------------------------------------------------------------------------------------------
def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Documents of a folder; content is read only where it is used."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .withColumn("filename", F.substring_index("path", "/", -1))
    )


def stream_files(
    spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int = 1000, recursive: bool = True
) -> DataFrame:
    """The same for files that arrive while the job runs."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return stream.withColumn("filename", F.substring_index("path", "/", -1))


def scan_json_invoices(spark: SparkSession, path: str) -> DataFrame:
    """Invoices of a JSON-lines folder as typed columns; rows that break the schema keep their text in _corrupt."""
    raw = (
        spark.read.schema(f"{RAW_INVOICE}, _corrupt STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    record = F.struct(*[c for c in raw.columns if c != "_corrupt"])
    return typed_invoices(raw.select("_corrupt", record.alias("_r")), "_r").drop("_r")


def scan_xml(spark: SparkSession, path: str, schema: str | StructType, row_tag: str = "Invoice") -> DataFrame:
    """Rows of an XML folder as typed columns; blanks at the edges of a text are kept."""
    return spark.read.schema(schema).option("rowTag", row_tag).option("ignoreSurroundingSpaces", False).format("xml").load(path)


# --- sinks ---------------------------------------------------------------------------------------------------------
RECORDS_PER_FILE = 500_000  # files that only one task can read (XML, compressed JSON) stay small however large the table


def sink_json(df: DataFrame, path: str, *partitions: str, compression: str = "none", records_per_file: int = RECORDS_PER_FILE) -> None:
    plain = df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", records_per_file)
    plain.partitionBy(*partitions).json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks at the edges of a text are kept."""
    plain = df.write.mode("overwrite").option("header", True)
    plain.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def sink_xml(
    df: DataFrame, path: str, row_tag: str = "Invoice", root_tag: str = "Invoices", records_per_file: int = RECORDS_PER_FILE, compression: str = "none"
) -> None:
    """One XML document per part file. Nulls are left out and empty texts kept, so scan_xml tells them apart."""
    plain = df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", records_per_file)
    plain.option("rowTag", row_tag).option("rootTag", root_tag).format("xml").save(path)


def split_to_sinks(judged: DataFrame, folder: str) -> dict[str, int]:
    """Writes judged invoices below target=valid and target=quarantine in one pass, and returns how many rows and errors
    went where, counted while they were written."""
    ok, n = F.col("is_valid"), F.col("n_errors")
    counts = {
        "valid": F.count_if(ok),
        "quarantine": F.count_if(~ok),
        "valid_errors": F.coalesce(F.sum(F.when(ok, n)), F.lit(0)),
        "quarantine_errors": F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)),
    }
    seen = Observation()
    rows = judged.observe(seen, *[c.cast("long").alias(name) for name, c in counts.items()])
    target = F.when(ok, "valid").otherwise("quarantine")
    rows.withColumn("target", target).write.mode("overwrite").partitionBy("target").parquet(folder)
    return seen.get


# --- exports -------------------------------------------------------------------------------------------------------
def header_xml(df: DataFrame) -> DataFrame:
    """UBL-style header text of each invoice."""
    fields = F.struct(
        F.col("invoice_id").alias("ID"),
        F.col("issue_date").alias("IssueDate"),
        F.col("invoice_type_code").alias("InvoiceTypeCode"),
        F.col("currency_code").alias("DocumentCurrencyCode"),
    )
    return df.withColumn("xml", F.to_xml(fields, {"rowTag": "Invoice"}))


def peppol_header(df: DataFrame) -> DataFrame:
    """PEPPOL-like header record of each invoice as a struct column: identifiers, parties and totals. Lines are records of
    their own (peppol_lines), so an invoice of any length has one header, and its totals stand once."""
    return df.withColumn(
        "record",
        F.struct(
            "invoice_id",
            "issue_date",
            F.col("currency_code").alias("currency"),
            "supplier",
            "customer",
            F.struct(
                F.col("total_excl_vat").cast("double").alias("net"),
                F.col("total_vat").cast("double").alias("vat"),
                F.col("total_incl_vat").cast("double").alias("gross"),
            ).alias("totals"),
        ),
    )


def peppol_lines(lines: DataFrame, key: str, line_no: str) -> DataFrame:
    """Line records: invoice key, line number, and the line's own columns."""
    return lines.select(key, F.col(line_no).alias("line_no"), "line_ref", "description", "quantity", "unit_price", "line_total")
