"""Merging of line sources and pages, and repair of totals.

Documents are a header table and a line table throughout. Lines are never gathered into one array per document, so a
document with very many lines stays spread over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.values import MONEY

DEFAULT_VAT = "0.20BD"


def merge_line_sources(table_lines: DataFrame, model_lines: DataFrame, key: str) -> DataFrame:
    """Lines of each document: those read from its tables when there are any, else those of the model."""
    from_tables = table_lines.select(key).distinct()
    kept = model_lines.join(from_tables, key, "left_anti")
    return table_lines.withColumn("source", F.lit("table")).unionByName(
        kept.withColumn("source", F.lit("model")), allowMissingColumns=True
    )


def table_counts(table_lines: DataFrame, key: str, table_id: str) -> DataFrame:
    """Per document the number of tables and of lines read from them."""
    per_table = table_lines.groupBy(key, table_id).agg(F.count("*").alias("n"))
    return per_table.groupBy(key).agg(F.count("*").alias("tables_detected"), F.sum("n").alias("table_line_items"))


def repaired_totals(net: Column, vat: Column, gross: Column, line_sum: Column, n_lines: Column) -> dict[str, Column]:
    """Totals after repair: only when there are lines and the net total is missing, 0, or more than a cent off their
    sum. VAT is then estimated at 20 % if missing or 0, and the gross total is recomputed."""
    lines = F.coalesce(line_sum, F.expr("0BD")).cast(MONEY)
    empty_net = F.coalesce(net == 0, F.lit(True))
    repair = F.coalesce(n_lines > 0, F.lit(False)) & (empty_net | (F.abs(net - lines) > F.expr("0.01BD")))
    estimated = (lines * F.expr(DEFAULT_VAT)).cast(MONEY)
    new_vat = F.when(F.coalesce(vat == 0, F.lit(True)), estimated).otherwise(vat)
    return {
        "total_excl_vat": F.when(repair, lines).otherwise(net).cast(MONEY),
        "total_vat": F.when(repair, new_vat).otherwise(vat).cast(MONEY),
        "total_incl_vat": F.when(repair, lines + new_vat).otherwise(gross).cast(MONEY),
        "repaired": repair,
    }


def merge_pages(pages: DataFrame, lines: DataFrame, key: str, page: str, fields: list[str]) -> DataFrame:
    """Header of each document's first page, with the totals repaired against the lines of all its pages. The lines
    stay as rows; (page, line) is their order."""
    first = pages.groupBy(key).agg(
        F.min_by(F.struct(page, *fields), page).alias("h"), F.count("*").alias("pages_processed")
    )
    of_lines = lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.sum("line_total").alias("line_sum"))
    joined = first.select(key, "pages_processed", "h.*").join(of_lines, key, "left")
    return joined.withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).withColumns(
        repaired_totals(
            F.col("total_excl_vat"), F.col("total_vat"), F.col("total_incl_vat"), F.col("line_sum"), F.col("n_lines")
        )
    )
