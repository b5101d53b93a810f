"""Detected tables: HTML to cell matrices, header recognition and typed line items. All inside one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import parse_money, parse_percent

TABLE_ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
TABLE_CELL = r"(?s)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_matrix(html: Column) -> Column:
    """Rows of stripped cell texts; rows without cells are dropped."""

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(TABLE_CELL), F.lit(1))
        return F.transform(found, lambda c: strip(F.regexp_replace(c, "<[^>]+>", "")))

    rows = F.transform(F.regexp_extract_all(html, F.lit(TABLE_ROW), F.lit(1)), cells)
    return F.filter(rows, lambda r: F.size(r) > 0)


def long_cells(df: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """One row per cell of a matrix column, numbered from 0."""
    rows = df.select(*keys, F.posexplode(matrix).alias("row_no", "_row"))
    return rows.select(*keys, "row_no", F.posexplode("_row").alias("col_no", "text"))


def _holds_any(text: Column, words: list[str]) -> Column:
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def is_line_item_table(matrix: Column) -> Column:
    """At least a header and one row, and a header that names a line-item column."""
    header = F.lower(F.array_join(F.get(matrix, F.lit(0)), " "))
    return F.coalesce((F.size(matrix) >= 2) & _holds_any(header, fv.LINE_TABLE_WORDS), F.lit(False))


def column_roles(matrix: Column) -> dict[str, Column]:
    """Per role the 0-based index of the first header that names it, null when none does."""
    headers = F.transform(F.get(matrix, F.lit(0)), lambda h: strip(F.lower(h)))

    def first(words: list[str]) -> Column:
        return F.nullif(F.array_position(F.transform(headers, lambda h: _holds_any(h, words)), F.lit(True)), F.lit(0)) - 1

    return {role: first(words) for role, words in fv.COLUMN_ROLE_WORDS.items()}


def table_line_items(df: DataFrame, keys: list[str], matrix: str = "data") -> DataFrame:
    """Typed line items of the line-item tables; rows shorter than the header or without description are dropped."""
    m = F.col(matrix)
    roles = column_roles(m)
    # The table test sits inside the generator: as a filter it would be pushed below the matrix column and would
    # compute the matrix again.
    body = F.when(is_line_item_table(m), F.slice(m, F.lit(2), F.size(m) - 1))
    rows = df.select(
        *keys,
        *[c.cast("int").alias(f"_at_{role}") for role, c in roles.items()],
        F.size(F.get(m, F.lit(0))).alias("_width"),
        F.posexplode(body).alias("line_no", "_row"),
    ).where(F.size("_row") >= F.col("_width"))

    def cell(role: str) -> Column:
        return strip(F.get("_row", F.col(f"_at_{role}")))

    return rows.select(
        *keys,
        "line_no",
        cell("description").alias("description"),
        parse_money(cell("quantity")).alias("quantity"),
        parse_money(cell("unit_price")).alias("unit_price"),
        parse_money(cell("line_total")).alias("line_total"),
        parse_percent(cell("vat_rate")).alias("vat_rate"),
    ).where(F.col("description") != "")
