"""Column functions that turn printed money, percentages, dates and boxes into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
RATE = "decimal(9,6)"


def number_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.,\-]", "")


def plain_number(kept: Column) -> Column:
    """Digits of a printed number with '.' as decimal sign, from its number_characters; the last separator is the
    decimal one. A lone comma is decimal only when at most two characters follow it.
    """
    comma_decimal = kept.rlike(r"\.[^,]*,[^.]*$|\..*,[^.]*$")
    return (
        F.when(comma_decimal, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(~kept.contains(".") & kept.rlike(r"^[^,]*,[^,]{0,2}$"), F.replace(kept, F.lit(","), F.lit(".")))
        .otherwise(F.replace(kept, F.lit(","), F.lit("")))
    )


def parse_money(text: Column, to: str = MONEY) -> Column:
    """Decimal value of a printed amount, null when it is none."""
    return plain_number(number_characters(text)).try_cast(to)


def money_or_zero(text: Column) -> Column:
    """As parse_money, with 0 for missing or unreadable values."""
    return F.coalesce(parse_money(text), F.lit(0).cast(MONEY))


def parse_percent(text: Column) -> Column:
    """'19%' as the fraction 0.19."""
    return (parse_money(F.replace(text, F.lit("%"), F.lit(""))) * F.expr("0.01BD")).cast(RATE)


ISO_OR_SLASH = r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})$"
DAY_FIRST = r"^([0-9]{1,2})([-./])([0-9]{1,2})\2([0-9]{4})$"


def parse_date_any(text: Column, accept_slash_iso: bool = True) -> Column:
    """Date written year-first with '-' or '/', or day-first with '.', '/' or '-'; anything else is null."""
    if not accept_slash_iso:
        text = F.when(~text.rlike(r"^[0-9]{4}/"), text)
    iso = F.regexp_replace(F.regexp_replace(text, ISO_OR_SLASH, "$1-$3-$4"), DAY_FIRST, "$4-$3-$1")
    whole = iso.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & ~iso.startswith("0000")
    return F.when(whole, iso.try_cast("date"))


def polygon_center(points: Column, axis: int) -> Column:
    """Mean x (axis 0) or y (axis 1) of a four-point polygon."""
    total = points[0][axis] + points[1][axis] + points[2][axis] + points[3][axis]
    return total / F.lit(4.0)


def rectangle_center(box: Column, axis: int) -> Column:
    """Middle x (axis 0) or y (axis 1) of [x1, y1, x2, y2]."""
    return (box[axis] + box[axis + 2]) / F.lit(2.0)


def present(value: Column, is_number: bool = False) -> Column:
    """True for a value that counts as filled in: not null, not '' and not 0."""
    filled = value.isNotNull() & ((value != F.lit(0)) if is_number else (value != F.lit("")))
    return F.coalesce(filled, F.lit(False))


def nested_value(path: str) -> Column:
    """Value at a dotted path, with '' read as missing."""
    return F.nullif(F.col(path), F.lit(""))
