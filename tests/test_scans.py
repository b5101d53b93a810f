"""Texts are cut into stretches by cheap patterns first; the results are those of searching whole texts with plain patterns."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions import text as tx

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
PIECES = [
    "GmbH", "A/S", "AG", " ", " ", "\n", "\r\n", "\u3000", "\x85", "Foo", "Äx", "é", "Ž", "😀", "€", "₽", "$", "EUR", "12", "1.234,56", "May",
    "3 june 2020", "2020", ",", "5", "a.b@x.de", "@", "+49", "(030)", "12345", "-", "AB", "SW1A 1AA", "DE123456789", "|", "_",
]


def _plain(text):
    """The same fields, searched in whole texts with the patterns spelled out."""
    bounded = lambda p: p.replace(r"\b", BOUNDARY)
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    postal = "|".join(f"(?:{bounded(p)})" for p in fv.POSTAL_PATTERNS)
    holding = F.filter(lines, lambda line: (F.length(line) > 10) & line.rlike(postal))
    collapsed = F.transform(holding, lambda line: F.trim(F.regexp_replace(line, SPACE + "+", " ")))
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(bounded(p)), F.lit(0)) for p in fv.PHONE_PATTERNS])
    dialled = F.filter(hits, lambda h: F.length(F.regexp_replace(h, "[^0-9+]", "")) >= 7)
    return {
        "emails": F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(bounded(fv.EMAIL_PATTERN)), F.lit(0)))),
        "addresses": F.array_sort(F.array_distinct(collapsed)),
        "phones": F.array_sort(F.array_distinct(F.transform(dialled, lambda h: F.trim(h)))),
        "amounts": tx.amount_candidates(text),
        "vat_ids": tx.vat_ids(text),
    }


def test_cut_texts_give_the_fields_of_whole_texts(spark):
    dice = random.Random(11)
    rows = [(i, "".join(dice.choice(PIECES) for _ in range(dice.randint(0, 14)))) for i in range(3000)]
    text = F.col("t")
    cut = {
        "emails": tx.emails(text), "addresses": tx.address_lines(text), "phones": tx.phones(text),
        "amounts": tx.amount_candidates(tx.number_chains(text)), "vat_ids": tx.vat_ids(tx.long_runs(text)),
    }
    both = spark.createDataFrame(rows, "i int, t string").select("t", *[F.struct(cut[k].alias("cut"), p.alias("plain")).alias(k) for k, p in _plain(text).items()])
    for row in both.collect():
        for kind in cut:
            assert row[kind]["cut"] == row[kind]["plain"], (kind, row["t"])


def test_whole_texts_are_scanned_by_tables_of_bits_only():
    for pattern in (tx.NUMBER_CHAIN, tx.NAME_RUN, tx.MAIL_PART, tx.LONG_RUN, tx.AFTER_MONTH, tx.DIGIT_LINE):
        assert not re.search(r"\\[sSpPwWdD]|\[\^?[a-zA-Z]-[a-zA-Z]", pattern), pattern


def test_missing_texts(spark):
    row = spark.createDataFrame([(None,), ("",)], "t string").select(tx.long_runs(F.col("t")).alias("r"), tx.vat_ids(tx.long_runs(F.col("t"))).alias("v")).collect()
    assert (row[0].r, row[0].v, row[1].r, row[1].v) == (None, None, "", [])


def test_array_functions_search_without_rlike(spark):
    """rlike inside an array function is interpreted, and decodes its long pattern again for every value."""
    text = F.col("t")
    df = spark.createDataFrame([("Foo GmbH, 3 june 2020, +49 301234567, a.b@x.de",)], "t string")
    for found in (tx.companies(text), tx.dates(text), tx.phones(text), tx.emails(text), tx.address_lines(text)):
        assert "RLIKE" not in df.select(found)._jdf.queryExecution().analyzed().toString()


def test_numeric_dates_against_the_calendar(spark):
    """Days that no calendar has, the year 0 and the first and last years, in all four printed forms."""
    dice, forms = random.Random(3), ("{0:04}-{1:02}-{2:02}", "{2:02}.{1:02}.{0:04}", "{2:02}/{1:02}/{0:04}", "{2:02}-{1:02}-{0:04}")
    rows, wanted = [], {}
    for i in range(400):
        days = [(dice.choice([0, 1, 1582, 1900, 2000, 2023, 2024, 9999]), dice.randint(0, 13), dice.randint(0, 32)) for _ in range(3)]
        found = set()
        for y, m, d in days:
            try:
                found.add(f"{date(y, m, d).year:04}-{m:02}-{d:02}")
            except ValueError:
                continue
        rows.append((i, " ; ".join(dice.choice(forms).format(*day) for day in days)))
        wanted[i] = sorted(found)
    df = spark.createDataFrame([*rows, (-1, None), (-2, "")], "i int, t string")
    got = {r.i: r.d for r in df.select("i", tx.dates(F.col("t"), tx.digit_groups(F.col("t"))).alias("d")).collect()}
    assert got.pop(-1) is None and got.pop(-2) == []
    assert got == wanted
