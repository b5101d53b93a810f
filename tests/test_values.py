from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.functions import values as val


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [("123", "123"), ("123.45", "123.45"), ("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("", None),
     ("abc", None), ("€123.45", "123.45"), ("$1,234.56", "1234.56"), ("123,45", "123.45"), (",5", "0.5"),
     ("12.", "12"), ("1-2", None), ("-5,5", "-5.5"), ("1.234", "1.234"), ("1.234.567", None), ("1,234,567", "1234567"),
     ("1.234.567,89", "1234567.89"), (None, None)],
)
def test_parse_money(spark, text, expected):
    got = one(spark, val.parse_money(F.col("s")), s=text)
    assert got == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize("text, expected", [("€123.45", "123.45"), ("invalid", "0"), (None, "0"), ("-1.234,5", "-1234.5")])
def test_money_or_zero(spark, text, expected):
    assert one(spark, val.money_or_zero(F.col("s")), s=text) == Decimal(expected)


@pytest.mark.parametrize("text, expected", [("19%", "0.19"), ("20.5%", "0.205"), ("invalid", None)])
def test_parse_percent(spark, text, expected):
    got = one(spark, val.parse_percent(F.col("s")), s=text)
    assert got == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize("text", ["2024-01-15", "15.01.2024", "15/01/2024", "15-01-2024", "2024/01/15", "15.1.2024"])
def test_dates_parse(spark, text):
    assert str(one(spark, val.parse_date_any(F.col("s")), s=text)) == "2024-01-15"


@pytest.mark.parametrize("text", ["invalid-date", "", None, "2024-02-30", "15.01/2024", "0000-01-01", "2024-01-15x"])
def test_dates_refused(spark, text):
    assert one(spark, val.parse_date_any(F.col("s")), s=text) is None


def test_centers(spark):
    row = spark.range(1).select(
        val.polygon_center(F.expr("array(array(0D,0D),array(100D,0D),array(100D,50D),array(0D,50D))"), 0).alias("px"),
        val.polygon_center(F.expr("array(array(0D,0D),array(100D,0D),array(100D,50D),array(0D,50D))"), 1).alias("py"),
        val.rectangle_center(F.expr("array(0D,0D,100D,50D)"), 0).alias("bx"),
        val.rectangle_center(F.expr("array(0D,0D,100D,50D)"), 1).alias("by"),
    ).first()
    assert tuple(row) == (50.0, 25.0, 50.0, 25.0)


INVOICE = """
    INVOICE #INV-2024-001

    Date: 15.01.2024

    From:
    Test Company GmbH
    Test Street 123
    12345 Test City
    VAT ID: DE123456789

    To:
    Customer Ltd
    Customer Road 456
    54321 Customer City
    VAT ID: EE987654321

    Description         Qty    Price    Total
    Software License    1      100.00   100.00
    Support Services    1       50.00    50.00

    Subtotal:                           150.00
    VAT (19%):                           28.50
    Total:                              178.50
    """


def test_invoice_text(spark):
    from tallyspark.operators import extraction

    df = spark.createDataFrame([("a", INVOICE)], "doc_id string, text string")
    row = extraction.key_data(df, "text").first()
    assert row.invoice_number == "INV-2024-001"
    assert row.dates == ["2024-01-15"]
    assert [float(a.amount) for a in row.amounts] == [178.5, 150.0, 100.0, 50.0, 28.5, 15.01]
    assert {a.currency for a in row.amounts} == {"EUR"}
    assert [(v.vat_id, v.country) for v in row.vat_ids] == [("DE123456789", "DE"), ("EE987654321", "EE")]
    assert row.companies == ["Test Company GmbH", "Customer Ltd"]
    assert row.emails == [] and row.phone_numbers == []
    assert row.language == "en"
    assert extraction.fallback_record(df, "text").first().total_incl_vat == Decimal("178.50")
    lines = one(spark, tx.address_lines(F.col("s")), s=INVOICE)
    assert lines == ["12345 Test City", "54321 Customer City"]


@pytest.mark.parametrize(
    "text, expected",
    [("due 5 March 2024 or March 6, 2024", ["2024-03-05", "2024-03-06"]), ("7 MAY  2023", ["2023-05-07"]),
     ("31.02.2024 and 2024-13-01", []), ("1 maybe 2024", []), ("2024-01-15 15/01/2024", ["2024-01-15"])],
)
def test_date_forms(spark, text, expected):
    assert one(spark, tx.dates(F.col("s")), s=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("€ 5,00 and 5,00 EUR", [("5", "EUR")]), ("100 eur", []), ("$1,234.56", [("1234.56", "USD"), ("1234.56", "EUR")]),
     ("1 234,56 €", [("1234.56", "EUR"), ("234.56", "EUR")]), ("0,00 €", [])],
)
def test_amount_forms(spark, text, expected):
    from tallyspark.operators import extraction

    df = spark.createDataFrame([(text,)], "text string")
    got = extraction.with_amounts(df, "text").first().amounts
    assert [(a.amount, a.currency) for a in got] == [(Decimal(a), c) for a, c in expected]


@pytest.mark.parametrize("text, expected", [("INVOICE: €5", "EUR"), ("total: $123.45", "USD"), ("£123.45", "GBP"), ("none", "EUR")])
def test_currency(spark, text, expected):
    assert one(spark, tx.document_currency(F.col("s")), s=text) == expected


def test_clean_text(spark):
    assert one(spark, tx.clean_text(F.col("s")), s=" a \n b  ﬁne ") == "a b fine"
    assert one(spark, tx.clean_text(F.col("s")), s=None) == ""
    assert one(spark, tx.normalize_newlines(F.col("s")), s="a\r\nb\rc\n\n\n\nd") == "a\nb\nc\n\nd"


def test_strict_invoice_number(spark):
    text = "Invoice Date: 2024, no. 7731"
    assert one(spark, tx.invoice_number(F.col("s")), s=text) == "Date"
    assert one(spark, tx.invoice_number(F.col("s"), strict=True), s=text) == "7731"


def test_similarity(spark):
    from tallyspark.operators import extraction

    texts = spark.createDataFrame([(1, "The cat, the dog"), (2, "the CAT sat"), (3, "")], "id int, t string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left int, right int")
    got = {(r.left, r.right): r.similarity for r in extraction.pair_similarity(texts, pairs, "id", "t").collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.0}


def test_amounts_and_dates_need_only_the_stretches_that_hold_digits(spark):
    odd = ["12 \u20ac 13 \u20ac14", "\u20ac\u20ac 5.00$6,50 EUR7", "   \n 1.234,56\u00a0EUR 9 USDEUR 3", "EUR", "\u20ac", "", None, ".,. 1", "$ . , 4 GBP5|6 NOK",
           "2024-01-02.2024-03-04 5.6.2024 01/02/2024-03-04-2024", "x 9" + " " * 20000 + "8.50 \u00a3", "1-2,50 PLN\u20b9 7 7", "12.12.2024 12 May 2024 2024-1-1"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    text = F.col("text")
    whole = df.select(tx.amount_candidates(text).alias("c"), tx.dates(text).alias("d"))
    cut = df.withColumns({"n": tx.number_chains(text), "g": tx.digit_groups(text)})
    short = cut.select(tx.amount_candidates(F.col("n")).alias("c"), tx.dates(text, F.col("g")).alias("d"))
    assert whole.collect() == short.collect()
