"""Invoice-shaped input views over the given tables, with seeded defects.

All are narrow or need one partially aggregated shuffle. No view gathers the rows of an order, user or document into
one array, so a hot key stays spread over its rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.operators import validation as v

AS_OF = "2001-01-01"  # the day that counts as today for invoice dates
LOG_NOW = "2024-01-30 00:00:00"  # the instant that counts as now for the activity log

COUNTRIES = list(fv.VAT_ID_SHAPES)
VAT_SHAPE = {  # country: text before the digits, number of digits, text after
    "DE": ("DE", 9, ""), "EE": ("EE", 9, ""), "GB": ("GB", 9, ""), "FR": ("FRAA", 9, ""), "IT": ("IT", 11, ""),
    "ES": ("ESA", 7, "B"), "NL": ("NL", 9, "B01"), "AT": ("ATU", 8, ""), "BE": ("BE", 10, ""), "PL": ("PL", 10, ""),
    "FI": ("FI", 8, ""), "SE": ("SE", 12, ""), "DK": ("DK", 8, ""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: str) -> str:
    """SQL that picks from a list of texts by a 0-based index; the same text runs on Spark and DuckDB."""
    cases = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {index} {cases} END"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by their key before costly work on each: a file of one row group is one task however long its rows
    take. Only the columns that the work needs should be selected before. The number of partitions is named, the session's
    own: without it adaptive execution merges partitions by their bytes, and narrow rows with costly work end in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def country(key: str) -> str:
    return pick(COUNTRIES, f"({key} % 13)")


def currency(key: str) -> str:
    return pick([fv.COUNTRY_CURRENCY[c] for c in COUNTRIES], f"({key} % 13)")


def vat_id(key: str) -> str:
    digits = f"lpad(CAST({key} % 1000000000000 AS VARCHAR(20)), 12, '0')"
    cases = " ".join(
        f"WHEN {i} THEN concat('{VAT_SHAPE[c][0]}', substr({digits}, {13 - VAT_SHAPE[c][1]}, {VAT_SHAPE[c][1]}), '{VAT_SHAPE[c][2]}')"
        for i, c in enumerate(COUNTRIES)
    )
    return f"CASE ({key} % 13) {cases} END"


LINE_COLUMNS = {
    "doc_key": "l_orderkey",
    "line_ref": "concat(l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "line_id": "CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE concat(l_linenumber, '-', l_partkey, '-', l_suppkey) END",
    "description": "CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN ' ' ELSE concat('Item ', l_partkey) END",
    "quantity": "CAST(l_quantity AS DECIMAL(18,4))",
    "unit_code": "CASE WHEN l_partkey % 97 = 0 THEN 'LONG-UNIT-CODE' ELSE 'C62' END",
    "unit_price": "CAST(l_extendedprice AS DECIMAL(18,4))",
    "line_total": "CAST(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,4)) AS DECIMAL(18,4))"
    " + CASE WHEN (l_orderkey + l_partkey) % 29 = 0 THEN CAST(1 AS DECIMAL(18,4)) ELSE CAST(0 AS DECIMAL(18,4)) END",
    "vat_category": "CASE WHEN l_partkey % 101 = 0 THEN 'Q' ELSE 'S' END",
    "vat_rate": "CAST(l_tax AS DECIMAL(9,6))",
    "l_linenumber": "l_linenumber",
    "l_suppkey": "l_suppkey",
}


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one row per lineitem."""
    return lines_of(table(spark, sf_dir, "lineitem"))


def lines_of(lineitem: DataFrame, *more: str) -> DataFrame:
    raw = lineitem.selectExpr(*[f"{sql} AS {name}" for name, sql in LINE_COLUMNS.items()], *more)
    return raw.withColumn("line_total", F.col("line_total").cast("decimal(18,4)"))


def line_inputs(lineitem: DataFrame) -> list[str]:
    """The columns of a lineitem that lines_of and lines_in read, but the order's key."""
    read = set(re.findall(r"\bl_\w+", " ".join(LINE_COLUMNS.values())))
    return [c for c in lineitem.columns if c in read and c != LINE_COLUMNS["doc_key"]]


def lines_in(array: str, doc_key: str) -> F.Column:
    """The lines of an order as an array of LINE_STRUCT, from the array of its lineitems."""
    def of_element(sql: str) -> str:
        return re.sub(r"\bl_\w+", lambda m: doc_key if m[0] == LINE_COLUMNS["doc_key"] else f"x.{m[0]}", sql)

    fields = ", ".join(f"'{name}', {of_element(LINE_COLUMNS[name])}" for name in ("line_ref", *LINE_FIELDS))
    return F.expr(f"transform({array}, x -> named_struct({fields}))").cast(f"array<{LINE_STRUCT}>")


def tax_rows(lines: DataFrame, **more: F.Column) -> DataFrame:
    """VAT breakdown of an invoice: one row per rate and category, with further line aggregates to carry along."""
    tax = F.round(F.col("line_total") * F.col("vat_rate"), 2)
    return lines.groupBy("doc_key", F.col("vat_rate").alias("tax_rate"), F.col("vat_category").alias("tax_category")).agg(
        F.sum("line_total").cast("decimal(18,4)").alias("taxable_amount"),
        F.sum(tax).cast("decimal(18,4)").alias("tax_amount"),
        *[c.alias(n) for n, c in more.items()],
    )


HEADER_COLUMNS = {
    "invoice_id": "CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN NULL"
    " ELSE concat('INV-', 100000000 + o_orderkey) END",
    "issue_date": "CASE WHEN o_orderkey % 37 = 0 THEN 'invalid-date' WHEN o_orderkey % 4 = 0 THEN iso_day"
    " WHEN o_orderkey % 4 = 1 THEN concat(substr(iso_day, 9, 2), '.', substr(iso_day, 6, 2), '.', substr(iso_day, 1, 4))"
    " WHEN o_orderkey % 4 = 2 THEN concat(substr(iso_day, 9, 2), '/', substr(iso_day, 6, 2), '/', substr(iso_day, 1, 4))"
    " ELSE concat(substr(iso_day, 1, 4), '/', substr(iso_day, 6, 2), '/', substr(iso_day, 9, 2)) END",
    "invoice_type_code": "CASE WHEN o_orderkey % 53 = 0 THEN '999' ELSE '380' END",
    "currency_code": "CASE WHEN o_orderkey % 41 = 0 THEN 'USD' WHEN o_orderkey % 43 = 0 THEN 'XXX'"
    f" ELSE {currency('supplier_key')} END",
    "purchase_order_reference": "CASE WHEN o_orderkey % 3 = 0 THEN concat('PO-', o_custkey) END",
    "contract_reference": "CASE WHEN o_orderkey % 5 = 0 THEN concat('CT-', o_custkey) END",
    "supplier_name": "concat('Supplier ', supplier_key)",
    "supplier_vat_id": f"CASE WHEN o_orderkey % 11 = 0 THEN 'X912' ELSE {vat_id('supplier_key')} END",
    "supplier_address_line": "concat('Street ', supplier_key)",
    "supplier_city": "concat('City ', supplier_key)",
    "supplier_postal_code": "'12345'",
    "supplier_country_code": f"CASE WHEN o_orderkey % 47 = 0 THEN 'XX' ELSE {country('supplier_key')} END",
    "customer_name": "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE concat('Customer ', o_custkey) END",
    "customer_vat_id": f"CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {vat_id('o_custkey')} END",
    "customer_address_line": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('Road ', o_custkey) END",
    "customer_city": "concat('City ', o_custkey)",
    "customer_postal_code": "'54321'",
    "customer_country_code": f"CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE {country('o_custkey')} END",
    "due_date": "CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 73 = 0 THEN 'soon'"
    " WHEN o_orderkey % 17 = 0 THEN iso_before ELSE iso_due END",
    "ocr_confidence": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END",
}


def _party(side: str) -> F.Column:
    names = ["name", "vat_id", "address_line", "city", "postal_code", "country_code"]
    return F.struct(*[F.col(f"{side}_{n}").alias(n) for n in names])


def _orders(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS doc_key",
        "o_orderkey",
        "o_custkey",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS iso_day",
        "date_format(o_orderdate + INTERVAL 30 DAYS, 'yyyy-MM-dd') AS iso_due",
        "date_format(o_orderdate - INTERVAL 1 DAY, 'yyyy-MM-dd') AS iso_before",
    )


def _terms() -> F.Column:
    return F.struct(F.col("due_date").alias("payment_due_date"), F.lit(None).cast("string").alias("payment_terms"))


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a header has from its order alone, for rules that need no lines: no shuffle, no second table."""
    orders = _orders(table(spark, sf_dir, "orders"))
    return orders.selectExpr(
        "doc_key", *[f"{HEADER_COLUMNS[name]} AS {name}" for name in ("invoice_id", "issue_date", "due_date")]
    ).select("doc_key", "invoice_id", "issue_date", _terms().alias("payment_terms"))


def order_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and customer of each order; of the lines only the smallest supplier key is taken."""
    suppliers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_key"))
    orders = _orders(table(spark, sf_dir, "orders")).join(suppliers.agg(F.min("l_suppkey").alias("supplier_key")), "doc_key", "left")
    known = orders.withColumn("supplier_key", F.coalesce("supplier_key", F.lit(0).cast(orders.schema["supplier_key"].dataType)))
    sides = ("supplier", "customer")
    flat = known.selectExpr("doc_key", *[f"{sql} AS {n}" for n, sql in HEADER_COLUMNS.items() if n.startswith(sides)])
    return flat.select("doc_key", *(_party(side).alias(side) for side in sides))


def line_summary(lines: DataFrame) -> DataFrame:
    """What a header takes from its lines and tax rows, one row per order that has lines."""
    return v.summarise_by_rate(tax_rows(lines, supplier_key=F.min("l_suppkey"), **v.line_sums()), "doc_key",
                               supplier_key=F.min("supplier_key"), vat_sum=F.sum("tax_amount"))


def invoice_headers(spark: SparkSession, sf_dir: str, summary: DataFrame | None = None) -> DataFrame:
    """V1: one header per order, carrying the summary of its lines and tax rows; zeros for an order without lines. `summary` is
    the line_summary where that has been written already."""
    summary = line_summary(invoice_lines(spark, sf_dir)) if summary is None else summary
    orders = _orders(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey"))
    amounts = ("line_sum", "vat_sum")
    counts = ("n_lines", "bad_lines", "line_errors", "bad_taxes", "tax_errors", "supplier_key")
    joined = orders.join(summary, "doc_key", "left").withColumns(
        {
            **{c: F.coalesce(c, F.lit(0).cast(summary.schema[c].dataType)) for c in (*amounts, *counts)},
        }
    )
    flat = joined.selectExpr(
        "doc_key",
        *[f"{sql} AS {name}" for name, sql in HEADER_COLUMNS.items()],
        "n_lines", "line_sum", "bad_lines", "line_errors", "bad_taxes", "tax_errors",
        "CAST(line_sum + CASE WHEN o_orderkey % 83 = 0 THEN 0.5 * line_sum ELSE 0 END AS DECIMAL(18,4)) AS total_excl_vat",
        "CAST(vat_sum AS DECIMAL(18,4)) AS total_vat",
        "CAST(line_sum + vat_sum + CASE WHEN o_orderkey % 7 = 0 THEN 5 WHEN o_orderkey % 89 = 0 THEN line_sum ELSE 0 END AS DECIMAL(18,4)) AS total_incl_vat",
        "CAST(line_sum + vat_sum - CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS payable_amount",
    )
    return flat.select(
        "*",
        _party("supplier").alias("supplier"),
        _party("customer").alias("customer"),
        _terms().alias("payment_terms"),
    ).drop(*[f"{s}_{n}" for s in ("supplier", "customer") for n in ("name", "vat_id", "address_line", "city", "postal_code", "country_code")], "due_date")


# --- texts ---------------------------------------------------------------------------------------------------------
INVOICE_WORD = ["Invoice No", "Rechnung Nr", "Arve nr"]
DATE_WORD = ["Date", "Datum", "Kuupäev"]
TOTAL_WORD = ["Total", "Gesamt", "Kokku"]
VAT_WORD = ["VAT", "MwSt", "Käibemaks"]
FIRST_NAMES = ["Alpha", "Beta", "Gamma", "Delta", "Omega", "Öko", "Nord"]
TRADES = ["Trading", "Software", "Services", "Logistics & Partners", "Foods"]


def text_sql(day: str, long_day: str, us_day: str, us_number: str) -> str:
    """SQL text of a printed invoice for one order; the four arguments are engine-specific date and number texts."""
    dotted = f"concat(substr({day}, 9, 2), '.', substr({day}, 6, 2), '.', substr({day}, 1, 4))"
    slashed = f"replace({dotted}, '.', '/')"
    dashed = f"replace({dotted}, '.', '-')"
    printed_day = (
        f"CASE o_orderkey % 6 WHEN 0 THEN {day} WHEN 1 THEN {dotted} WHEN 2 THEN {slashed} WHEN 3 THEN {dashed}"
        f" WHEN 4 THEN {long_day} ELSE {us_day} END"
    )
    number = f"CASE WHEN o_orderkey % 3 = 0 THEN {us_number} ELSE translate({us_number}, ',.', '.,') END"
    printed = (
        f"CASE o_orderkey % 5 WHEN 0 THEN concat('€ ', {number}) WHEN 1 THEN concat({number}, ' €')"
        f" WHEN 2 THEN concat({number}, ' EUR') WHEN 3 THEN concat('$', {number}) ELSE {number} END"
    )
    nl = "chr(10)"
    parts = [
        pick(INVOICE_WORD, "(o_orderkey % 3)"), "': INV-'", "100000000 + o_orderkey", nl,
        pick(DATE_WORD, "(o_orderkey % 3)"), "': '", printed_day, nl,
        pick(FIRST_NAMES, "(o_custkey % 7)"), "' '", pick(TRADES, "(o_custkey % 5)"), "' '",
        pick(fv.LEGAL_FORMS, "(o_custkey % 22)"), nl,
        "'12345 Test City'", "chr(13)", nl, "'SW1A 1AA London Road'", nl, nl, nl, nl,
        "'VAT ID: '", vat_id("o_custkey"), nl,
        "'billing'", "o_custkey", "'@example.com, +49 30'", "1000000 + o_custkey", nl,
        pick(VAT_WORD, "(o_orderkey % 3)"), "' (19%): 1.50'", nl,
        "'Sub'", "lower(" + pick(TOTAL_WORD, "(o_orderkey % 3)") + ")", "': 10.00'", nl,
        pick(TOTAL_WORD, "(o_orderkey % 3)"), "': '", printed,
    ]
    return "concat(" + ", ".join(parts) + ")"


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one printed invoice per order, in three languages and six date forms."""
    text = text_sql(
        "date_format(o_orderdate, 'yyyy-MM-dd')",
        "date_format(o_orderdate, 'd MMMM yyyy')",
        "date_format(o_orderdate, 'MMMM d, yyyy')",
        "format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)",
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    return orders.selectExpr("concat('I', o_orderkey) AS doc_id", f"{text} AS text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed invoices and all documents."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").selectExpr("concat('D', doc_id) AS doc_id", "text")
    return invoice_texts(spark, sf_dir).unionAll(documents)


# --- tokens and cells ----------------------------------------------------------------------------------------------
PAGE_TOKENS = 240


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the words of every document laid on pages of 30 rows by 8 columns, with jitter in y."""
    words = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("i", "text")
    )
    placed = words.selectExpr(
        "doc_id",
        f"CAST(i DIV {PAGE_TOKENS} AS INT) + 1 AS page_no",
        "CAST(i AS BIGINT) AS elem_id",
        "text",
        "CAST((doc_id * 31 + i * 17) % 100 AS DOUBLE) / 100 AS confidence",
        f"CAST(50 + 150 * (i % 8) AS DOUBLE) AS x",
        f"CAST(100 + 30 * ((i % {PAGE_TOKENS}) DIV 8) - CASE WHEN ((i % {PAGE_TOKENS}) DIV 8) % 3 = 2 THEN 18 ELSE 0 END"
        " + (i * 7) % 5 AS DOUBLE) AS y",
    )
    return placed.selectExpr(
        "*", "array(array(x, y), array(x + 100, y), array(x + 100, y + 20), array(x, y + 20)) AS polygon",
        "array(x, y, x + 100, y + 20) AS box", "x + 50 AS cx", "y + 10 AS cy",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: table cells over the token grid: three columns by fifteen rows per page, the last page's table short."""
    pages = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").selectExpr(
        "doc_id",
        rf"explode(sequence(1, 1 + CAST((size(regexp_extract_all(text, '\\S+', 0)) - 1) DIV {PAGE_TOKENS} AS INT))) AS page_no",
    )
    return (
        pages.selectExpr("doc_id", "page_no", "1 AS table_id", "explode(sequence(0, 44)) AS cell_id")
        .selectExpr(
            "doc_id", "page_no", "table_id", "CAST(cell_id AS BIGINT) AS cell_id",
            "CAST(40 + 420 * (cell_id % 3) AS DOUBLE) AS x1",
            "CAST(96 + 60 * (cell_id DIV 3) + (cell_id * 5) % 9 AS DOUBLE) AS y1",
        )
        .selectExpr("*", "x1 + 400 AS x2", "y1 + 55 AS y2")
    )


# --- tables in HTML ------------------------------------------------------------------------------------------------
HTML_HEADERS = [
    ["Description", "Qty", "Unit Price", "Total Amount", "VAT"],
    ["Beschreibung", "Menge", "Einzelpreis", "Gesamt", "MwSt"],
    ["Kirjeldus", "Kogus", "Hind", "Kokku", "Käibemaks"],
    ["Random", "Headers", "Without", "Any", "Meaning"],
]


def header_html(index: str) -> str:
    return pick(["<tr>" + "".join(f"<th>{h}</th>" for h in hs) + "</tr>" for hs in HTML_HEADERS], index)


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: every document as a table with one row per sentence; some rows are short or have no description."""
    number = "format_number(CAST(length(s) * 37 + i AS DECIMAL(18,2)) * 1.05, 2)"
    local = f"CASE WHEN doc_id % 2 = 0 THEN {number} ELSE translate({number}, ',.', '.,') END"
    row = (
        "concat('<tr><td class=\"d\">', CASE WHEN i % 13 = 6 THEN '<b> </b>' ELSE concat('<b> ',"
        " trim(regexp_replace(s, '[<>&]', '')), ' </b>') END, '</td><td>', i % 9 + 1, '</td>',"
        f" CASE WHEN i % 11 = 5 THEN '' ELSE concat('<td>€', {local}, '</td><td>', {local}, '</td><td>',"
        " CASE i % 3 WHEN 0 THEN '19%' WHEN 1 THEN '7.5 %' ELSE 'none' END, '</td>') END, '</tr>')"
    )
    sentences = r"regexp_extract_all(text, '[^.\\n]+', 0)"
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").selectExpr(
        "doc_id",
        f"concat('<table>', {header_html('(doc_id % 4)')}, array_join(transform({sentences}, (s, i) -> {row}), ''), '</table>') AS html",
    )


# --- model responses -----------------------------------------------------------------------------------------------
def response_json_sql(day: str) -> str:
    """SQL text of one model answer per order: header and up to two lines."""
    q = "chr(34)"

    def field(name: str, value: str, quoted: bool = True) -> str:
        return f"'\"{name}\": ', " + (f"{q}, {value}, {q}" if quoted else value)

    line = (
        "concat('{\"description\": \"', o_orderpriority, '\", \"quantity\": \"2\", \"unit_price\": \"€50.00\","
        " \"line_total\": \"100,00\", \"vat_rate\": \"19%\"}')"
    )
    lines = f"concat('[', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN {line} ELSE concat({line}, ', ', {line}) END, ']')"
    dotted = f"concat(substr({day}, 9, 2), '.', substr({day}, 6, 2), '.', substr({day}, 1, 4))"
    return (
        "concat('{', " + field("invoice_id", "concat('INV-', 100000000 + o_orderkey)") + ", ', ', "
        + field("issue_date", f"CASE WHEN o_orderkey % 2 = 0 THEN {day} ELSE {dotted} END") + ", ', ', "
        + f"'\"supplier\": {{\"name\": \"Supplier ', o_custkey, '\", \"country_code\": \"', {country('o_custkey')}, '\"}}, ', "
        + field("total_incl_vat", "CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END", False)
        + ", ', ', " + f"'\"invoice_lines\": ', {lines}, '}}')"
    )


def response_sql(day: str) -> str:
    """The answer bare, in prose, in a code fence, or cut off."""
    body = response_json_sql(day)
    fence = "concat(chr(96), chr(96), chr(96))"
    return (
        f"CASE WHEN o_orderkey % 23 = 0 THEN concat('Sorry: ', substr({body}, 1, 40))"
        f" WHEN o_orderkey % 4 = 1 THEN concat('Here is the data:', chr(10), {body}, chr(10), 'Done.')"
        f" WHEN o_orderkey % 4 = 2 THEN concat({fence}, 'json', chr(10), {body}, chr(10), {fence})"
        f" ELSE {body} END"
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: one model answer per order beside the text it was made from."""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    text = text_sql(day, "date_format(o_orderdate, 'd MMMM yyyy')", "date_format(o_orderdate, 'MMMM d, yyyy')",
                    "format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)")
    given = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    orders = spread(given, "o_orderkey")
    return orders.selectExpr(
        "o_orderkey AS doc_key",
        "CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'et' ELSE 'fr' END AS lang",
        f"{response_sql(day)} AS response",
        f"{text} AS text",
    )


# --- activity log --------------------------------------------------------------------------------------------------
def perf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 log: one processing-log entry per event."""
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "event_type AS operation", "value AS duration", "CAST(ts AS TIMESTAMP) AS ts", "event_type <> 'error' AS success", "user_id"
    )


METRIC_NAMES = {
    "click": "cpu_usage",
    "view": "memory_usage",
    "signup": "disk_usage",
    "purchase": "gpu_memory_usage",
    "error": "queue_length",
}


def metric_sql() -> str:
    cases = " ".join(f"WHEN '{event}' THEN '{metric}'" for event, metric in METRIC_NAMES.items())
    return f"CASE event_type {cases} END"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10: one metric sample per event, for 40 hosts."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", f"{metric_sql()} AS metric", "concat('host', user_id % 40) AS host", "CAST(ts AS TIMESTAMP) AS ts", "value"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: one API request per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('10.0.0.', user_id) AS client", "'POST' AS method", "concat('/', event_type) AS path", "ts"
    )


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: measured page quality from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS page_key",
        "(p_retailprice - 900) * 2 AS sharpness",
        "CAST(p_size AS DOUBLE) AS contrast",
        "CAST(p_partkey % 256 AS DOUBLE) AS brightness",
    )


FILE_EXTENSIONS = [".pdf", ".JPG", ".jpeg", ".png", ".tiff", ".bmp", ".txt", ".docx"]


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11: one uploaded file per document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        f"CASE WHEN doc_id % 50 = 49 THEN '' ELSE concat(source, '_', doc_id, {pick(FILE_EXTENSIONS, '(doc_id % 8)')}) END AS filename",
        "n_chars * 5000 AS length",
        "CAST('2024-01-01 00:00:00' AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(doc_id % 2000 AS INT), 0, 0) AS modificationTime",
    )


# --- printed numbers -----------------------------------------------------------------------------------------------
def printed_number_sql(us_number: str) -> str:
    """One of eleven printed forms of an amount, some of them unreadable."""
    eu = f"translate({us_number}, ',.', '.,')"
    forms = [us_number, eu, f"concat('€', {us_number})", f"concat('-', {eu}, ' EUR')", f"replace({us_number}, '.', '')",
             f"replace({eu}, ',', '')", "'12.'", "',5'", "'1-2'", "'none'", "concat(o_orderkey % 100, ',', o_custkey % 1000)"]
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return f"CASE o_orderkey % 11 {cases} END"


PRINTED_PERCENT = "CASE o_orderkey % 4 WHEN 0 THEN '19%' WHEN 1 THEN concat(o_custkey % 30, ',5 %') WHEN 2 THEN 'invalid' ELSE concat(o_custkey % 30, '.25') END"


# --- merged parts --------------------------------------------------------------------------------------------------
PROMPT_SCHEMA = '{"invoice_id": "text", "issue_date": "YYYY-MM-DD", "total_incl_vat": "number"}'


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read from tables: every line. Orders without lines have those of the model only."""
    lines = invoice_lines(spark, sf_dir)
    return lines.select("doc_key", (F.col("l_linenumber") % 2).alias("table_id"), "description", "line_total")


def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order as a model would give it."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_key", "o_orderpriority AS description", "CAST(o_totalprice AS DECIMAL(18,4)) AS line_total"
    )


def paged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 with a page number."""
    return invoice_lines(spark, sf_dir).withColumn("page_no", ((F.col("l_linenumber") + 2) / 3).cast("int"))


def page_headers(lines: DataFrame) -> DataFrame:
    """One header per page. A third of the documents has a right net total, a third none, a third a wrong one."""
    per_page = lines.groupBy("doc_key", "page_no").agg(F.sum("line_total").alias("s"), F.max("l_suppkey").alias("k"))
    return per_page.selectExpr(
        "doc_key", "page_no",
        "CAST(CASE doc_key % 3 WHEN 0 THEN s WHEN 1 THEN NULL ELSE s + 7 END AS DECIMAL(18,4)) AS total_excl_vat",
        "CAST(CASE WHEN k % 2 = 0 THEN 3 END AS DECIMAL(18,4)) AS total_vat",
        "CAST(s AS DECIMAL(18,4)) AS total_incl_vat",
    )


# --- nested invoices -----------------------------------------------------------------------------------------------
LINE_FIELDS = ["line_id", "description", "quantity", "unit_code", "unit_price", "line_total", "vat_category", "vat_rate"]


LINE_STRUCT = (
    "struct<line_ref:string,line_id:string,description:string,quantity:decimal(18,4),unit_code:string,"
    "unit_price:decimal(18,4),line_total:decimal(18,4),vat_category:string,vat_rate:decimal(9,6)>"
)


def nested_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested invoices with all their lines (0 to 7) and tax rows as arrays, the lines in the order of line_ref.
    For records that come nested, as from JSON; tables of lines are judged as they are (invoice_headers)."""
    lines = invoice_lines(spark, sf_dir)
    taxes = tax_rows(lines)
    of_lines = lines.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("line_ref", *LINE_FIELDS))).alias("invoice_lines"))
    of_taxes = taxes.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct(*v.TAX_FIELDS))).alias("tax_breakdown"))
    headers = invoice_headers(spark, sf_dir).drop("n_lines", "line_sum", "bad_lines", "line_errors", "bad_taxes", "tax_errors")
    both = headers.join(of_lines, "doc_key", "left").join(of_taxes, "doc_key", "left")
    arrays = ("invoice_lines", "tax_breakdown")
    return both.withColumns({c: F.coalesce(c, F.array().cast(both.schema[c].dataType)) for c in arrays})


# --- single-line invoices ------------------------------------------------------------------------------------------
def line_invoices(lines: DataFrame) -> DataFrame:
    """One nested invoice per line: narrow, so it also runs on a stream of lines."""
    vat = "CAST(round(line_total * vat_rate, 2) AS DECIMAL(18,4))"
    party = "named_struct('name', '{0} A', 'vat_id', CAST(NULL AS STRING), 'address_line', CAST(NULL AS STRING), 'city', CAST(NULL AS STRING), 'postal_code', CAST(NULL AS STRING), 'country_code', 'DE')"
    return lines.selectExpr(
        "doc_key", "line_ref", "concat('L-', doc_key, '-', line_ref) AS invoice_id", "'1999-01-15' AS issue_date",
        "'380' AS invoice_type_code", "'EUR' AS currency_code", "CAST(NULL AS STRING) AS purchase_order_reference",
        "CAST(NULL AS STRING) AS contract_reference", f"{party.format('Supplier')} AS supplier", f"{party.format('Customer')} AS customer",
        "array(named_struct('line_id', line_id, 'description', description, 'quantity', quantity, 'unit_code', unit_code,"
        " 'unit_price', unit_price, 'line_total', line_total, 'vat_category', vat_category, 'vat_rate', vat_rate)) AS invoice_lines",
        "line_total AS total_excl_vat", f"{vat} AS total_vat", f"CAST(line_total + {vat} AS DECIMAL(18,4)) AS total_incl_vat",
        f"CAST(line_total + {vat} AS DECIMAL(18,4)) AS payable_amount",
        f"array(named_struct('taxable_amount', line_total, 'tax_amount', {vat}, 'tax_rate', vat_rate, 'tax_category', 'S')) AS tax_breakdown",
        "named_struct('payment_due_date', '1999-02-15', 'payment_terms', CAST(NULL AS STRING)) AS payment_terms",
    )
