"""Model responses to typed records: JSON out of free text, cleaned values, fallback, scores and prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.functions.values import MONEY, parse_date_any, parse_money, parse_percent, present

_PARTY = "STRUCT<name: STRING, vat_id: STRING, tax_id: STRING, address_line: STRING, city: STRING, postal_code: STRING, country_code: STRING>"
_RAW_LINE = "STRUCT<line_id: STRING, description: STRING, quantity: STRING, unit_code: STRING, unit_price: STRING, line_total: STRING, vat_category: STRING, vat_rate: STRING>"
_RAW_TAX = "STRUCT<taxable_amount: STRING, tax_amount: STRING, tax_rate: STRING, tax_category: STRING>"
_TERMS = "STRUCT<payment_due_date: STRING, payment_terms: STRING, bank_account: STRING, bank_name: STRING, swift_code: STRING>"

RAW_INVOICE = (
    "invoice_id STRING, issue_date STRING, invoice_type_code STRING, currency_code STRING,"
    " purchase_order_reference STRING, contract_reference STRING,"
    f" supplier {_PARTY}, customer {_PARTY}, invoice_lines ARRAY<{_RAW_LINE}>,"
    " total_excl_vat STRING, total_vat STRING, total_incl_vat STRING, payable_amount STRING,"
    f" tax_breakdown ARRAY<{_RAW_TAX}>, payment_terms {_TERMS}, detected_language STRING, ocr_confidence DOUBLE"
)


def json_text(response: Column) -> Column:
    """From the first '{' to the last '}'; code fences and prose around it fall away. Null when there is none."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def parsed_record(response: Column) -> Column:
    """Record of the raw, all-string schema, or null when the JSON does not parse."""
    body = json_text(response)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, RAW_INVOICE))


def clean_line(line: Column) -> Column:
    """Raw line strings as typed values."""
    return F.struct(
        line["line_id"].alias("line_id"),
        line["description"].alias("description"),
        parse_money(line["quantity"]).alias("quantity"),
        line["unit_code"].alias("unit_code"),
        parse_money(line["unit_price"]).alias("unit_price"),
        parse_money(line["line_total"]).alias("line_total"),
        line["vat_category"].alias("vat_category"),
        parse_percent_or_fraction(line["vat_rate"]).alias("vat_rate"),
    )


def parse_percent_or_fraction(text: Column) -> Column:
    """'19%' and '0.19' both as 0.19."""
    return F.when(text.contains("%"), parse_percent(text)).otherwise(parse_money(text).cast("decimal(9,6)"))


def clean_tax(row: Column) -> Column:
    return F.struct(
        parse_money(row["taxable_amount"]).alias("taxable_amount"),
        parse_money(row["tax_amount"]).alias("tax_amount"),
        parse_percent_or_fraction(row["tax_rate"]).alias("tax_rate"),
        row["tax_category"].alias("tax_category"),
    )


LINE_NUMBERS = ("quantity", "unit_price", "line_total", "vat_rate")
TAX_NUMBERS = ("taxable_amount", "tax_amount", "tax_rate")


def with_texts(row: Column, raw: Column, names: tuple[str, ...]) -> Column:
    """A typed row with the text of each number as <name>_raw."""
    for name in names:
        row = row.withField(f"{name}_raw", raw[name])
    return row


def typed_invoices(df: DataFrame, record: str) -> DataFrame:
    """Columns of the canonical invoice out of a raw record column; dates become ISO, money becomes decimal.
    The text of each number, in header, lines and tax rows, stays beside it as <name>_raw, so that validation can tell
    unreadable from missing."""
    r = lambda name: F.col(f"{record}.{name}")
    keep = ["invoice_id", "purchase_order_reference", "contract_reference", "supplier", "customer", "payment_terms",
            "detected_language", "ocr_confidence"]
    amounts = ["total_excl_vat", "total_vat", "total_incl_vat", "payable_amount"]
    day = parse_date_any(r("issue_date"), accept_slash_iso=False)
    return df.withColumns(
        {
            **{name: r(name) for name in keep},
            "issue_date": F.coalesce(F.date_format(day, "yyyy-MM-dd"), r("issue_date")),
            "invoice_type_code": F.coalesce(r("invoice_type_code"), F.lit("380")),
            "currency_code": F.coalesce(r("currency_code"), F.lit("EUR")),
            **{name: parse_money(r(name)) for name in amounts},
            **{f"{name}_raw": r(name) for name in amounts},
            "invoice_lines": F.transform(r("invoice_lines"), lambda x: with_texts(clean_line(x), x, LINE_NUMBERS)),
            "tax_breakdown": F.transform(r("tax_breakdown"), lambda x: with_texts(clean_tax(x), x, TAX_NUMBERS)),
        }
    )


def record_score(invoice_id: Column, issue_date: Column, has_supplier: Column, total: Column, n_lines: Column) -> Column:
    """Share of the four required fields, plus 0.1 for having lines, 1 at most, two decimals."""
    flags = [present(invoice_id), present(issue_date), F.coalesce(has_supplier, F.lit(False)), present(total, True)]
    share = sum((f.cast("int") for f in flags), F.lit(0)) / F.lit(4.0)
    bonus = F.when(n_lines > 0, F.least(F.lit(1.0), share + 0.1)).otherwise(share)
    return F.round(bonus, 2)


def structured(df: DataFrame, response: str, text: str) -> DataFrame:
    """Typed header of each response; texts whose response does not parse go through the fallback extraction."""
    parsed = df.withColumn("_record", parsed_record(F.col(response)))
    typed = typed_invoices(parsed, "_record")
    failed = F.col("_record").isNull()
    source = F.col(text)
    n_lines = F.coalesce(F.array_size("invoice_lines"), F.lit(0))
    by_model = record_score(
        F.col("invoice_id"), F.col("issue_date"), F.col("supplier").isNotNull(), F.col("total_incl_vat"), n_lines
    )
    # The guards keep the fallback patterns off the texts that do not need them.
    return typed.withColumns(
        {
            "n_lines": n_lines,
            "extraction_method": F.when(failed, "fallback").otherwise("model"),
            "confidence_score": F.when(failed, F.lit(0.3)).otherwise(by_model),
            "invoice_id": F.when(failed, tx.fallback_number(source)).otherwise(F.col("invoice_id")),
            "issue_date": F.when(failed, tx.fallback_date(source)).otherwise(F.col("issue_date")),
            "total_incl_vat": F.when(failed, tx.fallback_total(source).cast(MONEY)).otherwise(F.col("total_incl_vat")),
        }
    ).drop("_record")


RECORD_KINDS = {  # field: (required, kinds of JSON value it may have)
    "invoice_id": (True, ("STRING",)),
    "issue_date": (True, ("STRING",)),
    "supplier": (True, ("OBJECT",)),
    "total_incl_vat": (True, ("STRING", "BIGINT", "DECIMAL", "DOUBLE")),
    "customer": (False, ("OBJECT",)),
    "invoice_lines": (False, ("ARRAY",)),
    "tax_breakdown": (False, ("ARRAY",)),
}


def schema_reasons(record: Column) -> Column:
    """Why a parsed answer (VARIANT) is no invoice record: missing required fields and values of a wrong kind."""

    def reason(name: str, required: bool, kinds: tuple[str, ...]) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")), "^[A-Z]+", 0)
        missing = F.coalesce(kind == "VOID", F.lit(True))
        wrong = F.when(~missing & ~kind.isin(*kinds), f"{name}: has the wrong type")
        return F.when(missing, f"{name}: field is required").otherwise(wrong) if required else wrong

    kind = F.regexp_extract(F.schema_of_variant(record), "^[A-Z]+", 0)
    whole = F.when(kind != "OBJECT", "answer: is not an object")
    tests = [reason(name, *rule) for name, rule in RECORD_KINDS.items()]
    return F.array_compact(F.array(whole, *[F.when(kind == "OBJECT", t) for t in tests]))


def judged_responses(df: DataFrame, response: str) -> DataFrame:
    """Adds outcome, reasons, record and raw, from one parse of each answer: `model` where the record fits the schema,
    `raw` where the JSON is kept as it came because it does not (reasons tell why), `fallback` where there is no JSON."""
    parsed = df.withColumn("record", F.try_parse_json(json_text(F.col(response))))
    none = F.array().cast("array<string>")
    tested = parsed.withColumn("reasons", F.when(F.col("record").isNotNull(), schema_reasons(F.col("record"))).otherwise(none))
    outcome = F.when(F.col("record").isNull(), "fallback").when(F.size("reasons") > 0, "raw").otherwise("model")
    return tested.withColumns({"outcome": outcome, "raw": F.when(outcome == "raw", F.to_json("record"))})


def quality(ocr: Column, flags: dict[str, Column]) -> dict[str, Column]:
    """Required and complete shares of the record and the overall 0.3 / 0.4 / 0.3 mix. `flags` tell which of
    invoice_id, issue_date, supplier, customer, invoice_lines and total_incl_vat are filled."""
    required = ["invoice_id", "issue_date", "supplier", "total_incl_vat"]
    share = lambda names: sum((flags[n].cast("int") for n in names), F.lit(0)) / F.lit(float(len(names)))
    needed, complete = share(required), share(list(flags))
    return {
        "required_fields_present": needed,
        "data_completeness": complete,
        "overall_quality": ocr * 0.3 + needed * 0.4 + complete * 0.3,
    }


# --- prompts -------------------------------------------------------------------------------------------------------
PROMPTS = [  # kind, language, template, example
    ("extraction", "en", "Read the invoice below and answer with one JSON object of this shape:\n{schema}\n\nInvoice:\n{invoice_text}\n\nJSON:", "Invoice A-1, total 120.00 -> {\"invoice_id\": \"A-1\", \"total_incl_vat\": 120.00}"),
    ("extraction", "de", "Lies die folgende Rechnung und antworte mit einem JSON-Objekt dieser Form:\n{schema}\n\nRechnung:\n{invoice_text}\n\nJSON:", "Rechnung A-1, Gesamt 119,00 -> {\"invoice_id\": \"A-1\", \"total_incl_vat\": 119.00}"),
    ("extraction", "et", "Loe arvet ja vasta ühe JSON-objektiga, mille kuju on:\n{schema}\n\nArve:\n{invoice_text}\n\nJSON:", "Arve A-1, kokku 120,00 -> {\"invoice_id\": \"A-1\", \"total_incl_vat\": 120.00}"),
    ("line_items", "en", "List the item rows of this table as a JSON array:\n{invoice_text}\n\nJSON:", ""),
    ("line_items", "de", "Gib die Positionen dieser Tabelle als JSON-Array aus:\n{invoice_text}\n\nJSON:", ""),
    ("line_items", "et", "Esita selle tabeli read JSON-massiivina:\n{invoice_text}\n\nJSON:", ""),
    ("correction", "en", "These checks failed:\n{errors}\n\nCorrect the record and answer with JSON:\n{extracted_data}", ""),
    ("correction", "de", "Diese Prüfungen sind fehlgeschlagen:\n{errors}\n\nKorrigiere den Datensatz als JSON:\n{extracted_data}", ""),
    ("correction", "et", "Need kontrollid ebaõnnestusid:\n{errors}\n\nParanda kirje JSON-ina:\n{extracted_data}", ""),
    ("confidence", "en", "How sure are you of this record, from 0 to 1?\n{extracted_data}", ""),
    ("confidence", "de", "Wie sicher ist dieser Datensatz, von 0 bis 1?\n{extracted_data}", ""),
    ("confidence", "et", "Kui kindel see kirje on, 0 kuni 1?\n{extracted_data}", ""),
]


def prompt_template(kind: str, lang: Column, few_shot: bool = False) -> Column:
    """Template of a kind for a language, English where there is none. The handful of templates stay literals."""
    texts = {p[1]: (f"{p[3]}\n\n{p[2]}" if few_shot and p[3] else p[2]) for p in PROMPTS if p[0] == kind}
    choice = None
    for language, template in texts.items():
        choice = F.when(lang == language, template) if choice is None else choice.when(lang == language, template)
    return choice.otherwise(F.lit(texts["en"]))


def render(template: Column, **values: Column) -> Column:
    """Fills {name} placeholders. The document text goes in last, so braces in it are left alone."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def bullet_list(messages: Column) -> Column:
    return F.concat(F.lit("- "), F.array_join(messages, "\n- "))
