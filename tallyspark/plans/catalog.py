"""Registered queries: each reads the given tables whole and applies one operator."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions import text as tx
from tallyspark.functions import values as val
from tallyspark.operators import activity, extraction, files, layout, merging, quotas, responses, tables, validation
from tallyspark.plans import views as w
from tallyspark.sources import folders
from tallyspark.streaming import activity as live
from tallyspark.streaming import invoices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DEALT_BY_PAGE = ["token_cell_join"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = _with_small_methods(fn)
    return fn


def _with_small_methods(fn: Query) -> Query:
    """Java compiles no method of over 8,000 bytes; Spark's own limit is the largest that Java can load. Rules, dates and
    patterns in one generated method are over it and would be interpreted row by row; under this limit Spark splits them.

    Queries of DEALT_BY_PAGE join rows that already lie together by a part of the join's keys, so these need no shuffle of their own."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(fn.__name__ not in DEALT_BY_PAGE).lower())
        return fn(spark, sf)

    return run


def joined(array: str | Column, sep: str = "|") -> Column:
    return F.array_join(array, sep)


# --- validation ----------------------------------------------------------------------------------------------------
@query
def validate_invoices(spark: SparkSession, sf: str) -> DataFrame:
    judged = validation.validate(w.invoice_headers(spark, sf), w.AS_OF)
    return judged.select(
        "doc_key", "is_valid", "n_errors",
        joined(F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["message"]))).alias("header_errors"),
        joined("warnings").alias("warnings"),
        *[F.round(c, 6).alias(c) for c in ("completeness_score", "consistency_score", "confidence_score")],
    )


def _error_texts() -> Column:
    def text(e: Column) -> Column:
        rows = F.when(e["first"].isNull(), "").otherwise(F.concat(F.lit(" x"), e["n"].cast("string"), F.lit(" from "), e["first"]))
        return F.concat(e["field"], F.lit(": "), e["message"], rows)

    return F.transform("all_errors", text)


@query
def validate_whole_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Every broken rule of an invoice's header, lines and tax rows in one list."""
    lines = w.invoice_lines(spark, sf)
    judged = validation.validate_whole(w.invoice_headers(spark, sf), lines, w.tax_rows(lines), "doc_key", w.AS_OF)
    return judged.select("doc_key", "is_valid", "n_errors", joined(_error_texts()).alias("errors"))


def _header_rows(spark: SparkSession, sf: str, rules: Callable) -> DataFrame:
    headers = validation.prepared(w.invoice_headers(spark, sf))
    return validation.broken_rows(headers, ["doc_key"], rules(headers))


@query
def rule_schema(spark: SparkSession, sf: str) -> DataFrame:
    of_headers = _header_rows(spark, sf, validation.header_schema_rules)
    lines = w.invoice_lines(spark, sf)
    of_lines = validation.broken_rows(lines, ["doc_key"], validation.line_schema_rules(F.col), validation.line_prefix())
    return of_headers.unionByName(of_lines)


@query
def rule_schema_tax_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The schema rules of tax rows; their arithmetic is rule_tax_calc."""
    taxes = w.tax_rows(w.invoice_lines(spark, sf))
    return validation.broken_rows(taxes, ["doc_key"], validation.tax_schema_rules(F.col), validation.tax_prefix())


@query
def rule_invoice_number(spark: SparkSession, sf: str) -> DataFrame:
    return validation.broken_rows(w.order_headers(spark, sf), ["doc_key"], validation.number_and_vat_rules()[:1])


@query
def rule_vat_id(spark: SparkSession, sf: str) -> DataFrame:
    return validation.broken_rows(w.order_parties(spark, sf), ["doc_key"], validation.number_and_vat_rules()[1:])


@query
def rule_line_total(spark: SparkSession, sf: str) -> DataFrame:
    rules = validation.line_total_rules(F.col)
    return validation.broken_rows(w.invoice_lines(spark, sf), ["doc_key"], rules, validation.line_prefix())


@query
def rule_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _header_rows(spark, sf, lambda df: validation.totals_rules())


@query
def rule_tax_calc(spark: SparkSession, sf: str) -> DataFrame:
    taxes = w.tax_rows(w.invoice_lines(spark, sf))
    return taxes.where(validation.tax_calculation_broken(F.col)).select(
        "doc_key", "tax_rate", "tax_category", "taxable_amount", "tax_amount"
    )


@query
def rule_dates(spark: SparkSession, sf: str) -> DataFrame:
    headers = validation.prepared(w.order_headers(spark, sf))
    return validation.broken_rows(headers, ["doc_key"], validation.date_rules(w.AS_OF))


@query
def rule_warnings(spark: SparkSession, sf: str) -> DataFrame:
    headers = w.invoice_headers(spark, sf)
    return headers.select("doc_key", F.explode(validation.warnings()).alias("warning"))


@query
def score_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return w.invoice_headers(spark, sf).select("doc_key", F.round(validation.completeness(), 6).alias("score"))


@query
def score_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return w.invoice_headers(spark, sf).select("doc_key", F.round(validation.consistency(), 6).alias("score"))


@query
def score_confidence(spark: SparkSession, sf: str) -> DataFrame:
    both = w.invoice_headers(spark, sf).withColumns({"c1": validation.completeness(), "c2": validation.consistency()})
    score = validation.confidence(F.col("c1"), F.col("c2"), F.col("ocr_confidence"))
    return both.select("doc_key", F.round(score, 6).alias("score"))


def _all_errors(spark: SparkSession, sf: str) -> DataFrame:
    lines = w.invoice_lines(spark, sf)
    return validation.all_errors(w.invoice_headers(spark, sf), lines, w.tax_rows(lines), "doc_key", w.AS_OF)


@query
def quick_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _all_errors(spark, sf).select("doc_key", F.concat_ws(": ", "field", "message").alias("error"))


@query
def concat_errors(spark: SparkSession, sf: str) -> DataFrame:
    headers = validation.prepared(w.invoice_headers(spark, sf))
    listed = validation.with_errors(headers, validation.header_rules(headers, w.AS_OF))
    return listed.select("doc_key", joined(F.transform("errors", lambda e: e["field"])).alias("fields"))


@query
def concat_all_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of every broken rule of a document: header rules in rule order, then line and tax row fields in their order."""
    lines = w.invoice_lines(spark, sf)
    rows = {
        "_lines": validation.broken_rows(lines, ["doc_key"], validation.line_rules(F.col), validation.line_prefix()),
        "_taxes": validation.broken_rows(w.tax_rows(lines), ["doc_key"], validation.tax_rules(F.col), validation.tax_prefix()),
    }
    found = concat_errors(spark, sf).withColumn("fields", F.when(F.col("fields") != "", F.col("fields")))
    for name, broken in rows.items():
        per_document = broken.groupBy("doc_key").agg(joined(F.array_sort(F.collect_list("field"))).alias(name))
        found = found.join(per_document, "doc_key", "left")
    return found.select("doc_key", F.concat_ws("|", "fields", *rows).alias("fields"))


@query
def dq_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return validation.scorecard(_all_errors(spark, sf))


@query
def nested_field(spark: SparkSession, sf: str) -> DataFrame:
    return w.invoice_headers(spark, sf).select(
        "doc_key",
        val.nested_value("invoice_id").alias("invoice_id"),
        val.nested_value("supplier.name").alias("supplier_name"),
        val.nested_value("customer.vat_id").alias("customer_vat_id"),
    )


@query
def tax_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return w.tax_rows(w.invoice_lines(spark, sf)).withColumn("tax_ok", ~validation.tax_calculation_broken(F.col))


@query
def currency_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return w.invoice_headers(spark, sf).select(
        "doc_key", validation.default_currency(F.lower("supplier.country_code")).alias("default_currency")
    )


# --- text extraction -----------------------------------------------------------------------------------------------
def _text_query(name: str, make: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return w.texts(spark, sf).select("doc_id", make(F.col("text")).alias("result"))

    run.__name__ = name
    query(run)


def _printed_money(value: Column) -> Column:
    return value.cast("decimal(38,2)").cast("string")


_text_query("clean_text", tx.clean_text)
_text_query("normalize_newlines", tx.normalize_newlines)
_text_query("clean_ocr_text", tx.clean_ocr_text)
_text_query("extract_invoice_number", tx.invoice_number)


@query
def extract_dates(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.with_dates(w.texts(spark, sf), "text").select("doc_id", joined(F.col("dates")).alias("result"))


@query
def extract_vat_ids(spark: SparkSession, sf: str) -> DataFrame:
    found = extraction.with_vat_ids(w.texts(spark, sf), "text")
    listed = F.transform("vat_ids", lambda x: F.concat_ws(":", x["country"], x["vat_id"]))
    return found.select("doc_id", joined(listed).alias("result"))


@query
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.with_language(w.texts(spark, sf), "text", "result").select("doc_id", "result")


_text_query("extract_companies", lambda t: joined(tx.companies(t)))
_text_query("extract_addresses", lambda t: joined(tx.address_lines(t)))
_text_query("extract_emails", lambda t: joined(tx.emails(t)))
_text_query("extract_phones", lambda t: joined(tx.phones(t)))
_text_query("extract_currency", tx.document_currency)


def _amount_text(amounts: str) -> Column:
    return joined(F.transform(amounts, lambda a: F.concat_ws(" ", _printed_money(a["amount"]), a["currency"])))


@query
def extract_amounts(spark: SparkSession, sf: str) -> DataFrame:
    found = extraction.with_amounts(w.texts(spark, sf), "text")
    return found.select("doc_id", _amount_text("amounts").alias("result"))


@query
def top_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.top_amounts(w.texts(spark, sf), "text", ["doc_id"], 3)


@query
def distinct_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = w.texts(spark, sf).select("doc_id", tx.emails(F.col("text")).alias("e"), tx.phones(F.col("text")).alias("p"))
    return found.select("doc_id", F.explode(F.concat("e", "p")).alias("match"))


@query
def distinct_matches_with_addresses(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    kinds = {"e": tx.emails(text), "p": tx.phones(text), "a": tx.address_lines(text)}
    found = w.texts(spark, sf).select("doc_id", *(c.alias(name) for name, c in kinds.items()))
    return found.select("doc_id", F.explode(F.concat(*kinds)).alias("match"))


@query
def earliest_label(spark: SparkSession, sf: str) -> DataFrame:
    lowered = w.texts(spark, sf).select("doc_id", F.lower("text").alias("lowered"))
    best = tx.earliest_label(tx.language_scores(F.col("lowered"), fv.DOCUMENT_LANGUAGE_WORDS))
    return lowered.select("doc_id", best.alias("best")).select("doc_id", "best.label", "best.score")


@query
def extract_key_data(spark: SparkSession, sf: str) -> DataFrame:
    found = extraction.key_data(w.texts(spark, sf), "text")
    return found.select(
        "doc_id", "invoice_number", "language",
        joined("dates").alias("dates"), _amount_text("amounts").alias("amounts"),
        joined(F.transform("vat_ids", lambda x: x["vat_id"])).alias("vat_ids"),
        joined("companies").alias("companies"), joined("emails").alias("emails"),
        joined("phone_numbers").alias("phone_numbers"),
    )


@query
def fallback_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.fallback_record(w.texts(spark, sf), "text").drop("text")


@query
def language_profile(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.language_profile(w.texts(spark, sf), "text")


@query
def text_similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the one with the next id."""
    documents = w.table(spark, sf, "documents").select("doc_id", "text")
    pairs = w.table(spark, sf, "documents").select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"))
    compared = extraction.pair_similarity(documents, pairs, "doc_id", "text")
    return compared.select(F.col("left").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


# --- scalars -------------------------------------------------------------------------------------------------------
@query
def parse_money(spark: SparkSession, sf: str) -> DataFrame:
    return _printed_numbers(spark, sf).select("doc_key", val.parse_money(F.col("printed")).alias("value"))


@query
def money_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _printed_numbers(spark, sf).select("doc_key", val.money_or_zero(F.col("printed")).alias("value"))


@query
def parse_percent(spark: SparkSession, sf: str) -> DataFrame:
    return _printed_numbers(spark, sf).select("doc_key", val.parse_percent(F.col("percent")).alias("value"))


@query
def parse_date_any(spark: SparkSession, sf: str) -> DataFrame:
    parsed = val.parse_date_any(F.col("issue_date"))
    return w.invoice_headers(spark, sf).select("doc_key", F.date_format(parsed, "yyyy-MM-dd").alias("day"))


def _printed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    number = "format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)"
    return w.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_key", f"{w.printed_number_sql(number)} AS printed", f"{w.PRINTED_PERCENT} AS percent"
    )


# --- tokens and cells ----------------------------------------------------------------------------------------------
PAGE = ["doc_id", "page_no"]


@query
def filter_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return layout.confident_tokens(w.tokens(spark, sf)).select("doc_id", "elem_id", "text", "confidence")


@query
def header_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = w.tokens(spark, sf).where(layout.is_header(F.col("text"), F.col("confidence")))
    return found.select("doc_id", "elem_id", "text")


@query
def amount_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all texts that look like money."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    looks = F.col("word").rlike("|".join(f"(?:{p})" for p in fv.TOKEN_AMOUNT_PATTERNS))
    return w.texts(spark, sf).select("doc_id", words.alias("word")).where(looks)


@query
def bbox_center(spark: SparkSession, sf: str) -> DataFrame:
    poly, box = F.col("polygon"), F.col("box")
    return w.tokens(spark, sf).select(
        "doc_id", "elem_id",
        val.polygon_center(poly, 0).alias("poly_x"), val.polygon_center(poly, 1).alias("poly_y"),
        val.rectangle_center(box, 0).alias("box_x"), val.rectangle_center(box, 1).alias("box_y"),
    )


@query
def ocr_page_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = layout.page_summary(w.tokens(spark, sf), PAGE)
    return summary.withColumn("avg_confidence", F.round("avg_confidence", 9))


@query
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(w.tokens(spark, sf), PAGE).select(*PAGE, "elem_id", "reading_rank")


@query
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_text(w.tokens(spark, sf), PAGE)


@query
def line_segments(spark: SparkSession, sf: str) -> DataFrame:
    return layout.line_segments(w.tokens(spark, sf), PAGE)


@query
def detect_language_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.page_language(w.tokens(spark, sf), PAGE)


@query
def cell_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = layout.cell_grid(w.cells(spark, sf), ["doc_id", "page_no", "table_id"])
    return grid.select("doc_id", "page_no", "table_id", "cell_id", "row_no", "col_no")


@query
def token_cell_join(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["doc_id", "page_no", "table_id", "cell_id"]
    return layout.token_cell_join(w.cells(spark, sf), w.tokens(spark, sf), PAGE, keys)


# --- tables --------------------------------------------------------------------------------------------------------
def _matrices(spark: SparkSession, sf: str) -> DataFrame:
    return w.html_tables(spark, sf).select("doc_id", tables.html_matrix(F.col("html")).alias("data"))


@query
def html_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return tables.long_cells(_matrices(spark, sf), ["doc_id"], "data")


@query
def is_line_item_table(spark: SparkSession, sf: str) -> DataFrame:
    return _matrices(spark, sf).select("doc_id", tables.is_line_item_table(F.col("data")).alias("is_line_items"))


@query
def map_columns(spark: SparkSession, sf: str) -> DataFrame:
    roles = tables.column_roles(F.col("data"))
    return _matrices(spark, sf).select("doc_id", *[c.cast("int").alias(name) for name, c in roles.items()])


@query
def table_line_items(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_line_items(_matrices(spark, sf), ["doc_id"])


# --- responses -----------------------------------------------------------------------------------------------------
@query
def parse_llm_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = w.responses(spark, sf).select("doc_key", responses.parsed_record(F.col("response")).alias("r"))
    return parsed.select(
        "doc_key", F.col("r").isNotNull().alias("parsed"), "r.invoice_id", "r.issue_date", "r.total_incl_vat",
        F.col("r.supplier.country_code").alias("country_code"),
    )


@query
def clean_line_values(spark: SparkSession, sf: str) -> DataFrame:
    parsed = w.responses(spark, sf).select("doc_key", responses.parsed_record(F.col("response")).alias("r"))
    lines = parsed.select("doc_key", F.posexplode("r.invoice_lines").alias("pos", "raw"))
    typed = lines.select("doc_key", "pos", responses.clean_line(F.col("raw")).alias("l"))
    return typed.select("doc_key", "pos", "l.description", "l.quantity", "l.unit_price", "l.line_total", "l.vat_rate")


@query
def response_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Which answers are invoice records, which are kept raw and why, and which need the fallback."""
    made = responses.judged_responses(w.responses(spark, sf), "response")
    invoice_id = F.try_variant_get("record", "$.invoice_id", "string").alias("invoice_id")
    return made.select("doc_key", "outcome", joined("reasons").alias("reasons"), invoice_id, F.col("raw").isNotNull().alias("kept_raw"))


@query
def structured_from_responses(spark: SparkSession, sf: str) -> DataFrame:
    made = responses.structured(w.responses(spark, sf), "response", "text")
    return made.select(
        "doc_key", "extraction_method", "invoice_id", "issue_date", "total_incl_vat", "n_lines", "confidence_score"
    )


@query
def completeness_confidence(spark: SparkSession, sf: str) -> DataFrame:
    score = responses.record_score(
        F.col("invoice_id"), F.col("issue_date"), F.col("supplier.name").isNotNull(), F.col("total_incl_vat"), F.col("n_lines")
    )
    return w.invoice_headers(spark, sf).select("doc_key", score.alias("score"))


@query
def extraction_quality(spark: SparkSession, sf: str) -> DataFrame:
    flags = {
        "invoice_id": val.present(F.col("invoice_id")),
        "issue_date": val.present(F.col("issue_date")),
        "supplier": val.present(F.col("supplier.name")),
        "customer": val.present(F.col("customer.name")),
        "invoice_lines": F.col("n_lines") > 0,
        "total_incl_vat": val.present(F.col("total_incl_vat"), True),
    }
    measures = responses.quality(F.coalesce("ocr_confidence", F.lit(0.0)), flags)
    return w.invoice_headers(spark, sf).select("doc_key", *[F.round(c, 6).alias(n) for n, c in measures.items()])


@query
def template_lookup(spark: SparkSession, sf: str) -> DataFrame:
    template = responses.prompt_template("extraction", F.col("lang"))
    return w.responses(spark, sf).select("doc_key", "lang", F.md5(template).alias("template_hash"))


@query
def render_prompts(spark: SparkSession, sf: str) -> DataFrame:
    template = responses.prompt_template("extraction", F.col("lang"), few_shot=True)
    prompt = responses.render(template, schema=F.lit(w.PROMPT_SCHEMA), invoice_text=F.col("text"))
    return w.responses(spark, sf).select("doc_key", prompt.alias("prompt"))


@query
def render_prompts_line_items(spark: SparkSession, sf: str) -> DataFrame:
    template = responses.prompt_template("line_items", F.col("lang"))
    return w.responses(spark, sf).select("doc_key", responses.render(template, invoice_text=F.col("text")).alias("prompt"))


@query
def render_prompts_confidence(spark: SparkSession, sf: str) -> DataFrame:
    template = responses.prompt_template("confidence", F.col("lang"))
    return w.responses(spark, sf).select("doc_key", responses.render(template, extracted_data=F.col("response")).alias("prompt"))


@query
def render_prompts_correction(spark: SparkSession, sf: str) -> DataFrame:
    """For each invoice that breaks a rule: all its errors, those of lines and tax rows too, and the answer to correct."""
    lines = w.invoice_lines(spark, sf)
    judged = validation.validate_whole(w.invoice_headers(spark, sf), lines, w.tax_rows(lines), "doc_key", w.AS_OF)
    broken = judged.where(~F.col("is_valid")).select("doc_key", responses.bullet_list(_error_texts()).alias("errors"))
    template = responses.prompt_template("correction", F.col("lang"))
    prompt = responses.render(template, errors=F.col("errors"), extracted_data=F.col("response"))
    return w.responses(spark, sf).join(broken, "doc_key").select("doc_key", prompt.alias("prompt"))


# --- merging -------------------------------------------------------------------------------------------------------
@query
def merge_line_sources(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_line_sources(w.table_lines(spark, sf), w.model_lines(spark, sf), "doc_key").select(
        "doc_key", "source", "description", "line_total"
    )


@query
def merge_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Table counts that go with the merged lines."""
    return merging.table_counts(w.table_lines(spark, sf), "doc_key", "table_id")


@query
def merge_pages(spark: SparkSession, sf: str) -> DataFrame:
    lines = w.paged_lines(spark, sf)
    fields = ["total_excl_vat", "total_vat", "total_incl_vat"]
    merged = merging.merge_pages(w.page_headers(lines), lines, "doc_key", "page_no", fields)
    return merged.drop("line_sum")


@query
def invoice_totals(spark: SparkSession, sf: str) -> DataFrame:
    headers = w.invoice_headers(spark, sf)
    fixed = merging.repaired_totals(
        F.col("total_excl_vat"), F.col("total_vat"), F.col("total_incl_vat"), F.col("line_sum"), F.col("n_lines")
    )
    return headers.select("doc_key", *[c.alias(n) for n, c in fixed.items()])


@query
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    judged = validation.validate(w.invoice_headers(spark, sf), w.AS_OF)
    target = F.when(F.col("is_valid"), "valid").otherwise("quarantine")
    return judged.groupBy(target.alias("target")).agg(F.count("*").alias("n"), F.sum("n_errors").alias("n_errors"))


@query
def quarantine_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Valid and quarantined invoices, written to two folders in one pass and read back from each."""
    judged = validation.validate(w.invoice_headers(spark, sf), w.AS_OF).select("doc_key", "is_valid", "n_errors")
    folder = folders.work_folder(spark, "quarantine")
    folders.split_to_sinks(judged, folder)
    both = [spark.read.schema(judged.schema).parquet(f"{folder}/target={t}").withColumn("target", F.lit(t)) for t in ("valid", "quarantine")]
    return both[0].unionByName(both[1])


# --- exports and sinks ---------------------------------------------------------------------------------------------
@query
def export_xml(spark: SparkSession, sf: str) -> DataFrame:
    return folders.header_xml(w.invoice_headers(spark, sf)).select("doc_key", "xml")


def _through_xml(rows: DataFrame, row_tag: str, root_tag: str) -> DataFrame:
    folder = folders.work_folder(rows.sparkSession, "xml")
    folders.sink_xml(rows, folder, row_tag, root_tag, compression="gzip")
    return folders.scan_xml(rows.sparkSession, folder, rows.schema, row_tag)


@query
def sink_xml_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice headers, written as compressed XML files and read back."""
    names = ["doc_key", "invoice_id", "issue_date", "currency_code", "total_incl_vat"]
    inner = {"supplier_name": "supplier.name", "customer_name": "customer.name", "customer_country_code": "customer.country_code", "due_date": "payment_terms.payment_due_date"}
    rows = w.invoice_headers(spark, sf).select(*names, *[F.col(path).alias(name) for name, path in inner.items()])
    return _through_xml(rows, "Invoice", "Invoices")


@query
def sink_xml_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice lines, written as compressed XML files and read back."""
    names = ["line_ref", "line_id", "description", "quantity", "unit_price", "line_total", "vat_category"]
    return _through_xml(w.invoice_lines(spark, sf).select("doc_key", *names), "InvoiceLine", "InvoiceLines")


def _line_records(spark: SparkSession, sf: str) -> DataFrame:
    return folders.peppol_lines(w.invoice_lines(spark, sf), "doc_key", "l_linenumber")


@query
def export_peppol(spark: SparkSession, sf: str) -> DataFrame:
    """One header record per invoice, with its totals; the lines are records of their own."""
    r = F.col("record")
    return folders.peppol_header(w.invoice_headers(spark, sf)).select(
        "doc_key", r["currency"].alias("currency"), r["supplier"]["name"].alias("supplier_name"),
        r["totals"]["net"].alias("net"), r["totals"]["vat"].alias("vat"), r["totals"]["gross"].alias("gross"),
    )


@query
def export_peppol_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _line_records(spark, sf)


@query
def sink_json(spark: SparkSession, sf: str) -> DataFrame:
    """Writes header records and line records as compressed JSON to two folders and reads them back."""
    headers = folders.peppol_header(w.invoice_headers(spark, sf)).select("doc_key", "record.*")
    lines = _line_records(spark, sf)
    path = folders.work_folder(spark, "sink-json")
    folders.sink_json(headers, f"{path}/headers", "currency", compression="gzip")
    folders.sink_json(lines, f"{path}/lines", compression="gzip")
    counts = spark.read.schema(lines.schema).json(f"{path}/lines").groupBy("doc_key").agg(F.count("*").cast("int").alias("n"))
    back = spark.read.schema(headers.schema).json(f"{path}/headers").join(counts, "doc_key", "left")
    return back.select("doc_key", "currency", F.coalesce("n", F.lit(0)).alias("n_lines"), F.col("totals.gross").alias("gross"))


@query
def scan_json_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Writes all responses as JSON lines, a part of them broken, and scans them into the invoice schema."""
    path = folders.work_folder(spark, "scan-json")
    w.responses(spark, sf).select(F.regexp_replace("response", "\n", " ")).write.text(path)
    found = folders.scan_json_invoices(spark, path)
    return found.groupBy(F.col("_corrupt").isNull().alias("well_formed")).agg(
        F.count("*").alias("n"), F.sum("total_incl_vat").alias("total")
    )


@query
def sink_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Writes invoice x line as CSV and reads it back."""
    flat = w.invoice_lines(spark, sf).select("doc_key", "line_ref", "description", "quantity", "line_total")
    path = folders.work_folder(spark, "sink-csv")
    folders.sink_csv(flat, path)
    return spark.read.schema(flat.schema).option("header", True).csv(path)


# --- files ---------------------------------------------------------------------------------------------------------
def _document_files(spark: SparkSession, sf: str, purpose: str) -> str:
    """All documents as files of JSON lines, in a folder for each language; a bounded number of records makes a file."""
    path = folders.work_folder(spark, purpose)
    rows = w.table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows.write.option("maxRecordsPerFile", 1000).partitionBy("lang").json(path)
    return path


def _documents_in(found: DataFrame) -> DataFrame:
    """The documents inside scanned files, with the folder that each lay in and a digest of its text."""
    lines = found.select("path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    record = lines.select("path", F.from_json("line", "doc_id LONG, text STRING").alias("r"))
    folder = F.regexp_extract("path", "/lang=([^/]*)/[^/]*$", 1)
    return record.select("r.doc_id", folder.alias("folder"), F.md5(F.col("r.text").cast("binary")).alias("text_md5"))


@query
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return _documents_in(folders.scan_files(spark, _document_files(spark, sf, "scan-files"), "*.json"))


@query
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return files.inventory(w.file_rows(spark, sf))


@query
def list_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    return files.with_extension(w.file_rows(spark, sf), [".pdf", ".png"]).select("filename")


@query
def filter_upload_rules(spark: SparkSession, sf: str) -> DataFrame:
    reason = files.reject_reason(F.col("filename"), F.col("length"))
    return w.file_rows(spark, sf).select("doc_id", reason.isNull().alias("accepted"), reason.alias("reason"))


@query
def file_hash(spark: SparkSession, sf: str) -> DataFrame:
    return files.content_hashes(w.table(spark, sf, "documents"), "text")


@query
def aged_files(spark: SparkSession, sf: str) -> DataFrame:
    old = files.aged(w.file_rows(spark, sf), "2024-03-01 00:00:00", 30, "/archive")
    return old.select("doc_id", "target")


@query
def page_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    measures = [F.col("sharpness"), F.col("contrast"), F.col("brightness")]
    return w.page_metrics(spark, sf).select(
        "page_key", F.round(files.page_quality(*measures), 9).alias("quality"), files.page_suitable(*measures).alias("suitable")
    )


# --- activity log --------------------------------------------------------------------------------------------------
def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Rounds floating sums to 4 and means and rates to 9 digits: the order of addition is not fixed."""
    return df.withColumns({n: F.round(n, 4 if "total" in n or n == "processing_time" else 9) for n in names})


@query
def slow_ops(spark: SparkSession, sf: str) -> DataFrame:
    return activity.slow_operations(w.perf_log(spark, sf)).select("event_id", "operation", "duration")


@query
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = w.perf_log(spark, sf).withColumn("batch_id", F.date_format("ts", "yyyy-MM-dd"))
    return _rounded(activity.batch_summary(log, "batch_id"), "success_rate", "processing_time")


@query
def processing_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(activity.processing_stats(w.perf_log(spark, sf)), "total_processing_time", "avg_processing_time")


@query
def operation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activity.operation_counts(w.perf_log(spark, sf))


@query
def performance_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = activity.performance_stats(w.perf_log(spark, sf), w.LOG_NOW, 24 * 14)
    return _rounded(stats, "average_duration", "success_rate", "operations_per_hour")


@query
def llm_metrics(spark: SparkSession, sf: str) -> DataFrame:
    log = w.perf_log(spark, sf).withColumns(
        {"model": F.col("operation"), "backend": F.when(F.col("user_id") % 2 == 0, "batched").otherwise("single")}
    )
    return _rounded(activity.request_metrics(log, ["model", "backend"]), "total_time", "avg_time_per_request")


@query
def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(activity.error_rate(w.perf_log(spark, sf), w.LOG_NOW, 48), "error_rate")


@query
def latest_n(spark: SparkSession, sf: str) -> DataFrame:
    newest = activity.newest(w.samples(spark, sf), "metric", fv.SAMPLES_KEEP)
    return newest.select("metric", "rank", "event_id", "value")


@query
def latest_log(spark: SparkSession, sf: str) -> DataFrame:
    return activity.newest(w.perf_log(spark, sf), None, fv.LOG_KEEP).select("event_id", "operation", "duration")


@query
def metric_history(spark: SparkSession, sf: str) -> DataFrame:
    return activity.history(w.samples(spark, sf), "cpu_usage", w.LOG_NOW, 72).select("event_id", "value")


@query
def metric_retention(spark: SparkSession, sf: str) -> DataFrame:
    return activity.retained(w.perf_log(spark, sf), w.LOG_NOW, 7).select("event_id", "operation")


def _breaches(spark: SparkSession, sf: str) -> DataFrame:
    return activity.breaches(w.samples(spark, sf), activity.threshold_table(spark))


@query
def alerts_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _breaches(spark, sf).select("event_id", "metric", "severity", "value")


@query
def alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _breaches(spark, sf).select("metric", "event_id", "ts")
    return quotas.alert_cooldown(alerts, ["metric"], 3600).select("event_id", "metric", "emit")


@query
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    decided = quotas.rate_limit(w.requests(spark, sf), ["client"], 2, 6 * 3600)
    return decided.select("event_id", "admitted", "remaining", "retry_after")


@query
def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return activity.health_rollup(w.samples(spark, sf))


# --- nested and streaming ------------------------------------------------------------------------------------------
@query
def validate_nested(spark: SparkSession, sf: str) -> DataFrame:
    judged = validation.validate_nested(w.line_invoices(w.invoice_lines(spark, sf)), w.AS_OF)
    return judged.select("invoice_id", "is_valid", "n_errors", F.round("confidence_score", 6).alias("confidence_score"))


@query
def validate_nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Whole orders as nested invoices, with 0 to 7 lines each; how many rows break each rule."""
    judged = validation.validate_nested(w.nested_invoices(spark, sf), w.AS_OF, listed=True)
    counts = F.transform("all_errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"], F.lit(" x"), e["n"].cast("string")))
    scores = [F.round(c, 6).alias(c) for c in ("completeness_score", "consistency_score", "confidence_score")]
    return judged.select("doc_key", "is_valid", "n_errors", joined(counts).alias("errors"), *scores)


@query
def stream_performance_stats(spark: SparkSession, sf: str) -> DataFrame:
    windows = live.performance_windows(w.log_of(live.stream_table(spark, sf, "events")), "1 hour")
    rows = live.latest_rows(spark, windows, ["window_start", "window_end", "operation"], "stream-performance")
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("window_start", "window_end")}
    return _rounded(rows.withColumns(text), "success_rate", "average_duration")


@query
def stream_sliding_stats(spark: SparkSession, sf: str) -> DataFrame:
    windows = live.performance_windows(w.log_of(live.stream_table(spark, sf, "events")), "24 hours", "6 hours")
    rows = live.latest_rows(spark, windows, ["window_start", "window_end", "operation"], "stream-sliding")
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("window_start", "window_end")}
    return _rounded(rows.withColumns(text), "success_rate", "average_duration")


@query
def stream_processing_stats(spark: SparkSession, sf: str) -> DataFrame:
    totals = live.running_totals(w.log_of(live.stream_table(spark, sf, "events")))
    rows = live.latest_rows(spark, totals, ["scope"], "stream-totals").drop("scope")
    return _rounded(rows, "total_processing_time", "avg_processing_time")


@query
def stream_alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts emitted up to the last watermark, six hours before the newest breach."""
    samples = w.samples_of(live.stream_table(spark, sf, "events"))
    breaches = activity.breaches(samples, activity.threshold_table(spark)).select("metric", "ts", "event_id")
    return live.appended_rows(spark, live.emitted_alerts(breaches, "metric", 3600, "6 hours"), "stream-alerts")


@query
def stream_alerts_complete(spark: SparkSession, sf: str) -> DataFrame:
    """All alerts that pass the cool-down: at the end of the stream the waiting breaches are decided too."""
    samples = w.samples_of(live.stream_table(spark, sf, "events"))
    breaches = activity.breaches(samples, activity.threshold_table(spark)).select("metric", "ts", "event_id")
    return live.all_emitted_alerts(spark, breaches, "metric", 3600, "6 hours")


@query
def stream_validate(spark: SparkSession, sf: str) -> DataFrame:
    invoices = w.line_invoices(w.lines_of(live.stream_table(spark, sf, "lineitem")))
    folder = folders.work_folder(spark, "stream-validate")
    live.validate_to_sinks(spark, invoices, w.AS_OF, ["invoice_id"], folder)
    return spark.read.schema("invoice_id STRING, n_errors LONG, batch LONG, target STRING").parquet(f"{folder}/out").drop("batch")


@query
def stream_validate_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and lineitems as two streams, put together to whole invoices of 0 to 7 lines, judged and split as they come. What
    the headers take from the lines is summed up once and written, as each batch joins it. The streams carry the lineitems'
    own columns, which are shorter than the lines made of them."""
    lineitem = w.table(spark, sf, "lineitem")
    needed = w.line_inputs(lineitem)
    by_order = w.lines_of(w.spread(lineitem.select("l_orderkey", *needed), "l_orderkey"))
    summary = folders.written(w.line_summary(by_order), "stream-orders-summary", drop_shuffles=True)
    counts = summary.select(F.col("doc_key").alias("o_orderkey"), "n_lines")
    orders = live.stream_table(spark, sf, "orders").where("o_orderkey IS NOT NULL").join(counts, "o_orderkey", "left")
    heads = orders.select(F.col("o_orderkey").alias("doc_key"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    items = live.stream_table(spark, sf, "lineitem")
    lines = items.select(F.col("l_orderkey").alias("doc_key"), F.col("l_shipdate").cast("timestamp").alias("ts"), *needed)
    whole = invoices.assembled(heads, lines, "doc_key", "200 days").where("outcome = 'whole'")
    schema = items.select(*needed).schema.simpleString()
    parsed = whole.select(F.col("key").cast("long").alias("doc_key"), invoices.parsed_lines("lines", schema).alias("items"))
    made = parsed.select("doc_key", w.lines_in("items", "doc_key").alias("invoice_lines"))
    nested = made.withColumn("tax_breakdown", invoices.tax_breakdown("invoice_lines"))
    given = w.invoice_headers(spark, sf, summary).drop("n_lines", "line_sum", "bad_lines", "line_errors", "bad_taxes", "tax_errors")
    folder = folders.work_folder(spark, "stream-orders")
    live.validate_to_sinks(spark, nested, w.AS_OF, ["doc_key"], folder, headers=given, key="doc_key")
    return spark.read.schema("doc_key LONG, n_errors LONG, batch LONG, target STRING").parquet(f"{folder}/out").drop("batch")


@query
def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    arriving = folders.stream_files(spark, _document_files(spark, sf, "stream-files-in"), "*.json")
    return live.appended_rows(spark, _documents_in(arriving), "stream-files")
