"""DuckDB SQL that computes the registered queries from the same tables."""

from __future__ import annotations

import hashlib

from tallyspark.functions import fixed_values as fv
from tallyspark.operators import responses
from tallyspark.plans import views as w
from tallyspark.plans.oracle_views import SPACE, money, parse_date, with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, recursive: bool = False) -> None:
    ORACLES[name] = with_views(sql, recursive)


def rules_sql(rules: list[tuple[str, str, str, str]], source: str, prefix: str = "") -> str:
    """UNION ALL of one SELECT per rule: field, message, broken when, value."""
    return " UNION ALL ".join(
        f"SELECT doc_key, {prefix}'{field}' AS field, '{message}' AS message, CAST({value} AS VARCHAR) AS value"
        f" FROM {source} WHERE {broken}"
        for field, message, broken, value in rules
    )


CODES = {
    "currency": "('EUR','USD','GBP','PLN','SEK','DKK')",
    "country": "('DE','EE','GB','FR','IT','ES','NL','AT','BE','PL','FI','SE','DK')",
    "vat": "('S','Z','E','AE','O')",
}
ISSUED, ISSUED4 = parse_date("issue_date"), parse_date("issue_date", False)
DUE = parse_date("due_date")

SCHEMA_RULES = [
    ("invoice_id", "field is required", "invoice_id IS NULL", "NULL"),
    ("issue_date", "is not a date", f"{ISSUED4} IS NULL", "issue_date"),
    ("invoice_type_code", "is not an allowed code", "invoice_type_code NOT IN ('380','381','383','384')", "invoice_type_code"),
    ("currency_code", "is not an allowed code", f"currency_code NOT IN {CODES['currency']}", "currency_code"),
    ("supplier.vat_id", "must start with a country code", "NOT regexp_matches(supplier_vat_id, '^[A-Z]{2}')", "supplier_vat_id"),
    ("supplier.country_code", "is not an allowed code", f"supplier_country_code NOT IN {CODES['country']}", "supplier_country_code"),
    ("customer.name", "field is required", "customer_name IS NULL", "NULL"),
    ("customer.country_code", "field is required", "customer_country_code IS NULL", "NULL"),
    ("payable_amount", "must be at least 0", "payable_amount < 0", "CAST(payable_amount AS VARCHAR)"),
]
NUMBER_RULES = [("invoice_id", "Invoice number format is invalid", "coalesce(length(invoice_id), 0) < 3", "invoice_id")]


def _vat_bad(party: str) -> str:
    shapes = " ".join(f"WHEN '{c}' THEN NOT regexp_full_match({party}_vat_id, '{s}')" for c, s in fv.VAT_ID_SHAPES.items())
    return (
        f"{party}_vat_id IS NOT NULL AND CASE WHEN {party}_country_code IS NULL THEN true ELSE"
        f" CASE {party}_country_code {shapes} ELSE false END END"
    )


VAT_RULES = [
    ("supplier.vat_id", "Supplier VAT ID format is invalid", _vat_bad("supplier"), "supplier_vat_id"),
    ("customer.vat_id", "Customer VAT ID format is invalid", _vat_bad("customer"), "customer_vat_id"),
]
TOTALS_RULES = [
    ("total_incl_vat", "Total including VAT does not match net plus VAT",
     "abs(total_excl_vat + total_vat - total_incl_vat) > 0.01", "total_incl_vat"),
    ("total_excl_vat", "Total excluding VAT does not match the lines",
     "abs(line_sum - total_excl_vat) > 0.01", "total_excl_vat"),
]
DUE_FIELD = "payment_terms.payment_due_date"
DATE_RULES = [
    ("issue_date", "Invalid date format", f"{ISSUED} IS NULL", "issue_date"),
    ("issue_date", "Issue date cannot be in the future", f"{ISSUED} > DATE '{w.AS_OF}'", "issue_date"),
    (DUE_FIELD, "Invalid payment due date format", f"due_date IS NOT NULL AND {DUE} IS NULL", "due_date"),
    (DUE_FIELD, "Payment due date cannot be before issue date", f"{DUE} < {ISSUED}", "due_date"),
]
HEADER_RULES = SCHEMA_RULES + NUMBER_RULES + VAT_RULES + TOTALS_RULES + DATE_RULES
LINE_SCHEMA_RULES = [
    ("line_id", "field is required", "line_id IS NULL", "NULL"),
    ("unit_code", "is too long", "length(unit_code) > 10", "unit_code"),
    ("vat_category", "is not an allowed code", f"vat_category NOT IN {CODES['vat']}", "vat_category"),
]
LINE_TOTAL_RULES = [
    ("line_total", "Line total does not match quantity times unit price",
     "abs(quantity * unit_price - line_total) > 0.01", "line_total"),
    ("description", "Line item description is required", "trim(description) = ''", "description"),
]
LINE_PREFIX = "'invoice_lines.' || line_ref || '.' || "
LINE_RULES = LINE_SCHEMA_RULES + LINE_TOTAL_RULES

HOME = "CASE supplier_country_code " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in fv.COUNTRY_CURRENCY.items()) + " END"
WARNINGS = [
    (f"currency_code <> {HOME}",
     f"'Invoice currency ' || currency_code || ' differs from supplier''s default currency ' || {HOME}"),
    ("due_date IS NULL", "'Missing recommended field: payment_terms.payment_due_date'"),
    ("customer_vat_id IS NULL", "'Customer VAT ID is missing'"),
    ("purchase_order_reference IS NULL", "'Purchase order reference is missing'"),
    ("total_incl_vat > 100000", "'Invoice total ' || CAST(total_incl_vat AS VARCHAR) || ' is unusually high'"),
]

_filled10 = ["nullif(invoice_id, '')", "issue_date", "supplier_name", "customer_name", "nullif(total_incl_vat, 0)",
             "currency_code", "supplier_country_code", "customer_country_code"]
_filled7 = ["supplier_vat_id", "customer_vat_id", "supplier_address_line", "customer_address_line",
            "nullif(n_lines, 0)", "nullif(total_excl_vat, 0)", "nullif(total_vat, 0)", "nullif(payable_amount, 0)"]
_filled3 = ["supplier_city", "supplier_postal_code", "customer_city", "customer_postal_code",
            "purchase_order_reference", "contract_reference"]
COMPLETE = "(" + " + ".join(
    f"{weight} * CAST({x} IS NOT NULL AS INT)"
    for weight, fields in ((10, _filled10), (7, _filled7), (3, _filled3))
    for x in fields
) + ") / 154.0::DOUBLE"
_D = {n: f"CAST({n} AS DOUBLE)" for n in ("total_excl_vat", "total_vat", "total_incl_vat", "payable_amount", "line_sum")}
_SUM = "CAST(total_excl_vat + total_vat AS DOUBLE)"
_GAP = f"CAST(abs(total_excl_vat + total_vat - total_incl_vat) AS DOUBLE) / greatest({_SUM}, {_D['total_incl_vat']})"
_LGAP = f"CAST(abs(line_sum - total_excl_vat) AS DOUBLE) / greatest({_D['line_sum']}, {_D['total_excl_vat']})"
CONSISTENT = (
    "greatest(1.0::DOUBLE - least("
    f"CASE WHEN total_incl_vat > 0 AND total_excl_vat + total_vat <> 0 AND least({_GAP} * 2, 0.3::DOUBLE) > 0.01::DOUBLE THEN least({_GAP} * 2, 0.3::DOUBLE) ELSE 0.0::DOUBLE END"
    " + CASE WHEN total_incl_vat > 0 AND payable_amount > 0 AND abs(payable_amount - total_incl_vat) > 0.01 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
    f" + CASE WHEN n_lines > 0 AND {_LGAP} > 0.01::DOUBLE THEN least({_LGAP} * 0.5::DOUBLE, 0.2::DOUBLE) ELSE 0.0::DOUBLE END"
    " + bad_lines * 0.05::DOUBLE + bad_taxes * 0.1::DOUBLE"
    f" + CASE WHEN {HOME} IS NOT NULL AND currency_code IS DISTINCT FROM {HOME} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
    ", 0.99::DOUBLE), 0.01::DOUBLE)"
)
SCORED = (
    f"SELECT *, {COMPLETE} AS c1, {CONSISTENT} AS c2, (c2 + c1) / 2 AS base,"
    " CASE WHEN ocr_confidence IS NULL THEN base ELSE greatest(base, ocr_confidence * 0.5::DOUBLE + base * 0.5::DOUBLE) END AS c3 FROM v_headers"
)


def listed(rules: list[tuple[str, str, str, str]], what: str) -> str:
    """Broken rules of a row joined by '|' in rule order; `what` names the text: field, or field and message."""
    texts = [f if what == "field" else f"{f}: {m}" for f, m, _, _ in rules]
    entries = ", ".join(f"CASE WHEN {r[2]} THEN '{t}' END" for r, t in zip(rules, texts))
    return f"array_to_string(list_filter([{entries}], lambda x: x IS NOT NULL), '|')"


_warning_list = ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in WARNINGS)
_n_header = " + ".join(f"CAST(coalesce({r[2]}, false) AS INT)" for r in HEADER_RULES)
oracle(
    "validate_invoices",
    f"SELECT doc_key, n_errors = 0 AS is_valid, n_errors, header_errors, warnings, round(c1, 6) AS completeness_score,"
    f" round(c2, 6) AS consistency_score, round(c3, 6) AS confidence_score FROM (SELECT *, CAST({_n_header} + line_errors + tax_errors AS BIGINT) AS n_errors,"
    f" {listed(HEADER_RULES, 'both')} AS header_errors,"
    f" array_to_string(list_filter([{_warning_list}], lambda x: x IS NOT NULL), '|') AS warnings FROM ({SCORED}))",
)
oracle("rule_schema", rules_sql(SCHEMA_RULES, "v_headers") + " UNION ALL " + rules_sql(LINE_SCHEMA_RULES, "v_lines", LINE_PREFIX))
oracle(
    "rule_schema_tax_rows",
    "SELECT doc_key, 'tax_breakdown.' || CAST(tax_rate AS VARCHAR) || '-' || tax_category || '.tax_category' AS field,"
    f" 'is not an allowed code' AS message, tax_category AS value FROM v_taxes WHERE tax_category NOT IN {CODES['vat']}",
)
oracle("rule_invoice_number", rules_sql(NUMBER_RULES, "v_headers"))
oracle("rule_vat_id", rules_sql(VAT_RULES, "v_headers"))
oracle("rule_line_total", rules_sql(LINE_TOTAL_RULES, "v_lines", LINE_PREFIX))
oracle("rule_totals", rules_sql(TOTALS_RULES, "v_headers"))
oracle("rule_dates", rules_sql(DATE_RULES, "v_headers"))
_tax_off = "abs(taxable_amount * tax_rate - tax_amount) > 0.01"
oracle("rule_tax_calc", f"SELECT doc_key, tax_rate, tax_category, taxable_amount, tax_amount FROM v_taxes WHERE {_tax_off}")
oracle("tax_breakdown", f"SELECT doc_key, tax_rate, tax_category, taxable_amount, tax_amount, NOT ({_tax_off}) AS tax_ok FROM v_taxes")
oracle("rule_warnings", " UNION ALL ".join(f"SELECT doc_key, {t} AS warning FROM v_headers WHERE {c}" for c, t in WARNINGS))
oracle("score_completeness", f"SELECT doc_key, round(c1, 6) AS score FROM ({SCORED})")
oracle("score_consistency", f"SELECT doc_key, round(c2, 6) AS score FROM ({SCORED})")
oracle("score_confidence", f"SELECT doc_key, round(c3, 6) AS score FROM ({SCORED})")
TAX_RULES = [
    ("tax_category", "is not an allowed code", f"tax_category NOT IN {CODES['vat']}", "tax_category"),
    ("tax_amount", "Tax amount does not match taxable amount times rate", _tax_off, "tax_amount"),
]
TAX_PREFIX = "'tax_breakdown.' || CAST(tax_rate AS VARCHAR) || '-' || tax_category || '.' || "
_every = (
    rules_sql(HEADER_RULES, "v_headers") + " UNION ALL " + rules_sql(LINE_RULES, "v_lines", LINE_PREFIX)
    + " UNION ALL " + rules_sql(TAX_RULES, "v_taxes", TAX_PREFIX)
)
oracle("quick_validate", f"SELECT doc_key, concat(field, ': ', message) AS error FROM ({_every})")
oracle("concat_errors", f"SELECT doc_key, {listed(HEADER_RULES, 'field')} AS fields FROM v_headers")
_per_document = "SELECT doc_key, array_to_string(list_sort(list(field)), '|') AS fields FROM ({}) GROUP BY doc_key"
oracle(
    "concat_all_errors",
    f"SELECT h.doc_key, concat_ws('|', nullif(h.fields, ''), l.fields, t.fields) AS fields"
    f" FROM (SELECT doc_key, {listed(HEADER_RULES, 'field')} AS fields FROM v_headers) h"
    f" LEFT JOIN ({_per_document.format(rules_sql(LINE_RULES, 'v_lines', LINE_PREFIX))}) l USING (doc_key)"
    f" LEFT JOIN ({_per_document.format(rules_sql(TAX_RULES, 'v_taxes', TAX_PREFIX))}) t USING (doc_key)",
)


def _summed(first: str) -> str:
    """Broken row rules of each document in rule order: `field: message xN`, and the first row's name where asked."""
    tax_name = "CAST(tax_rate AS VARCHAR) || '-' || tax_category"
    tables = [(LINE_RULES, "v_lines", "invoice_lines", "line_ref", 0), (TAX_RULES, "v_taxes", "tax_breakdown", tax_name, 100)]
    rows = " UNION ALL ".join(
        f"SELECT doc_key, {base + i} AS k, '{name}.*.{f}: {m} x' AS t, {ref} AS ref FROM {source} WHERE {broken}"
        for rules, source, name, ref, base in tables
        for i, (f, m, broken, _) in enumerate(rules)
    )
    counted = f"SELECT doc_key, k, t, count(*) AS n, min(ref) AS ref FROM ({rows}) GROUP BY doc_key, k, t"
    return f"SELECT doc_key, string_agg(t || n{first}, '|' ORDER BY k) AS row_errors FROM ({counted}) GROUP BY doc_key"


def _with_header_errors(source: str) -> str:
    return f"(SELECT *, CAST({_n_header} + line_errors + tax_errors AS BIGINT) AS n_errors, {listed(HEADER_RULES, 'both')} AS header_errors FROM {source})"


_named_first = _summed(" || ' from ' || ref")
oracle(
    "validate_whole_invoices",
    "SELECT doc_key, n_errors = 0 AS is_valid, n_errors, concat_ws('|', nullif(header_errors, ''), row_errors) AS errors FROM"
    f" {_with_header_errors('v_headers')} LEFT JOIN ({_named_first}) USING (doc_key)",
)
_once = "list_transform(string_split(nullif(header_errors, ''), '|'), lambda x: x || ' x1')"
oracle(
    "validate_nested_orders",
    f"SELECT doc_key, n_errors = 0 AS is_valid, n_errors, concat_ws('|', array_to_string({_once}, '|'), row_errors) AS errors,"
    " round(c1, 6) AS completeness_score, round(c2, 6) AS consistency_score, round(c3, 6) AS confidence_score FROM"
    f" {_with_header_errors(f'({SCORED})')} LEFT JOIN ({_summed('')}) USING (doc_key)",
)
_star = (
    rules_sql(HEADER_RULES, "v_headers") + " UNION ALL " + rules_sql(LINE_RULES, "v_lines", "'invoice_lines.*.' || ")
    + " UNION ALL " + rules_sql(TAX_RULES, "v_taxes", "'tax_breakdown.*.' || ")
)
oracle("dq_scorecard", f"SELECT field, message, count(*) AS n FROM ({_star}) GROUP BY field, message")
oracle("nested_field", "SELECT doc_key, nullif(invoice_id, '') AS invoice_id, supplier_name, customer_vat_id FROM v_headers")
oracle("currency_lookup", f"SELECT doc_key, {HOME} AS default_currency FROM v_headers")

# --- text ----------------------------------------------------------------------------------------------------------


def text_oracle(name: str, expr: str) -> None:
    oracle(name, f"SELECT doc_id, {expr} AS result FROM v_texts")


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


LF = "chr(10)"
NEWLINES = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
CLEAN = collapse("nfc_normalize(text)")
text_oracle("clean_text", CLEAN)
text_oracle("normalize_newlines", NEWLINES)
text_oracle("clean_ocr_text", collapse(f"nfc_normalize({NEWLINES})"))
NUMBER = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in fv.INVOICE_NUMBER_PATTERNS) + ")"
text_oracle("extract_invoice_number", NUMBER)

WORD = r"[\p{L}\p{N}_]"
DMY = rf"([0-9]{{1,2}}){SPACE}+({WORD}+){SPACE}+([0-9]{{4}})"
MDY = rf"({WORD}+){SPACE}+([0-9]{{1,2}}),?{SPACE}+([0-9]{{4}})"


def _numeric_dates(pattern: str, form: str) -> str:
    return f"list_transform(regexp_extract_all(text, '{pattern}'), lambda d: CAST(try_strptime(d, '{form}') AS DATE))"


def _named_dates(pattern: str, form: str) -> str:
    squeezed = f"replace(regexp_replace(d, '{SPACE}+', ' ', 'g'), ',', '')"
    return f"list_transform(regexp_extract_all(text, '{pattern}'), lambda d: CAST(try_strptime({squeezed}, '{form}') AS DATE))"


DATES = (
    "array_to_string(list_transform(list_sort(list_distinct(list_filter("
    + " || ".join(
        [
            _numeric_dates("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d"),
            _numeric_dates("[0-9]{2}[.][0-9]{2}[.][0-9]{4}", "%d.%m.%Y"),
            _numeric_dates("[0-9]{2}/[0-9]{2}/[0-9]{4}", "%d/%m/%Y"),
            _numeric_dates("[0-9]{2}-[0-9]{2}-[0-9]{4}", "%d-%m-%Y"),
            _named_dates(DMY, "%d %B %Y"),
            _named_dates(MDY, "%B %d %Y"),
        ]
    )
    + ", lambda d: d IS NOT NULL))), lambda d: strftime(d, '%Y-%m-%d')), '|')"
)
text_oracle("extract_dates", DATES)

SYMBOLS = "[" + "".join(fv.CURRENCY_SYMBOLS) + "]"
RUN = r"[0-9.,\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_symbol = "CASE {c} " + " ".join(f"WHEN '{s}' THEN '{code}'" for s, code in fv.CURRENCY_SYMBOLS.items()) + " END"


def _hits(pattern: str, code: str) -> str:
    value = money("m", "DECIMAL(38,6)")
    return f"list_transform(regexp_extract_all(text, '{pattern}'), lambda m: {{'a': {value}, 'c': {code}}})"


_found = " || ".join(
    [
        _hits(f"{SYMBOLS}{RUN}+", _symbol.format(c="left(m, 1)")),
        _hits(f"{RUN}+{SYMBOLS}", _symbol.format(c="right(m, 1)")),
        _hits(f"{RUN}+(?:{'|'.join(fv.AMOUNT_CODES)})", "right(m, 3)"),
        _hits("[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}", "'EUR'"),
    ]
)
AMOUNT_ROWS = (
    f"SELECT doc_id, f.a AS amount, f.c AS currency, min(i) AS i FROM (SELECT doc_id, unnest(found) AS f,"
    f" unnest(range(len(found))) AS i FROM (SELECT doc_id, {_found} AS found FROM v_texts)) WHERE f.a > 0"
    " GROUP BY doc_id, f.a, f.c"
)
_amount_text = "CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) || ' ' || currency"
AMOUNTS = f"SELECT doc_id, string_agg({_amount_text}, '|' ORDER BY amount DESC, i) AS amounts FROM ({AMOUNT_ROWS}) GROUP BY doc_id"
oracle("extract_amounts", f"SELECT doc_id, coalesce(amounts, '') AS result FROM v_texts LEFT JOIN ({AMOUNTS}) USING (doc_id)")
oracle(
    "top_amounts",
    f"SELECT doc_id, CAST(rank AS INT) AS rank, amount, currency FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY amount DESC, i) AS rank FROM ({AMOUNT_ROWS})) WHERE rank <= 3",
)


def _vat_hits(separator: str) -> str:
    each = [
        f"list_transform(regexp_extract_all(text, '(?i){s}'), lambda x: {f"'{c}:' || " if separator else ''}upper(x))"
        for c, s in fv.VAT_ID_SHAPES.items()
    ]
    return f"array_to_string({' || '.join(each)}, '|')"


text_oracle("extract_vat_ids", _vat_hits(":"))


def _score(lowered: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({lowered}, '{x}') AS INT)" for x in words) + ")"


LANGUAGES = list(fv.DOCUMENT_LANGUAGE_WORDS)
SCORES = f"SELECT doc_id, text, [{', '.join(_score('lower(text)', x) for x in fv.DOCUMENT_LANGUAGE_WORDS.values())}] AS s FROM v_texts"
_best = f"{LANGUAGES}[list_position(s, list_max(s))]"
LANGUAGE = f"CASE WHEN list_max(s) >= 2 THEN {_best} ELSE 'en' END"
oracle("detect_language", f"SELECT doc_id, {LANGUAGE} AS result FROM ({SCORES})")
oracle("earliest_label", f"SELECT doc_id, {_best} AS label, list_max(s) AS score FROM ({SCORES})")
oracle(
    "language_profile",
    f"SELECT language, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_texts), 6) AS share FROM (SELECT {LANGUAGE} AS language FROM ({SCORES})) GROUP BY language",
)

_company = (
    rf"([A-ZÀ-ÿ][a-zA-ZÀ-ÿ&\-.\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+{SPACE}(?:{'|'.join(fv.LEGAL_FORMS)})\.?)(?:[^\p{{L}}\p{{N}}_]|$)"
)


def _ordered_distinct(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


_names = f"list_filter(list_transform(regexp_extract_all(text, '{_company}', 1), lambda n: {collapse('n')}), lambda n: length(n) > 3)"
COMPANIES = f"(SELECT array_to_string({_ordered_distinct('names')}, '|') FROM (SELECT {_names} AS names))"
text_oracle("extract_companies", COMPANIES)
_postal = "|".join(f"(?:{p})" for p in fv.POSTAL_PATTERNS)
_holding = f"list_filter(list_transform(string_split(text, {LF}), lambda x: trim(x)), lambda x: length(x) > 10 AND regexp_matches(x, '{_postal}'))"
text_oracle("extract_addresses", f"array_to_string(list_sort(list_distinct(list_transform({_holding}, lambda x: {collapse('x')}))), '|')")
_emails = f"list_sort(list_distinct(regexp_extract_all(text, '{fv.EMAIL_PATTERN}')))"
_phones = (
    "list_sort(list_distinct(list_transform(list_filter("
    + " || ".join(f"regexp_extract_all(text, '{p}')" for p in fv.PHONE_PATTERNS)
    + ", lambda x: length(regexp_replace(x, '[^0-9+]', '', 'g')) >= 7), lambda x: trim(x))))"
)
text_oracle("extract_emails", f"array_to_string({_emails}, '|')")
text_oracle("extract_phones", f"array_to_string({_phones}, '|')")
oracle("distinct_matches", f"SELECT doc_id, unnest({_emails} || {_phones}) AS match FROM v_texts")
_addresses = f"list_sort(list_distinct(list_transform({_holding}, lambda x: {collapse('x')})))"
oracle("distinct_matches_with_addresses", f"SELECT doc_id, unnest({_emails} || {_phones} || {_addresses}) AS match FROM v_texts")
text_oracle("extract_currency", "CASE " + " ".join(f"WHEN contains(text, '{s}') THEN '{c}'" for s, c in fv.CURRENCY_SYMBOLS.items()) + " ELSE 'EUR' END")
oracle(
    "extract_key_data",
    f"SELECT doc_id, {NUMBER} AS invoice_number, {LANGUAGE} AS language, {DATES} AS dates, coalesce(amounts, '') AS amounts,"
    f" {_vat_hits('')} AS vat_ids, {COMPANIES} AS companies, array_to_string({_emails}, '|') AS emails,"
    f" array_to_string({_phones}, '|') AS phone_numbers FROM ({SCORES}) LEFT JOIN ({AMOUNTS}) USING (doc_id)",
)
_fb_number = ", ".join(
    f"nullif(regexp_extract(text, '(?i){p}', 1), '')"
    for p in (r"invoice\s*(?:no\.?|number)?[\s#:]*([A-Z0-9-]+)", r"rechnung\s*(?:nr\.?)?[\s#:]*([A-Z0-9-]+)", r"arve\s*(?:nr\.?)?[\s#:]*([A-Z0-9-]+)")
)
_fb_total = ", ".join(
    rf"nullif(regexp_extract(text, '(?i)\b{x}\s*:?\s*[€$£]?\s*([0-9]+[.,][0-9]{{2}})', 1), '')" for x in ("total", "gesamt", "kokku")
)
FALLBACK_PARTS = [
    f"coalesce({_fb_number}) AS invoice_id",
    "nullif(regexp_extract(text, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}'), '') AS issue_date",
    f"TRY_CAST(replace(coalesce({_fb_total}), ',', '.') AS DECIMAL(18,2)) AS total_incl_vat",
]
FALLBACK = ", ".join(FALLBACK_PARTS)
oracle(
    "fallback_extract",
    f"SELECT doc_id, {FALLBACK}, text AS raw_text, 'fallback' AS extraction_method, 0.3::DOUBLE AS confidence_score FROM v_texts",
)
_set = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
oracle(
    "text_similarity_pairs",
    f"WITH s AS (SELECT doc_id, {_set} AS ws FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0"
    " ELSE len(list_intersect(a.ws, b.ws))::DOUBLE / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) END, 6) AS similarity"
    " FROM s a JOIN s b ON b.doc_id = a.doc_id + 1",
)

# --- scalars -------------------------------------------------------------------------------------------------------
_printed = w.printed_number_sql("format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE))")
_numbers = f"SELECT o_orderkey AS doc_key, {_printed} AS printed, {w.PRINTED_PERCENT} AS percent FROM orders"
oracle("parse_money", f"SELECT doc_key, {money('printed')} AS value FROM ({_numbers})")
oracle("money_or_zero", f"SELECT doc_key, coalesce({money('printed')}, 0) AS value FROM ({_numbers})")
_percent = "replace(percent, '%', '')"
oracle("parse_percent", f"SELECT doc_key, CAST({money(_percent)} * 0.01 AS DECIMAL(9,6)) AS value FROM ({_numbers})")
oracle("parse_date_any", f"SELECT doc_key, strftime({ISSUED}, '%Y-%m-%d') AS day FROM v_headers")


# --- tokens and cells ----------------------------------------------------------------------------------------------
oracle("filter_confidence", "SELECT doc_id, elem_id, trim(text) AS text, confidence FROM v_tokens WHERE confidence > 0.3::DOUBLE")
oracle("header_tokens", "SELECT doc_id, elem_id, text FROM v_tokens WHERE confidence > 0.9::DOUBLE")
oracle(
    "amount_tokens",
    "SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS word FROM v_texts) WHERE "
    + " OR ".join(f"regexp_matches(word, '{p}')" for p in fv.TOKEN_AMOUNT_PATTERNS),
)
oracle("bbox_center", "SELECT doc_id, elem_id, cx AS poly_x, cy AS poly_y, cx AS box_x, cy AS box_y FROM v_tokens")
oracle("ocr_page_summary", "SELECT doc_id, page_no, count(*) AS total_elements, round(avg(confidence), 9) AS avg_confidence FROM v_tokens GROUP BY ALL")
oracle("reading_order", "SELECT doc_id, page_no, elem_id, reading_rank FROM v_ordered")
oracle(
    "page_text",
    "SELECT doc_id, page_no, trim(string_agg(CASE WHEN gap IS NULL THEN '' WHEN abs(gap) > 10 THEN chr(10) ELSE ' ' END || text, '' ORDER BY reading_rank)) AS full_text"
    " FROM v_ordered GROUP BY ALL",
)
oracle(
    "line_segments",
    "SELECT doc_id, page_no, line_no, count(*) AS n_tokens, string_agg(text, ' ' ORDER BY reading_rank) AS line_text FROM"
    " (SELECT *, CAST(1 + sum(CAST(coalesce(abs(gap) > 15, false) AS INT)) OVER (PARTITION BY doc_id, page_no ORDER BY reading_rank) AS BIGINT) AS line_no FROM v_ordered)"
    " GROUP BY doc_id, page_no, line_no",
)
_page_scores = ", ".join(_score("t", x) for x in fv.PAGE_LANGUAGE_WORDS.values())
oracle(
    "detect_language_tokens",
    f"SELECT doc_id, page_no, CASE WHEN list_max(s) >= 1 THEN {list(fv.PAGE_LANGUAGE_WORDS)}[list_position(s, list_max(s))] ELSE 'en' END AS language FROM"
    f" (SELECT doc_id, page_no, [{_page_scores}] AS s FROM (SELECT doc_id, page_no, lower(string_agg(text, ' ' ORDER BY reading_rank)) AS t FROM v_ordered GROUP BY ALL))",
)
oracle(
    "cell_grid",
    "WITH RECURSIVE a AS (SELECT doc_id, page_no, table_id, 1 AS row_no, min(y1) AS top FROM v_cells GROUP BY ALL UNION ALL"
    " SELECT c.doc_id, c.page_no, c.table_id, min(a.row_no) + 1 AS row_no, min(c.y1) AS top FROM a JOIN v_cells c ON"
    " c.doc_id = a.doc_id AND c.page_no = a.page_no AND c.table_id = a.table_id AND c.y1 > a.top + 10 GROUP BY c.doc_id, c.page_no, c.table_id)"
    " SELECT doc_id, page_no, table_id, cell_id, row_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no, table_id, row_no ORDER BY x1, y1, cell_id) AS INT) AS col_no FROM"
    " (SELECT c.*, max(a.row_no) AS row_no FROM v_cells c JOIN a ON c.doc_id = a.doc_id AND c.page_no = a.page_no AND c.table_id = a.table_id AND a.top <= c.y1 GROUP BY ALL)",
    recursive=True,
)
oracle(
    "token_cell_join",
    "SELECT c.doc_id, c.page_no, c.table_id, c.cell_id, trim(coalesce(string_agg(t.text, ' ' ORDER BY t.elem_id), '')) AS cell_text FROM v_cells c LEFT JOIN v_tokens t"
    " ON t.doc_id = c.doc_id AND t.page_no = c.page_no AND t.cx BETWEEN c.x1 AND c.x2 AND t.cy BETWEEN c.y1 AND c.y2 GROUP BY ALL",
)

# --- tables --------------------------------------------------------------------------------------------------------
oracle(
    "html_table_cells",
    "SELECT doc_id, CAST(row_no AS INT) AS row_no, CAST(unnest(range(len(r))) AS INT) AS col_no, unnest(r) AS text FROM"
    " (SELECT doc_id, unnest(data) AS r, unnest(range(len(data))) AS row_no FROM v_matrix)",
)
oracle(
    "is_line_item_table",
    "SELECT doc_id, len(data) >= 2 AND ("
    + " OR ".join(f"contains(lower(array_to_string(data[1], ' ')), '{x}')" for x in fv.LINE_TABLE_WORDS)
    + ") AS is_line_items FROM v_matrix",
)


def _role_index(words: list[str]) -> str:
    test = " OR ".join(f"contains(trim(lower(h)), '{x}')" for x in words)
    return f"CAST(nullif(list_position(list_transform(data[1], lambda h: {test}), true), 0) - 1 AS INT)"


oracle("map_columns", "SELECT doc_id, " + ", ".join(f"{_role_index(x)} AS {r}" for r, x in fv.COLUMN_ROLE_WORDS.items()) + " FROM v_matrix")
oracle("table_line_items", "SELECT * FROM v_table_lines")

# --- responses -----------------------------------------------------------------------------------------------------
_body = "nullif(regexp_extract(response, '(?s)[{].*[}]'), '')"
_parsed = f"SELECT *, CASE WHEN json_valid({_body}) THEN {_body} END AS j FROM v_responses"
oracle(
    "parse_llm_json",
    "SELECT doc_key, j IS NOT NULL AS parsed, j->>'$.invoice_id' AS invoice_id, j->>'$.issue_date' AS issue_date,"
    f" j->>'$.total_incl_vat' AS total_incl_vat, j->>'$.supplier.country_code' AS country_code FROM ({_parsed})",
)
_line_json = f"SELECT doc_key, unnest(from_json(j->'$.invoice_lines', '[\"JSON\"]')) AS l, unnest(range(CAST(json_array_length(j->'$.invoice_lines') AS BIGINT))) AS pos FROM ({_parsed})"
_lv = {n: f"(l->>'$.{n}')" for n in ("description", "quantity", "unit_price", "line_total", "vat_rate")}
_rate = money(f"replace({_lv['vat_rate']}, '%', '')")
oracle(
    "clean_line_values",
    f"SELECT doc_key, CAST(pos AS INT) AS pos, {_lv['description']} AS description, {money(_lv['quantity'])} AS quantity, {money(_lv['unit_price'])} AS unit_price,"
    f" {money(_lv['line_total'])} AS line_total, CAST({_rate} * 0.01 AS DECIMAL(9,6)) AS vat_rate FROM ({_line_json})",
)
_raw_date = "(j->>'$.issue_date')"
_model_total = money("(j->>'$.total_incl_vat')")
_n_lines = "coalesce(json_array_length(j->'$.invoice_lines'), 0)"
oracle(
    "structured_from_responses",
    "SELECT doc_key, CASE WHEN j IS NULL THEN 'fallback' ELSE 'model' END AS extraction_method,"
    " CASE WHEN j IS NULL THEN f.invoice_id ELSE j->>'$.invoice_id' END AS invoice_id,"
    f" CASE WHEN j IS NULL THEN f.issue_date ELSE strftime({parse_date(_raw_date)}, '%Y-%m-%d') END AS issue_date,"
    f" CASE WHEN j IS NULL THEN CAST(f.total_incl_vat AS DECIMAL(18,4)) ELSE {_model_total} END AS total_incl_vat,"
    f" CAST({_n_lines} AS INT) AS n_lines,"
    f" CASE WHEN j IS NULL THEN 0.3::DOUBLE ELSE round(least(1.0::DOUBLE, (3 + CAST({_model_total} IS NOT NULL AS INT)) / 4.0::DOUBLE"
    f" + CASE WHEN {_n_lines} > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 2) END AS confidence_score"
    f" FROM (SELECT p.*, {{{', '.join(f"'{n}': {e}" for e, n in [part.rsplit(' AS ', 1) for part in FALLBACK_PARTS])}}} AS f FROM ({_parsed}) p)",
)
_no_total = "coalesce(json_type(j, '$.total_incl_vat'), 'NULL') = 'NULL'"
oracle(
    "response_outcomes",
    f"SELECT doc_key, CASE WHEN j IS NULL THEN 'fallback' WHEN {_no_total} THEN 'raw' ELSE 'model' END AS outcome,"
    f" CASE WHEN j IS NOT NULL AND {_no_total} THEN 'total_incl_vat: field is required' ELSE '' END AS reasons,"
    f" j->>'$.invoice_id' AS invoice_id, j IS NOT NULL AND {_no_total} AS kept_raw FROM ({_parsed})",
)
oracle(
    "completeness_confidence",
    "SELECT doc_key, round(least(1.0::DOUBLE, (CAST(nullif(invoice_id, '') IS NOT NULL AS INT) + CAST(issue_date IS NOT NULL AS INT) + CAST(supplier_name IS NOT NULL AS INT)"
    " + CAST(nullif(total_incl_vat, 0) IS NOT NULL AS INT)) / 4.0::DOUBLE + CASE WHEN n_lines > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 2) AS score FROM v_headers",
)
oracle(
    "extraction_quality",
    "SELECT doc_key, round(q, 6) AS required_fields_present, round(c, 6) AS data_completeness,"
    " round(coalesce(ocr_confidence, 0) * 0.3::DOUBLE + q * 0.4::DOUBLE + c * 0.3::DOUBLE, 6) AS overall_quality FROM ("
    "SELECT *, (CAST(nullif(invoice_id, '') IS NOT NULL AS INT) + 1 + 1 + CAST(nullif(total_incl_vat, 0) IS NOT NULL AS INT)) AS k,"
    " k / 4.0::DOUBLE AS q, (k + CAST(customer_name IS NOT NULL AS INT) + CAST(n_lines > 0 AS INT)) / 6.0::DOUBLE AS c FROM v_headers)",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_templates = {p[1]: p for p in responses.PROMPTS if p[0] == "extraction"}
_hash = " ".join(f"WHEN '{k}' THEN '{hashlib.md5(p[2].encode()).hexdigest()}'" for k, p in _templates.items())
oracle(
    "template_lookup",
    f"SELECT doc_key, lang, CASE lang {_hash} ELSE '{hashlib.md5(_templates['en'][2].encode()).hexdigest()}' END AS template_hash FROM v_responses",
)
_shot = " ".join(f"WHEN '{k}' THEN {_quoted(p[3] + chr(10) * 2 + p[2])}" for k, p in _templates.items())
_shot_en = _quoted(_templates["en"][3] + chr(10) * 2 + _templates["en"][2])
oracle(
    "render_prompts",
    f"SELECT doc_key, replace(replace(CASE lang {_shot} ELSE {_shot_en} END, '{{schema}}', {_quoted(w.PROMPT_SCHEMA)}), '{{invoice_text}}', text) AS prompt FROM v_responses",
)



def _prompt(kind: str, placeholder: str, value: str, template: str = "") -> str:
    texts = {p[1]: _quoted(p[2]) for p in responses.PROMPTS if p[0] == kind}
    chosen = "CASE lang " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in texts.items()) + f" ELSE {texts['en']} END"
    return f"replace({template or chosen}, '{{{placeholder}}}', {value})"


oracle("render_prompts_line_items", f"SELECT doc_key, {_prompt('line_items', 'invoice_text', 'text')} AS prompt FROM v_responses")
oracle("render_prompts_confidence", f"SELECT doc_key, {_prompt('confidence', 'extracted_data', 'response')} AS prompt FROM v_responses")
_bullets = "'- ' || replace(concat_ws('|', nullif(header_errors, ''), row_errors), '|', chr(10) || '- ')"
_correction = _prompt("correction", "extracted_data", "response", _prompt("correction", "errors", _bullets))
oracle(
    "render_prompts_correction",
    f"SELECT doc_key, {_correction} AS prompt FROM v_responses JOIN {_with_header_errors('v_headers')} USING (doc_key)"
    f" LEFT JOIN ({_named_first}) USING (doc_key) WHERE n_errors > 0",
)

# --- merging -------------------------------------------------------------------------------------------------------
oracle(
    "merge_line_sources",
    "SELECT doc_key, 'table' AS source, description, line_total FROM v_lines UNION ALL"
    " SELECT o_orderkey, 'model', o_orderpriority, CAST(o_totalprice AS DECIMAL(18,4)) FROM orders"
    " WHERE o_orderkey NOT IN (SELECT doc_key FROM v_lines)",
)
oracle(
    "merge_line_counts",
    "SELECT doc_key, count(DISTINCT l_linenumber % 2) AS tables_detected, CAST(count(*) AS BIGINT) AS table_line_items FROM v_lines GROUP BY doc_key",
)


def repaired(net: str, vat: str, gross: str, lines: str) -> str:
    test = f"(n_lines > 0 AND (coalesce({net}, 0) = 0 OR abs({net} - {lines}) > 0.01))"
    new_vat = f"CASE WHEN coalesce({vat}, 0) = 0 THEN CAST({lines} * 0.20 AS DECIMAL(18,4)) ELSE {vat} END"
    return (
        f"CASE WHEN {test} THEN {lines} ELSE {net} END AS total_excl_vat, CASE WHEN {test} THEN {new_vat} ELSE {vat} END AS total_vat,"
        f" CAST(CASE WHEN {test} THEN {lines} + {new_vat} ELSE {gross} END AS DECIMAL(18,4)) AS total_incl_vat, {test} AS repaired"
    )


oracle("invoice_totals", f"SELECT doc_key, {repaired('total_excl_vat', 'total_vat', 'total_incl_vat', 'line_sum')} FROM v_headers")
oracle(
    "merge_pages",
    f"WITH pg AS (SELECT *, (l_linenumber + 2) // 3 AS page_no FROM v_lines), h AS (SELECT doc_key, page_no, sum(line_total) AS s, max(l_suppkey) AS k FROM pg GROUP BY ALL),"
    " f AS (SELECT doc_key, CAST(page_no AS INT) AS page_no, CAST(CASE doc_key % 3 WHEN 0 THEN s WHEN 1 THEN NULL ELSE s + 7 END AS DECIMAL(18,4)) AS net,"
    " CAST(CASE WHEN k % 2 = 0 THEN 3 END AS DECIMAL(18,4)) AS vat, CAST(s AS DECIMAL(18,4)) AS gross FROM h QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY page_no) = 1),"
    " t AS (SELECT doc_key, count(*) AS n_lines, CAST(sum(line_total) AS DECIMAL(18,4)) AS ls, count(DISTINCT page_no) AS pages_processed FROM pg GROUP BY doc_key)"
    f" SELECT doc_key, pages_processed, page_no, n_lines, {repaired('net', 'vat', 'gross', 'ls')} FROM f JOIN t USING (doc_key)",
)
oracle(
    "quarantine_split",
    f"SELECT CASE WHEN n = 0 THEN 'valid' ELSE 'quarantine' END AS target, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_errors FROM"
    f" (SELECT {_n_header} + line_errors + tax_errors AS n FROM v_headers) GROUP BY 1",
)

oracle(
    "quarantine_outputs",
    "SELECT doc_key, n = 0 AS is_valid, CAST(n AS BIGINT) AS n_errors, CASE WHEN n = 0 THEN 'valid' ELSE 'quarantine' END AS target FROM"
    f" (SELECT doc_key, {_n_header} + line_errors + tax_errors AS n FROM v_headers)",
)

# --- exports and sinks ---------------------------------------------------------------------------------------------
_tags = [("ID", "invoice_id"), ("IssueDate", "issue_date"), ("InvoiceTypeCode", "invoice_type_code"), ("DocumentCurrencyCode", "currency_code")]
oracle(
    "export_xml",
    "SELECT doc_key, '<Invoice>' || chr(10) || "
    + " || ".join(
        f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = '' THEN '    <{t}></{t}>' || chr(10) ELSE '    <{t}>' || {c} || '</{t}>' || chr(10) END" for t, c in _tags
    )
    + " || '</Invoice>' AS xml FROM v_headers",
)
_money_out = "CAST(total_excl_vat AS DOUBLE) AS net, CAST(total_vat AS DOUBLE) AS vat, CAST(total_incl_vat AS DOUBLE) AS gross"
oracle("export_peppol", f"SELECT doc_key, currency_code AS currency, supplier_name, {_money_out} FROM v_headers")
oracle("export_peppol_lines", "SELECT doc_key, l_linenumber AS line_no, line_ref, description, quantity, unit_price, line_total FROM v_lines")
oracle(
    "sink_xml_headers",
    "SELECT doc_key, invoice_id, issue_date, currency_code, supplier_name, customer_name, customer_country_code, due_date, total_incl_vat FROM v_headers",
)
oracle("sink_xml_lines", "SELECT doc_key, line_ref, line_id, description, quantity, unit_price, line_total, vat_category FROM v_lines")
oracle("sink_json", "SELECT doc_key, currency_code AS currency, CAST(n_lines AS INT) AS n_lines, CAST(total_incl_vat AS DOUBLE) AS gross FROM v_headers")
oracle(
    "scan_json_invoices",
    f"SELECT j IS NOT NULL AS well_formed, count(*) AS n, sum({_model_total}) AS total FROM (SELECT CASE WHEN json_valid(response) THEN response END AS j FROM v_responses) GROUP BY 1",
)
oracle("sink_csv_lines", "SELECT doc_key, line_ref, description, quantity, line_total FROM v_lines")

# --- files ---------------------------------------------------------------------------------------------------------
_document_files = "SELECT doc_id, coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS folder, md5(text) AS text_md5 FROM documents"
oracle("scan_files", _document_files)
oracle("stream_files", _document_files)
_ext = "lower(regexp_extract(filename, '[^/.]([.][^./]+)$', 1))"
oracle("file_inventory", f"SELECT {_ext} AS extension, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS bytes, round(CAST(sum(length) AS DOUBLE) / 1048576, 2) AS size_mb FROM v_files GROUP BY 1")
oracle("list_by_extension", "SELECT filename FROM v_files WHERE filename LIKE '%.pdf' OR filename LIKE '%.png'")
_reason = (
    "CASE WHEN filename = '' THEN 'Filename is required' WHEN " + _ext + " NOT IN ('.pdf','.jpg','.jpeg','.png','.tiff','.bmp')"
    f" THEN 'Unsupported file type' WHEN length > {fv.MAX_UPLOAD_BYTES} THEN 'File too large' END"
)
oracle("filter_upload_rules", f"SELECT doc_id, {_reason} IS NULL AS accepted, {_reason} AS reason FROM v_files")
oracle("file_hash", "SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
oracle("aged_files", "SELECT doc_id, '/archive/2024-03-01/' || filename AS target FROM v_files WHERE modificationTime < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 720 HOUR")
_quality = "(least(sharpness / 1000, 1.0::DOUBLE) + least(contrast / 128, 1.0::DOUBLE) + (1.0::DOUBLE - abs(brightness - 128) / 128)) / 3"
oracle("page_quality_gate", f"SELECT page_key, round({_quality}, 9) AS quality, sharpness >= 100 AND contrast >= 20 AND {_quality} >= 0.3::DOUBLE AS suitable FROM v_page_metrics")

# --- activity log --------------------------------------------------------------------------------------------------
oracle("slow_ops", "SELECT event_id, operation, duration FROM v_log WHERE duration > 5.0::DOUBLE")
_ok, _failed = "count(*) FILTER (success)", "count(*) FILTER (NOT success)"
oracle(
    "batch_summary",
    f"SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS total_files, {_ok} AS processed_files, {_failed} AS failed_files,"
    f" round({_ok} / count(*)::DOUBLE, 9) AS success_rate, round(sum(duration), 4) AS processing_time FROM v_log GROUP BY 1",
)
oracle(
    "processing_stats",
    f"SELECT count(*) AS processed_count, {_ok} AS success_count, {_failed} AS error_count, round(sum(duration), 4) AS total_processing_time,"
    " round(avg(duration), 9) AS avg_processing_time FROM v_log",
)
oracle("operation_counts", f"SELECT operation, {_ok} AS success_count, {_failed} AS error_count FROM v_log GROUP BY operation")


def _recent(hours: int) -> str:
    return f"ts > TIMESTAMP '{w.LOG_NOW}' - INTERVAL {hours} HOUR"


_marks = ", ".join(f"list_sort(list(duration))[CAST(floor(count(*) * {q}::DOUBLE) AS BIGINT) + 1] AS p{n}_duration" for n, q in ((50, 0.5), (90, 0.9), (95, 0.95), (99, 0.99)))
oracle(
    "performance_stats",
    f"SELECT operation, {24 * 14} AS period_hours, count(*) AS total_operations, {_ok} AS successful_operations, {_failed} AS failed_operations,"
    f" round({_ok} / count(*)::DOUBLE, 9) AS success_rate, round(avg(duration), 9) AS average_duration, min(duration) AS min_duration, max(duration) AS max_duration,"
    f" round(count(*) / {24 * 14}.0::DOUBLE, 9) AS operations_per_hour, {_marks}, list_sort(list(duration))[count(*) // 2 + 1] AS median_duration FROM v_log WHERE {_recent(24 * 14)} GROUP BY operation",
)
oracle(
    "llm_metrics",
    "SELECT operation AS model, CASE WHEN user_id % 2 = 0 THEN 'batched' ELSE 'single' END AS backend, count(*) AS total_requests,"
    " round(sum(duration), 4) AS total_time, round(avg(duration), 9) AS avg_time_per_request FROM v_log GROUP BY ALL",
)
oracle("error_rate", f"SELECT count(*) AS total_operations, round(1 - {_ok} / count(*)::DOUBLE, 9) AS error_rate FROM v_log WHERE {_recent(48)}")
oracle(
    "latest_n",
    f"SELECT metric, CAST(rank AS INT) AS rank, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rank FROM v_samples) WHERE rank <= {fv.SAMPLES_KEEP}",
)
oracle("latest_log", f"SELECT event_id, operation, duration FROM v_log ORDER BY ts DESC, event_id DESC LIMIT {fv.LOG_KEEP}")
oracle("metric_history", f"SELECT event_id, value FROM v_samples WHERE metric = 'cpu_usage' AND {_recent(72)}")
oracle("metric_retention", f"SELECT event_id, operation FROM v_log WHERE {_recent(168)}")
_limits = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in fv.ALERT_THRESHOLDS.items()) + " END"
BREACHES = f"SELECT event_id, metric, CASE WHEN metric = 'error_rate' THEN 'critical' ELSE 'warning' END AS severity, value, ts FROM v_samples WHERE value > {_limits}"
oracle("alerts_threshold", f"SELECT event_id, metric, severity, value FROM ({BREACHES})")
_b = f"SELECT metric, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS rn FROM ({BREACHES})"
oracle(
    "alert_cooldown",
    f"WITH RECURSIVE b AS MATERIALIZED ({_b}), e AS (SELECT metric, event_id, rn, us AS last, true AS emit FROM b WHERE rn = 1 UNION ALL"
    " SELECT b.metric, b.event_id, b.rn, CASE WHEN b.us - e.last > 3600000000 THEN b.us ELSE e.last END, b.us - e.last > 3600000000"
    " FROM e JOIN b ON b.metric = e.metric AND b.rn = e.rn + 1) SELECT event_id, metric, emit FROM e",
    recursive=True,
)
oracle(
    "stream_alert_cooldown",
    f"WITH RECURSIVE b AS MATERIALIZED ({_b}), e AS (SELECT metric, event_id, rn, us, us AS last, true AS emit FROM b WHERE rn = 1 UNION ALL"
    " SELECT b.metric, b.event_id, b.rn, b.us, CASE WHEN b.us - e.last > 3600000000 THEN b.us ELSE e.last END, b.us - e.last > 3600000000"
    " FROM e JOIN b ON b.metric = e.metric AND b.rn = e.rn + 1) SELECT event_id, metric, us FROM e"
    " WHERE emit AND us <= ((SELECT max(us) FROM b) // 1000 - 21600000) * 1000",
    recursive=True,
)
oracle(
    "stream_alerts_complete",
    f"WITH RECURSIVE b AS MATERIALIZED ({_b}), e AS (SELECT metric, event_id, rn, us, us AS last, true AS emit FROM b WHERE rn = 1 UNION ALL"
    " SELECT b.metric, b.event_id, b.rn, b.us, CASE WHEN b.us - e.last > 3600000000 THEN b.us ELSE e.last END, b.us - e.last > 3600000000"
    " FROM e JOIN b ON b.metric = e.metric AND b.rn = e.rn + 1) SELECT event_id, metric, us FROM e WHERE emit",
    recursive=True,
)
_period = 6 * 3600 * 1000000
_r = "SELECT client, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM v_requests"
_live = f"list_filter(q.log, lambda x: r.us - x < {_period})"
oracle(
    "rate_limit",
    f"WITH RECURSIVE r AS MATERIALIZED ({_r}), q AS (SELECT client, event_id, rn, [us] AS log, true AS admitted, 1 AS remaining, 0 AS retry_after FROM r WHERE rn = 1 UNION ALL"
    f" SELECT r.client, r.event_id, r.rn, CASE WHEN len({_live}) < 2 THEN list_append({_live}, r.us) ELSE {_live} END, len({_live}) < 2,"
    f" CAST(CASE WHEN len({_live}) < 2 THEN 1 - len({_live}) ELSE 0 END AS INT), CAST(CASE WHEN len({_live}) < 2 THEN 0 ELSE ({_live}[1] + {_period} - r.us) // 1000000 END AS INT)"
    " FROM q JOIN r ON r.client = q.client AND r.rn = q.rn + 1) SELECT event_id, admitted, remaining, retry_after FROM q",
    recursive=True,
)
oracle(
    "health_rollup",
    "SELECT host, CASE max(l) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status, count(*) FILTER (l = 1) AS warnings, count(*) AS checks FROM"
    " (SELECT host, metric, CASE WHEN value IS NULL THEN 2 WHEN value >= 90 THEN 1 ELSE 0 END AS l FROM v_samples QUALIFY row_number() OVER (PARTITION BY host, metric ORDER BY ts DESC, event_id DESC) = 1) GROUP BY host",
)

# --- nested and streaming ------------------------------------------------------------------------------------------
_line_errors = (
    "CAST(abs(quantity * unit_price - line_total) > 0.01 AS INT) + CAST(trim(description) = '' AS INT) + CAST(line_id IS NULL AS INT)"
    " + CAST(length(unit_code) > 10 AS INT) + CAST(vat_category NOT IN ('S','Z','E','AE','O') AS INT)"
)
_line_id = "concat('L-', doc_key, '-', line_ref)"
_line_filled = "(80 + 21 + 7 * CAST(round(line_total * vat_rate, 2) <> 0 AS INT)) / 154.0::DOUBLE"
oracle(
    "validate_nested",
    f"SELECT {_line_id} AS invoice_id, ({_line_errors}) = 0 AS is_valid, CAST({_line_errors} AS BIGINT) AS n_errors,"
    f" round((1.0::DOUBLE - CASE WHEN abs(quantity * unit_price - line_total) > 0.01 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + {_line_filled}) / 2, 6) AS confidence_score FROM v_lines",
)
oracle(
    "stream_validate",
    f"SELECT {_line_id} AS invoice_id, CAST({_line_errors} AS BIGINT) AS n_errors, CASE WHEN ({_line_errors}) = 0 THEN 'valid' ELSE 'quarantine' END AS target FROM v_lines",
)
oracle(
    "stream_validate_orders",
    "SELECT doc_key, CAST(n AS BIGINT) AS n_errors, CASE WHEN n = 0 THEN 'valid' ELSE 'quarantine' END AS target FROM"
    f" (SELECT doc_key, {_n_header} + line_errors + tax_errors AS n FROM v_headers)",
)
_window_stats = (
    f"operation, count(*) AS total_operations, {_ok} AS successful_operations, round({_ok} / count(*)::DOUBLE, 9) AS success_rate,"
    " round(avg(duration), 9) AS average_duration, min(duration) AS min_duration, max(duration) AS max_duration"
)
oracle(
    "stream_performance_stats",
    "SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS window_end,"
    f" {_window_stats} FROM (SELECT *, date_trunc('hour', ts) AS s FROM v_log) GROUP BY s, operation",
)
oracle(
    "stream_sliding_stats",
    "SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(s + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M') AS window_end,"
    f" {_window_stats} FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k FOR k IN range(4)]) AS s FROM v_log) GROUP BY s, operation",
)
oracle(
    "stream_processing_stats",
    f"SELECT count(*) AS processed_count, {_ok} AS success_count, {_failed} AS error_count, round(sum(duration), 4) AS total_processing_time,"
    " round(avg(duration), 9) AS avg_processing_time FROM v_log",
)
