"""Invoice rules and scores.

Invoices are held as a header table and a line table. Rules are plain conditions over columns, written once and used
both on long line rows and inside nested arrays. A header is judged in one narrow projection; all it needs from its
lines and tax rows is one small summary, which partial aggregation makes before any shuffle, so an invoice with very
many lines costs no more than any other.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import MONEY, parse_date_any, parse_money, present

Get = Callable[[str], Column]
Rule = tuple[str, str, Column, Column]  # field, message, broken when, offending value

ZERO = "0BD"
TAX_FIELDS = ["taxable_amount", "tax_amount", "tax_rate", "tax_category"]
AMOUNTS = ["total_excl_vat", "total_vat", "total_incl_vat", "payable_amount"]


def _cent() -> Column:
    return F.expr("0.01BD")


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def _num(value: Column) -> Column:
    return F.coalesce(value, F.expr(ZERO))


def typed_amounts(df: DataFrame, names: list[str] = AMOUNTS) -> DataFrame:
    """Reads string amounts as decimals, keeping the text beside them as <name>_raw; decimals pass through."""
    for name in names:
        if isinstance(df.schema[name].dataType, T.StringType):
            df = df.withColumns({f"{name}_raw": F.col(name), name: parse_money(F.col(name))})
    return df


def prepared(df: DataFrame) -> DataFrame:
    """Typed amounts (those there are), and the parsed dates as columns of their own, so that several rules share one parse."""
    due = F.col("payment_terms.payment_due_date") if "payment_terms" in df.columns else F.lit(None).cast("string")
    days = {"_issued": parse_date_any(F.col("issue_date")), "_due": parse_date_any(due)}
    return typed_amounts(df, [name for name in AMOUNTS if name in df.columns]).withColumns(days)


# --- lines and tax rows --------------------------------------------------------------------------------------------
def line_arithmetic_broken(get: Get) -> Column:
    return F.abs(_num(get("quantity")) * _num(get("unit_price")) - _num(get("line_total"))) > _cent()


def _needed(get: Get, name: str, texts: bool) -> list[Rule]:
    """A number that must be there. With texts, <name>_raw tells one that can't be read from one that is missing; a row breaks
    at most one of the two rules."""
    v, none = get(name), F.lit(None).cast("string")
    if not texts:
        return [(name, "field is required", v.isNull(), none)]
    raw = get(f"{name}_raw")
    return [
        (name, "field is required", v.isNull() & raw.isNull(), none),
        (name, "is not a number", v.isNull() & raw.isNotNull(), raw),
    ]


def line_schema_rules(get: Get, texts: bool = False) -> list[Rule]:
    """`texts` tells that the texts of the numbers stand beside them as <name>_raw."""

    def number(name: str, top: Column | None = None) -> list[Rule]:
        v = get(name)
        rules = [*_needed(get, name, texts), (name, "must be at least 0", _true(v < 0), v.cast("string"))]
        if top is not None:
            rules.append((name, "must be at most 1", _true(v > top), v.cast("string")))
        return rules

    none = F.lit(None).cast("string")
    description, unit, category = get("description"), get("unit_code"), get("vat_category")
    return [
        ("line_id", "field is required", get("line_id").isNull(), none),
        ("description", "field is required", description.isNull(), none),
        ("description", "is too long", _true(F.length(description) > fv.MAX_LENGTHS["line.description"]), description),
        *number("quantity"),
        ("unit_code", "is too long", _true(F.length(unit) > fv.MAX_LENGTHS["line.unit_code"]), unit),
        *number("unit_price"),
        *number("line_total"),
        ("vat_category", "is not an allowed code", _true(~category.isin(fv.VAT_CATEGORIES)), category),
        *number("vat_rate", F.lit(1)),
    ]


def line_total_rules(get: Get, off: Column | None = None) -> list[Rule]:
    """`off` may hold the outcome of line_arithmetic_broken."""
    return [
        (
            "line_total",
            "Line total does not match quantity times unit price",
            line_arithmetic_broken(get) if off is None else off,
            get("line_total").cast("string"),
        ),
        ("description", "Line item description is required", _blank(get("description")), get("description")),
    ]


def line_rules(get: Get, off: Column | None = None, texts: bool = False) -> list[Rule]:
    return line_schema_rules(get, texts) + line_total_rules(get, off)


def tax_calculation_broken(get: Get) -> Column:
    return _true(F.abs(get("taxable_amount") * get("tax_rate") - get("tax_amount")) > _cent())


def tax_schema_rules(get: Get, texts: bool = False) -> list[Rule]:
    rules: list[Rule] = []
    for name in TAX_FIELDS[:3]:
        v = get(name)
        rules += _needed(get, name, texts)
        rules.append((name, "must be at least 0", _true(v < 0), v.cast("string")))
    rate, category = get("tax_rate"), get("tax_category")
    return rules + [
        ("tax_category", "field is required", category.isNull(), F.lit(None).cast("string")),
        ("tax_rate", "must be at most 1", _true(rate > 1), rate.cast("string")),
        ("tax_category", "is not an allowed code", _true(~category.isin(fv.VAT_CATEGORIES)), category),
    ]


def tax_rules(get: Get, texts: bool = False) -> list[Rule]:
    return tax_schema_rules(get, texts) + [
        (
            "tax_amount",
            "Tax amount does not match taxable amount times rate",
            tax_calculation_broken(get),
            get("tax_amount").cast("string"),
        ),
    ]


def _count_broken(rules: list[Rule]) -> Column:
    return reduce(operator.add, [broken.cast("int") for _, _, broken, _ in rules])


def _line_measures(get: Get, off: Column | None = None) -> dict[str, Column]:
    """Per line: its net amount, whether it breaks its arithmetic for the score, and how many rules it breaks."""
    off = line_arithmetic_broken(get) if off is None else off
    positive = _true((get("quantity") > 0) & (get("unit_price") > 0) & (get("line_total") > 0))
    return {
        "line_sum": _num(get("line_total")),
        "bad_lines": (off & positive).cast("int"),
        "line_errors": _count_broken(line_rules(get, off)),
    }


def _tax_measures(get: Get) -> dict[str, Column]:
    taxable, amount, rate = (_num(get(n)) for n in TAX_FIELDS[:3])
    off = F.abs(taxable * rate - amount) > _cent()
    return {"bad_taxes": ((taxable > 0) & (rate > 0) & off).cast("int"), "tax_errors": _count_broken(tax_rules(get))}


def line_sums() -> dict[str, Column]:
    """Aggregates over line rows that make up the line part of an invoice summary."""
    sums = {n: F.sum(c) for n, c in _line_measures(F.col).items()}
    return {"n_lines": F.count(F.lit(1)), **sums}


def summarise_lines(lines: DataFrame, key: str) -> DataFrame:
    """One row per invoice: line count, line sum and broken-rule counts."""
    return lines.groupBy(key).agg(*[c.alias(n) for n, c in line_sums().items()])


def summarise_taxes(taxes: DataFrame, key: str) -> DataFrame:
    return taxes.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in _tax_measures(F.col).items()])


def summarise_by_rate(rates: DataFrame, key: str, **more: Column) -> DataFrame:
    """Whole summary of each invoice from tax rows that carry line_sums: one scan of the lines serves both parts."""
    carried = [F.sum(n).alias(n) for n in line_sums()]
    taxes = [F.sum(c).alias(n) for n, c in _tax_measures(F.col).items()]
    return rates.groupBy(key).agg(*carried, *taxes, *[c.alias(n) for n, c in more.items()])


def summarise_nested(df: DataFrame) -> DataFrame:
    """The same summary for invoices that carry their lines and tax rows as arrays; no shuffle."""

    def measured(array: str, measures: Callable[[Get], dict[str, Column]]) -> Column:
        return F.transform(array, lambda x: F.struct(*[c.alias(n) for n, c in measures(x.getField).items()]))

    def total(array: str, name: str, kind: str) -> Column:
        start = F.lit(0).cast(kind)
        return F.coalesce(F.aggregate(F.col(array)[name], start, lambda acc, x: (acc + x).cast(kind)), start)

    # Array functions are interpreted and share nothing, so the costly product is taken once per line beforehand.
    names = df.schema["invoice_lines"].dataType.elementType.names
    checked = F.transform(
        "invoice_lines", lambda x: F.struct(*[x[n].alias(n) for n in names], line_arithmetic_broken(x.getField).alias("_off"))
    )
    lines = F.transform(
        checked, lambda x: F.struct(*[c.alias(n) for n, c in _line_measures(x.getField, x["_off"]).items()])
    )
    rows = df.withColumns({"_l": lines, "_t": measured("tax_breakdown", _tax_measures)})
    sums = {
        "n_lines": F.coalesce(F.array_size("invoice_lines"), F.lit(0)).cast("long"),
        "line_sum": total("_l", "line_sum", "decimal(28,4)"),
        "bad_lines": total("_l", "bad_lines", "long"),
        "line_errors": total("_l", "line_errors", "long"),
        "bad_taxes": total("_t", "bad_taxes", "long"),
        "tax_errors": total("_t", "tax_errors", "long"),
    }
    return rows.withColumns(sums).drop("_l", "_t")


def unnest_lines(df: DataFrame, key: str) -> DataFrame:
    """Lines of nested invoices as rows, referenced by their position."""
    return df.select(key, F.posexplode("invoice_lines").alias("pos", "line")).select(
        key, F.col("pos").cast("string").alias("line_ref"), "line.*"
    )


def unnest_taxes(df: DataFrame, key: str) -> DataFrame:
    """Tax rows of nested invoices as rows."""
    return df.select(key, F.explode("tax_breakdown").alias("tax")).select(key, "tax.*")


# --- header rules --------------------------------------------------------------------------------------------------
def header_schema_rules(df: DataFrame) -> list[Rule]:
    none = F.lit(None).cast("string")

    def required(path: str) -> Rule:
        return (path, "field is required", F.col(path).isNull(), none)

    def short(path: str, limit: str) -> Rule:
        return (path, "is too long", _true(F.length(F.col(path)) > fv.MAX_LENGTHS[limit]), F.col(path))

    def code(path: str, allowed: list[str]) -> Rule:
        return (path, "is not an allowed code", _true(~F.col(path).isin(allowed)), F.col(path))

    issued = F.col("issue_date")
    slashed = issued.rlike("^[0-9]{4}/")  # the one date form the schema itself does not take
    rules = [
        required("invoice_id"),
        short("invoice_id", "invoice_id"),
        required("issue_date"),
        ("issue_date", "is not a date", issued.isNotNull() & (F.col("_issued").isNull() | slashed), issued),
        code("invoice_type_code", fv.INVOICE_TYPES),
        code("currency_code", fv.INVOICE_CURRENCIES),
        short("purchase_order_reference", "purchase_order_reference"),
        short("contract_reference", "contract_reference"),
    ]
    for party in ("supplier", "customer"):
        vat = F.col(f"{party}.vat_id")
        rules += [
            required(f"{party}.name"),
            short(f"{party}.name", "party.name"),
            (
                f"{party}.vat_id",
                "must start with a country code",
                _true((F.length(vat) > 2) & ~vat.rlike(r"^\p{L}{2}")),
                vat,
            ),
            short(f"{party}.address_line", "party.address_line"),
            short(f"{party}.city", "party.city"),
            short(f"{party}.postal_code", "party.postal_code"),
            required(f"{party}.country_code"),
            code(f"{party}.country_code", list(fv.VAT_ID_SHAPES)),
        ]
    for name in AMOUNTS:
        raw = f"{name}_raw"
        if raw in df.columns:
            rules.append((name, "is not a number", F.col(raw).isNotNull() & F.col(name).isNull(), F.col(raw)))
            if name != "payable_amount":
                rules.append((name, "field is required", F.col(raw).isNull(), none))
        elif name != "payable_amount":
            rules.append(required(name))
        rules.append((name, "must be at least 0", _true(F.col(name) < 0), F.col(name).cast("string")))
    if "payment_terms" in df.columns:
        rules.append(short("payment_terms.payment_terms", "payment_terms"))
    return rules


def invoice_number_ok(value: Column) -> Column:
    return F.coalesce(F.length(value) >= 3, F.lit(False))


def vat_id_ok(vat_id: Column, country: Column) -> Column:
    """Whole id fits the shape of its country; unknown countries pass, a missing id or country does not."""
    code, number = F.upper(country), F.upper(vat_id)
    fits = None
    for known, shape in fv.VAT_ID_SHAPES.items():
        test = number.rlike(f"^{shape}$")
        fits = F.when(code == known, test) if fits is None else fits.when(code == known, test)
    return F.when(present(vat_id) & present(country), fits.otherwise(F.lit(True))).otherwise(F.lit(False))


def number_and_vat_rules() -> list[Rule]:
    rules = [
        ("invoice_id", "Invoice number format is invalid", ~invoice_number_ok(F.col("invoice_id")), F.col("invoice_id"))
    ]
    for party in ("supplier", "customer"):
        vat = F.col(f"{party}.vat_id")
        bad = present(vat) & ~vat_id_ok(vat, F.col(f"{party}.country_code"))
        rules.append((f"{party}.vat_id", f"{party.capitalize()} VAT ID format is invalid", bad, vat))
    return rules


def totals_rules() -> list[Rule]:
    net, vat, gross = (_num(F.col(n)) for n in AMOUNTS[:3])
    lines_off = (F.col("n_lines") > 0) & (F.abs(F.col("line_sum") - net) > _cent())
    return [
        (
            "total_incl_vat",
            "Total including VAT does not match net plus VAT",
            F.abs(net + vat - gross) > _cent(),
            gross.cast("string"),
        ),
        ("total_excl_vat", "Total excluding VAT does not match the lines", _true(lines_off), net.cast("string")),
    ]


def date_rules(as_of: str) -> list[Rule]:
    """`as_of` is the day that counts as today."""
    issue_text, due_text = F.col("issue_date"), F.col("payment_terms.payment_due_date")
    issued, due = F.col("_issued"), F.col("_due")
    today = F.lit(as_of).cast("date")
    due_field = "payment_terms.payment_due_date"
    return [
        ("issue_date", "Invalid date format", present(issue_text) & issued.isNull(), issue_text),
        ("issue_date", "Issue date cannot be in the future", _true(issued > today), issue_text),
        (due_field, "Invalid payment due date format", present(due_text) & due.isNull(), due_text),
        (due_field, "Payment due date cannot be before issue date", _true(due < issued), due_text),
    ]


def header_rules(df: DataFrame, as_of: str) -> list[Rule]:
    dated = date_rules(as_of) if "payment_terms" in df.columns else date_rules(as_of)[:2]
    return header_schema_rules(df) + number_and_vat_rules() + totals_rules() + dated


def rule_array(rules: list[Rule], prefix: Column | None = None) -> Column:
    """One struct<field, message, value> per rule, in rule order, null where the rule holds."""

    def path(field: str) -> Column:
        return F.lit(field) if prefix is None else F.concat(prefix, F.lit("."), F.lit(field))

    entries = [
        F.when(broken, F.struct(path(f).alias("field"), F.lit(m).alias("message"), v.cast("string").alias("value")))
        for f, m, broken, v in rules
    ]
    return F.array(*entries)


def with_errors(df: DataFrame, rules: list[Rule], out: str = "errors", count: str = "n_header_errors") -> DataFrame:
    """Adds the broken rules and their number. All rules are evaluated in one generated projection, as a column that
    the next one reads twice; inside the filter function itself they would be interpreted one by one."""
    kept = F.filter("_rules", lambda e: e.isNotNull())
    return df.withColumn("_rules", rule_array(rules)).withColumns({out: kept, count: F.size(kept)}).drop("_rules")


def broken_rows(df: DataFrame, keys: list[str], rules: list[Rule], prefix: Column | None = None) -> DataFrame:
    """Broken rules as rows: keys, field, message, value."""
    found = df.select(*keys, F.explode(rule_array(rules, prefix)).alias("e")).where(F.col("e").isNotNull())
    return found.select(*keys, "e.field", "e.message", "e.value")


def line_prefix() -> Column:
    return F.concat(F.lit("invoice_lines."), F.col("line_ref"))


def tax_prefix() -> Column:
    """A tax row is named by its rate and category."""
    name = F.concat_ws("-", F.col("tax_rate").cast("string"), "tax_category")
    return F.concat(F.lit("tax_breakdown."), name)


def all_errors(headers: DataFrame, lines: DataFrame, taxes: DataFrame, key: str, as_of: str) -> DataFrame:
    """Every broken header, line and tax row rule as one row. Where the texts of numbers stand beside them as <name>_raw, one
    that can't be read is told from one that is missing."""
    headers = prepared(headers)
    texts = "quantity_raw" in lines.columns, "tax_amount_raw" in taxes.columns
    of_headers = broken_rows(headers, [key], header_rules(headers, as_of))
    of_lines = broken_rows(lines, [key], line_rules(F.col, texts=texts[0]), line_prefix())
    return of_headers.unionByName(of_lines).unionByName(broken_rows(taxes, [key], tax_rules(F.col, texts[1]), tax_prefix()))


# --- error lists of whole invoices ---------------------------------------------------------------------------------
ENTRY = "array<struct<rule:int,field:string,message:string,n:bigint,first:string>>"


def _numbered(rules: list[Rule], start: int, table: str) -> list[tuple[int, str, str, Column]]:
    return [(start + i, f"{table}.*.{field}", message, broken) for i, (field, message, broken, _) in enumerate(rules)]


def _row_rules(line: Get, tax: Get, texts: tuple[bool, bool] = (False, False)) -> tuple[list, list]:
    of_lines = _numbered(line_rules(line, texts=texts[0]), 0, "invoice_lines")
    return of_lines, _numbered(tax_rules(tax, texts[1]), len(of_lines), "tax_breakdown")


def _keeps_texts(df: DataFrame, array: str, name: str) -> bool:
    return f"{name}_raw" in df.schema[array].dataType.elementType.names


def rule_summary(lines: DataFrame, taxes: DataFrame, key: str) -> DataFrame:
    """(key, row_errors): for each broken line and tax row rule of an invoice its number, field, message, how many rows break
    it, and the smallest name of such a row. Broken rows are counted by invoice and rule, by partial aggregation; what is
    gathered for an invoice are its broken rules, which are no more than there are rules, however many lines it has."""

    def broken(rows: DataFrame, name: Column, rules: list) -> DataFrame:
        tests = F.array(*[F.when(test, F.lit(number)) for number, _, _, test in rules])
        found = rows.select(key, name.alias("first"), F.explode(F.array_compact(tests)).alias("rule"))
        return found.groupBy(key, "rule").agg(F.count("*").alias("n"), F.min("first").alias("first"))

    of_lines, of_taxes = _row_rules(F.col, F.col)
    tax_name = F.concat_ws("-", F.col("tax_rate").cast("string"), "tax_category")
    counted = broken(lines, F.col("line_ref"), of_lines).unionByName(broken(taxes, tax_name, of_taxes))
    known = {number: (field, message) for number, field, message, _ in of_lines + of_taxes}
    text = [F.create_map(*[F.lit(x) for number, t in known.items() for x in (number, t[i])])[F.col("rule")] for i in (0, 1)]
    entry = F.struct("rule", text[0].alias("field"), text[1].alias("message"), "n", "first")
    return counted.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("row_errors"))


def nested_rule_summary(df: DataFrame) -> DataFrame:
    """Adds the same to invoices that carry their lines and tax rows; the first row is named by its position. The rules are
    tested once per row, into a column of flags that the counts of all rules read."""
    texts = _keeps_texts(df, "invoice_lines", "quantity"), _keeps_texts(df, "tax_breakdown", "tax_rate")
    nothing: Get = lambda name: F.lit(None)
    rules = dict(zip(("invoice_lines", "tax_breakdown"), _row_rules(nothing, nothing, texts)))

    def flags(array: str, of_table: int) -> Column:
        return F.transform(array, lambda x: F.array(*[test for _, _, _, test in _row_rules(x.getField, x.getField, texts)[of_table]]))

    def entry(array: str, at: int, number: int, field: str, message: str) -> Column:
        hits = F.filter(F.transform(f"_of_{array}", lambda f, k: F.when(f[at], k)), lambda k: k.isNotNull())
        named = [F.lit(number).alias("rule"), F.lit(field).alias("field"), F.lit(message).alias("message")]
        return F.when(F.size(hits) > 0, F.struct(*named, F.size(hits).cast("bigint").alias("n"), hits[0].cast("string").alias("first")))

    entries = [entry(t, at, *rule[:3]) for t, of in rules.items() for at, rule in enumerate(of)]
    tested = df.withColumns({f"_of_{t}": flags(t, i) for i, t in enumerate(rules)})
    return tested.withColumn("row_errors", F.array_compact(F.array(*entries)).cast(ENTRY)).drop(*(f"_of_{t}" for t in rules))


def validate_whole(headers: DataFrame, lines: DataFrame, taxes: DataFrame, key: str, as_of: str) -> DataFrame:
    """validate, with every broken rule of the header, the lines and the tax rows in `all_errors`: field, message, n (rows
    that break it) and first (the smallest name of one; null for the header), in rule order. The n of an invoice add up to its n_errors."""
    judged = validate(headers, as_of).join(rule_summary(lines, taxes, key), key, "left")
    return judged.withColumn("all_errors", _all_listed(F.col("row_errors"))).drop("row_errors")


def _all_listed(row_errors: Column) -> Column:
    def entry(e: Column, n: Column, first: Column) -> Column:
        return F.struct(e["field"].alias("field"), e["message"].alias("message"), n.cast("bigint").alias("n"), first.cast("string").alias("first"))

    of_header = F.transform("errors", lambda e: entry(e, F.lit(1), F.lit(None)))
    of_rows = F.transform(F.coalesce(row_errors, F.array().cast(ENTRY)), lambda e: entry(e, e["n"], e["first"]))
    return F.concat(of_header, of_rows)


# --- warnings ------------------------------------------------------------------------------------------------------
def default_currency(country: Column) -> Column:
    """Currency of a country, whatever its case; unknown countries give null."""
    known = F.create_map(*[F.lit(x) for kv in fv.COUNTRY_CURRENCY.items() for x in kv])
    return F.try_element_at(known, F.upper(country))


def warnings(with_terms: bool = True) -> Column:
    """Warning texts of an invoice header, in rule order. The texts differ, so taking
    the set difference with [null] only drops the nulls, and stays in generated code."""
    currency, home = F.col("currency_code"), default_currency(F.col("supplier.country_code"))
    gross = _num(F.col("total_incl_vat"))
    due = F.col("payment_terms.payment_due_date").isNull() if with_terms else F.lit(True)
    tests = [
        (
            present(currency) & _true(currency != home),
            F.concat(
                F.lit("Invoice currency "), currency, F.lit(" differs from supplier's default currency "), home
            ),
        ),
        (F.col("issue_date").isNull(), F.lit("Missing recommended field: issue_date")),
        (due, F.lit("Missing recommended field: payment_terms.payment_due_date")),
        (F.col("total_incl_vat").isNull(), F.lit("Missing recommended field: total_incl_vat")),
        (~present(F.col("customer.vat_id")), F.lit("Customer VAT ID is missing")),
        (~present(F.col("purchase_order_reference")), F.lit("Purchase order reference is missing")),
        (gross > 100000, F.concat(F.lit("Invoice total "), gross.cast(MONEY).cast("string"), F.lit(" is unusually high"))),
    ]
    return F.array_except(F.array(*[F.when(cond, text) for cond, text in tests]), F.array(F.lit(None).cast("string")))


# --- scores --------------------------------------------------------------------------------------------------------
def completeness() -> Column:
    """Weighted share of filled fields: required 1.0, important 0.7, optional 0.3. Empty, 0 and [] are not filled."""

    def filled(path: str) -> Column:
        if path == "invoice_lines":
            return F.coalesce(F.col("n_lines") > 0, F.lit(False))
        return present(F.col(path), path in AMOUNTS)

    weighted = [(fv.REQUIRED_FIELDS, 10), (fv.IMPORTANT_FIELDS, 7), (fv.OPTIONAL_FIELDS, 3)]
    most = sum(len(fields) * w for fields, w in weighted)
    got = reduce(operator.add, [filled(f).cast("int") * F.lit(w) for fields, w in weighted for f in fields])
    return got / F.lit(float(most))


def consistency() -> Column:
    """1 less the penalties for totals, payable amount, line sum, lines, tax rows and currency; 0.01 at least."""
    net, vat, gross, payable = (_num(F.col(n)) for n in AMOUNTS)
    off = F.lit(0.0)

    def relative(a: Column, b: Column) -> Column:
        top = F.greatest(F.abs(a.cast("double")), F.abs(b.cast("double")))
        return F.abs((a - b).cast("double")) / F.nullif(top, F.lit(0.0))

    doubled = F.least(relative(net + vat, gross) * 2, F.lit(0.3))
    totals = F.when((gross > 0) & (net + vat != 0) & (doubled > 0.01), doubled).otherwise(off)
    paid = F.when((gross > 0) & (payable > 0) & (F.abs(payable - gross) > _cent()), 0.1).otherwise(off)
    lines = F.coalesce(F.col("line_sum"), F.expr(ZERO))
    line_gap = relative(lines, net)
    line_sum = F.when((net > 0) & (lines > 0) & (line_gap > 0.01), F.least(line_gap * 0.5, F.lit(0.2))).otherwise(off)
    bad_lines = F.coalesce(F.col("bad_lines"), F.lit(0)) * F.lit(0.05)
    bad_taxes = F.coalesce(F.col("bad_taxes"), F.lit(0)) * F.lit(0.1)
    known = F.create_map(*[F.lit(x) for kv in fv.COUNTRY_CURRENCY.items() for x in kv])
    home = F.try_element_at(known, F.col("supplier.country_code"))
    foreign = F.when(home.isNotNull() & ~F.col("currency_code").eqNullSafe(home), 0.1).otherwise(off)
    penalty = F.least(totals + paid + line_sum + bad_lines + bad_taxes + foreign, F.lit(0.99))
    return F.greatest(F.lit(1.0) - penalty, F.lit(0.01))


def confidence(complete: Column, consistent: Column, ocr: Column) -> Column:
    base = (consistent + complete) / 2
    return F.when(ocr.isNull(), base).otherwise(F.greatest(base, ocr * 0.5 + base * 0.5))


def validate(headers: DataFrame, as_of: str) -> DataFrame:
    """Judges headers that carry their line and tax summary. Adds is_valid, errors (header rules), n_errors (all
    rules), warnings and the three scores."""
    df = prepared(headers)
    counted = F.col("n_header_errors") + F.coalesce("line_errors", F.lit(0)) + F.coalesce("tax_errors", F.lit(0))
    judged = with_errors(df, header_rules(df, as_of)).withColumns(
        {
            "warnings": warnings("payment_terms" in df.columns),
            "completeness_score": completeness(),
            "consistency_score": consistency(),
        }
    )
    ocr = F.col("ocr_confidence") if "ocr_confidence" in df.columns else F.lit(None).cast("double")
    scored = confidence(F.col("completeness_score"), F.col("consistency_score"), ocr)
    summed = judged.withColumns({"n_errors": counted.cast("long"), "confidence_score": scored})
    return summed.withColumn("is_valid", F.col("n_errors") == 0).drop("_issued", "_due", "n_header_errors")


def validate_nested(df: DataFrame, as_of: str, listed: bool = False, headers: DataFrame | None = None, key: str = "") -> DataFrame:
    """Validation of invoices that carry lines and tax rows as arrays: narrow, no shuffle. With listed, `all_errors` has the
    broken rules of header, lines and tax rows as validate_whole gives them. With headers, the other columns of an invoice stand
    in that table under its key: the arrays are summed up before the join, so they are not shuffled, and not returned."""
    summed = summarise_nested(df)
    if headers is not None:
        if listed:
            raise ValueError("the rows of arrays that are not joined can't be listed")
        summed = summed.drop("invoice_lines", "tax_breakdown").join(headers, key)
    judged = validate(summed, as_of)
    if not listed:
        return judged
    arrays = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in ("invoice_lines", "tax_breakdown")}
    rows = nested_rule_summary(judged.withColumns(arrays))
    return rows.withColumn("all_errors", _all_listed(F.col("row_errors"))).drop("row_errors")


def scorecard(error_rows: DataFrame) -> DataFrame:
    """Broken rules per field and message over the whole table; the names of lines and tax rows are dropped from the field first."""
    field = F.regexp_replace("field", r"^(invoice_lines|tax_breakdown)\..+\.([^.]+)$", "$1.*.$2")
    return error_rows.groupBy(field.alias("field"), "message").agg(F.count("*").alias("n"))

