import copy
import glob
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import validation as v
from tallyspark.plans import catalog, views
from tallyspark.sources import folders

AS_OF = "2024-12-31"
PARTY = {"tax_id": None}
VALID = {
    "invoice_id": "INV-2024-001", "issue_date": "2024-01-15", "currency_code": "EUR",
    "supplier": {"name": "Test Company GmbH", "vat_id": "DE123456789", "country_code": "DE", "address_line": "Test Street 123", "city": "Test City", "postal_code": "12345"},
    "customer": {"name": "Customer Ltd", "vat_id": "EE123456789", "country_code": "EE", "address_line": "Customer Road 456", "city": "Customer City", "postal_code": "54321"},
    "invoice_lines": [{"line_id": "1", "description": "Software License", "quantity": "1.0", "unit_price": "100.00", "line_total": "100.00", "vat_category": "S", "vat_rate": "0.19"}],
    "total_excl_vat": "100.00", "total_vat": "19.00", "total_incl_vat": "119.00", "payable_amount": "119.00",
}


def judged(spark, tmp_path, *records):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in records))
    df = folders.scan_json_invoices(spark, str(path))
    return v.validate_nested(df, AS_OF).collect()


def changed(**values):
    record = copy.deepcopy(VALID)
    for path, value in values.items():
        target = record
        *parents, last = path.split("__")
        for p in parents:
            target = target[p]
        target[last] = value
    return record


def test_valid_invoice(spark, tmp_path):
    (row,) = judged(spark, tmp_path, VALID)
    assert row.is_valid and row.errors == [] and row.n_errors == 0
    assert row.completeness_score == pytest.approx(14.8 / 15.4)
    assert row.consistency_score == 1.0
    assert row.confidence_score == pytest.approx(0.98052, abs=1e-5)


def test_scores_follow_defects(spark, tmp_path):
    wrong, ocr, usd, high = judged(
        spark, tmp_path, changed(total_incl_vat="500"), changed(ocr_confidence=0.95), changed(currency_code="USD"),
        changed(total_incl_vat="200000"),
    )
    assert wrong.consistency_score == pytest.approx(0.6)
    assert ocr.confidence_score == pytest.approx(0.98052, abs=1e-5)
    assert any("currency" in w for w in usd.warnings)
    assert any("high" in w for w in high.warnings)


def test_invalid_invoice(spark, tmp_path):
    bad = {
        "invoice_id": "", "issue_date": "invalid-date", "currency_code": "INVALID",
        "supplier": {"name": "", "vat_id": "INVALID123", "country_code": "XX"},
        "customer": {"name": "Customer Ltd", "vat_id": "INVALID456", "country_code": "YY"},
        "total_excl_vat": "-100", "total_vat": "not_a_number", "total_incl_vat": "50",
    }
    row, empty = judged(spark, tmp_path, bad, {})
    fields = {e.field for e in row.errors}
    assert not row.is_valid and {"invoice_id", "issue_date", "currency_code", "total_excl_vat", "total_vat"} <= fields
    assert not empty.is_valid


def test_malformed_record_is_kept_as_corrupt(spark, tmp_path):
    rows = judged(spark, tmp_path, '{"invoice_id": 1, "supplier": "text", "invoice_lines": 5}', "not json", VALID)
    assert [r._corrupt is None for r in rows] == [False, False, True]
    assert [r.is_valid for r in rows] == [False, False, True]


@pytest.mark.parametrize(
    "change, field",
    [
        ({"payment_terms": {"payment_due_date": "2024-01-01"}}, "payment_terms.payment_due_date"),
        ({"payment_terms": {"payment_due_date": "soon"}}, "payment_terms.payment_due_date"),
        ({"issue_date": "2025-06-01"}, "issue_date"),
        ({"issue_date": "2024/01/15"}, "issue_date"),
        ({"invoice_id": "12"}, "invoice_id"),
        ({"invoice_id": "x" * 51}, "invoice_id"),
        ({"supplier__country_code": None}, "supplier.vat_id"),
        ({"customer__vat_id": "EE12345"}, "customer.vat_id"),
        ({"total_incl_vat": "200"}, "total_incl_vat"),
        ({"total_excl_vat": "50", "total_incl_vat": "69"}, "total_excl_vat"),
    ],
)
def test_broken_field(spark, tmp_path, change, field):
    (row,) = judged(spark, tmp_path, changed(**change))
    assert field in {e.field for e in row.errors}


@pytest.mark.parametrize(
    "number, ok",
    [("INV-2024-001", True), ("12345", True), ("2024/0001", True), ("RE/240001", True), ("", False), ("12", False), (None, False)],
)
def test_invoice_number(spark, number, ok):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(v.invoice_number_ok(F.col("n"))).first()[0] is ok


@pytest.mark.parametrize(
    "country, vat, ok",
    [("DE", "DE123456789", True), ("EE", "ee123456789", True), ("FR", "FRAA123456789", True), ("IT", "IT12345678901", True),
     ("DE", "INVALID123", False), ("EE", "EE12345", False), ("GB", "GB12345678901", False), ("FR", "FR123456789", False),
     ("XX", "anything", True), (None, "DE123456789", False)],
)
def test_vat_id(spark, country, vat, ok):
    df = spark.createDataFrame([(country, vat)], "c string, v string")
    assert df.select(v.vat_id_ok(F.col("v"), F.col("c"))).first()[0] is ok


def test_line_rules(spark):
    lines = spark.createDataFrame(
        [("a", "0", "1", "Item", "2", "50", "100", "0.2"), ("a", "1", "2", "  ", "2", "50", "200", "1.5"), ("a", "2", None, None, None, "50", "-1", "0")],
        "k string, line_ref string, line_id string, description string, quantity string, unit_price string, line_total string, vat_rate string",
    ).withColumns({**{n: F.col(n).cast("decimal(18,4)") for n in ("quantity", "unit_price", "line_total")},
                   "vat_rate": F.col("vat_rate").cast("decimal(9,6)"), "unit_code": F.lit("C62"), "vat_category": F.lit("S")})
    got = {(r.field, r.message) for r in v.broken_rows(lines, ["k"], v.line_rules(F.col), v.line_prefix()).collect()}
    assert {f for f, _ in got if f.startswith("invoice_lines.0")} == set()
    assert {f for f, _ in got if f.startswith("invoice_lines.1")} == {
        "invoice_lines.1.line_total", "invoice_lines.1.description", "invoice_lines.1.vat_rate"}
    third = {(f, m) for f, m in got if f.startswith("invoice_lines.2")}
    assert ("invoice_lines.2.quantity", "field is required") in third
    assert ("invoice_lines.2.line_total", "must be at least 0") in third


def test_nested_and_long_summaries_agree(spark, tmp_path):
    broken = changed()
    broken["invoice_lines"] += [
        {"line_id": "2", "description": "", "quantity": "2", "unit_price": "5", "line_total": "11", "vat_rate": "0.1"},
        {"line_id": None, "description": "x", "quantity": None, "unit_price": "5", "line_total": "5", "vat_rate": "2"},
    ]
    path = tmp_path / "n.json"
    path.write_text(json.dumps(broken))
    df = folders.scan_json_invoices(spark, str(path))
    nested = v.summarise_nested(df).select("n_lines", "line_sum", "bad_lines", "line_errors").first()
    long = v.summarise_lines(v.unnest_lines(df, "invoice_id"), "invoice_id").first()
    assert tuple(nested) == (long.n_lines, long.line_sum, long.bad_lines, long.line_errors)
    assert nested.line_sum == Decimal("116.0000") and nested.bad_lines == 1


def test_scorecard_counts_over_lines(spark):
    rows = spark.createDataFrame([("invoice_lines.0.x", "m"), ("invoice_lines.17.x", "m"), ("y", "m")], "field string, message string")
    assert {(r.field, r.n) for r in v.scorecard(rows).collect()} == {("invoice_lines.*.x", 2), ("y", 1)}


def test_all_errors_of_nested_invoices_are_listed(spark, tmp_path):
    lines = [VALID["invoice_lines"][0] | x for x in ({"quantity": "two"}, {"line_total": "7"}, {"line_total": "8", "unit_code": "LONG-UNIT-CODE"}, {})]
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r) for r in (changed(invoice_lines=lines), changed(invoice_lines=[]), VALID, changed(invoice_id=""))))
    many, none, valid, unnamed = v.validate_nested(folders.scan_json_invoices(spark, str(path)), AS_OF, listed=True).collect()
    for row in (many, none, valid, unnamed):
        assert sum(e.n for e in row.all_errors) == row.n_errors
    assert {(e.field, e.n, e.first) for e in many.all_errors if e.field.startswith("invoice_lines")} == {
        ("invoice_lines.*.quantity", 1, "0"), ("invoice_lines.*.line_total", 3, "0"), ("invoice_lines.*.unit_code", 1, "2"),
    }
    assert valid.all_errors == [] and [(e.field, e.n, e.first) for e in unnamed.all_errors] == [("invoice_id", 1, None)]


def test_the_summary_counts_what_quick_validate_lists(spark):
    sf = "/root/testdata/sf0.001"
    lines = views.invoice_lines(spark, sf)
    whole = v.validate_whole(views.invoice_headers(spark, sf), lines, views.tax_rows(lines), "doc_key", views.AS_OF).collect()
    counts = {r.doc_key: sum(e.n for e in r.all_errors) for r in whole}
    assert counts == {r.doc_key: r.n_errors for r in whole}
    rows = {r["doc_key"]: r["count"] for r in catalog.quick_validate(spark, sf).groupBy("doc_key").count().collect()}
    assert rows == {k: n for k, n in counts.items() if n}


def test_an_invoice_with_very_many_broken_lines_has_a_short_summary(spark):
    lines = spark.range(100_000).selectExpr(
        "1 AS k", "CAST(id AS STRING) AS line_ref", "CAST(id AS STRING) AS line_id", "' ' AS description", "'X' AS vat_category", "'C62' AS unit_code",
        *[f"CAST(1 AS DECIMAL(18,4)) AS {c}" for c in ("quantity", "unit_price", "line_total")], "CAST(0.2 AS DECIMAL(9,6)) AS vat_rate",
    )
    taxes = spark.createDataFrame([], "k int, taxable_amount decimal(18,4), tax_amount decimal(18,4), tax_rate decimal(9,6), tax_category string")
    (row,) = v.rule_summary(lines, taxes, "k").collect()
    assert [(e.field, e.n, e.first) for e in row.row_errors] == [("invoice_lines.*.vat_category", 100_000, "0"), ("invoice_lines.*.description", 100_000, "0")]


def test_numbers_of_lines_and_tax_rows_that_cannot_be_read_keep_their_text(spark, tmp_path):
    line = VALID["invoice_lines"][0]
    taxes = [{"taxable_amount": "100.00", "tax_amount": "n/a", "tax_rate": None, "tax_category": "S"}]
    record = changed(invoice_lines=[line, line | {"quantity": "two"}, line | {"unit_price": None, "vat_rate": "high"}], tax_breakdown=taxes)
    path = tmp_path / "in.json"
    path.write_text(json.dumps(record))
    found = folders.scan_json_invoices(spark, str(path))
    row = found.first()
    assert [x.quantity_raw for x in row.invoice_lines] == ["1.0", "two", "1.0"] and row.invoice_lines[2].vat_rate_raw == "high"
    assert row.tax_breakdown[0].tax_amount_raw == "n/a" and row.tax_breakdown[0].tax_amount is None
    judged = v.validate_nested(found, AS_OF, listed=True).first()
    errors = {(e.field, e.message, e.n, e.first) for e in judged.all_errors}
    assert errors >= {
        ("invoice_lines.*.quantity", "is not a number", 1, "1"), ("invoice_lines.*.vat_rate", "is not a number", 1, "2"),
        ("invoice_lines.*.unit_price", "field is required", 1, "2"), ("tax_breakdown.*.tax_amount", "is not a number", 1, "0"),
        ("tax_breakdown.*.tax_rate", "field is required", 1, "0"),
    }
    assert sum(e.n for e in judged.all_errors) == judged.n_errors


def test_line_tables_tell_unreadable_numbers_from_missing_ones(spark, tmp_path):
    line = VALID["invoice_lines"][0]
    lines = [{**line, "quantity": "two"}, {**line, "unit_price": None}, {**line, "vat_rate": "x%"}, line]
    taxes = [{"taxable_amount": "100", "tax_amount": "some", "tax_rate": "0.19", "tax_category": "S"}]
    path = tmp_path / "unread.json"
    path.write_text("\n".join(json.dumps(r) for r in (changed(invoice_lines=lines, tax_breakdown=taxes), changed(invoice_id="INV-2"))))
    df = v.summarise_nested(folders.scan_json_invoices(spark, str(path))).cache()
    rows = v.all_errors(df, v.unnest_lines(df, "invoice_id"), v.unnest_taxes(df, "invoice_id"), "invoice_id", AS_OF).collect()
    found = {(r["field"], r["message"], r["value"]) for r in rows}
    assert {
        ("invoice_lines.0.quantity", "is not a number", "two"),
        ("invoice_lines.1.unit_price", "field is required", None),
        ("invoice_lines.2.vat_rate", "is not a number", "x%"),
        ("tax_breakdown.0.190000-S.tax_amount", "is not a number", "some"),
    } <= found
    assert not {f for f in found if f[0] == "invoice_lines.0.quantity" and f[1] == "field is required"}
    counted = {r["invoice_id"]: r["n_errors"] for r in v.validate(df, AS_OF).collect()}
    assert all(counted[k] == sum(r["invoice_id"] == k for r in rows) for k in counted)


def test_header_rules_scan_orders_only(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("rule_invoice_number", "rule_dates"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "Exchange" not in plan
    whole = {r["doc_key"]: r for r in views.invoice_headers(spark, sf).collect()}
    for r in views.order_headers(spark, sf).join(views.order_parties(spark, sf), "doc_key").collect():
        assert all(r[c] == whole[r["doc_key"]][c] for c in ("invoice_id", "issue_date", "payment_terms", "supplier", "customer"))


def test_queries_keep_generated_methods_small_enough_to_compile(spark):
    """Java interprets methods of over 8,000 bytes; with Spark's own limit the rules of a header were one such method."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalog.QUERIES["validate_invoices"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_sinks_bound_the_records_of_a_file(spark, tmp_path):
    """One task reads an XML or compressed file, so a large partition is cut into several files, and no record is lost."""
    rows = spark.range(25).selectExpr("id", "concat('x ', id) AS t").coalesce(1)
    folders.sink_xml(rows, str(tmp_path / "xml"), "R", "Rs", records_per_file=10)
    folders.sink_json(rows, str(tmp_path / "json"), compression="gzip", records_per_file=10)
    back = [folders.scan_xml(spark, str(tmp_path / "xml"), rows.schema, "R"), spark.read.schema(rows.schema).json(str(tmp_path / "json"))]
    assert [len(list((tmp_path / k).glob(f"part-*{end}"))) for k, end in (("xml", ".xml"), ("json", ".json.gz"))] == [3, 3]
    assert all(sorted(b.collect()) == sorted(rows.collect()) for b in back)


def test_json_sink_query_compresses(spark):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/sink-json-*"))
    assert catalog.QUERIES["sink_json"](spark, "/root/testdata/sf0.001").count() > 0
    (made,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/sink-json-*")) - before
    assert glob.glob(f"{made}/lines/*.json.gz") and not glob.glob(f"{made}/lines/*.json")


def test_xml_sink_queries_compress(spark):
    """Every tag stands twice in plain XML, which takes many times the disk of the rows."""
    for name in ("sink_xml_lines", "sink_xml_headers"):
        before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/xml-*"))
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        (made,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/xml-*")) - before
        assert glob.glob(f"{made}/*.xml.gz") and not glob.glob(f"{made}/*.xml")


def test_compressed_xml_gives_the_rows_of_plain_xml(spark, tmp_path):
    """Files of one record and of several, missing and empty texts, blanks and marks of XML, letters beyond ASCII."""
    rows = spark.createDataFrame([(i, t) for i in range(3) for t in (None, "", " ", "a <b> & 'c'", "ü€ 1")], "id int, t string").coalesce(1)
    for kind, n in (("none", 100), ("gzip", 100), ("gzip", 1)):
        folder = str(tmp_path / f"{kind}-{n}")
        folders.sink_xml(rows, folder, "R", "Rs", records_per_file=n, compression=kind)
        back = folders.scan_xml(spark, folder, rows.schema, "R").collect()
        assert sorted(map(repr, back)) == sorted(map(repr, rows.collect())), (kind, n)
