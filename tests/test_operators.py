import json
import random
import re
import time
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import activity, files, layout, merging, quotas, responses, tables, validation
from tallyspark.plans import views
from tallyspark.sources import folders
from tallyspark.streaming import activity as live
from tallyspark.streaming import invoices

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# --- layout --------------------------------------------------------------------------------------------------------
def token_table(spark, rows):
    return spark.createDataFrame(rows, "doc string, elem_id long, text string, cx double, cy double, confidence double")


def test_reading_order_and_text(spark):
    rows = [("a", 0, "Bottom", 50.0, 300.0, 0.9), ("a", 1, "Top", 50.0, 10.0, 0.9), ("a", 2, "Right", 200.0, 100.0, 0.9), ("a", 3, "Left", 10.0, 100.0, 0.9)]
    got = layout.reading_order(token_table(spark, rows), ["doc"]).orderBy("reading_rank").collect()
    assert [r.text for r in got] == ["Top", "Left", "Right", "Bottom"]
    rows = [("a", 0, "INVOICE", 10.0, 10.0, 0.9), ("a", 1, "Date:", 10.0, 40.0, 0.9), ("a", 2, "2024-01-15", 90.0, 40.0, 0.9)]
    assert layout.page_text(token_table(spark, rows), ["doc"]).first().full_text == "INVOICE\nDate: 2024-01-15"


def test_layout_against_brute_force(spark):
    """One page holds most tokens; levels are irregular. Python loops over sorted tokens give the expected result."""
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"p{i % 5}", i, f"w{i}", float(rnd.randint(0, 40)), float(rnd.randint(0, 400)) / 2, 0.5) for i in range(600)]
    df = token_table(spark, rows)
    pages = defaultdict(list)
    for r in rows:
        pages[r[0]].append(r)
    ranks, text, segments = {}, {}, defaultdict(list)
    for page, tokens in pages.items():
        tokens.sort(key=lambda r: (r[4], r[3], r[1]))
        out, line, last = "", 1, None
        for n, r in enumerate(tokens, 1):
            ranks[r[1]] = n
            if last is not None:
                out += "\n" if r[4] - last > 10 else " "
                line += r[4] - last > 15
            out += r[2]
            segments[(page, line)].append(r[2])
            last = r[4]
        text[page] = out
    assert {r.elem_id: r.reading_rank for r in layout.reading_order(df, ["doc"]).collect()} == ranks
    assert {r.doc: r.full_text for r in layout.page_text(df, ["doc"]).collect()} == text
    got = {(r.doc, r.line_no): r.line_text for r in layout.line_segments(df, ["doc"]).collect()}
    assert got == {k: " ".join(x) for k, x in segments.items()}


def test_page_texts_with_nulls_in_one_shuffle(spark):
    """Texts, places and pages may be null, levels may be NaN or hold no text; a level without text keeps its separator."""
    nan = float("nan")
    rows = [
        ("a", 0, "x", 1.0, 5.0, 0.9), ("a", 1, None, 0.0, 5.0, 0.9), ("a", 2, "y", 2.0, 5.0, 0.9), ("a", 3, None, 0.0, 9.0, 0.9),
        ("a", 4, "z", 0.0, 30.0, 0.9), ("a", 5, "n", 0.0, nan, 0.9), ("a", 6, "m", 1.0, nan, 0.9), (None, 7, "k", 0.0, None, 0.9),
    ]
    df = token_table(spark, rows)
    made = {name: getattr(layout, name)(df, ["doc"]) for name in ("page_text", "line_segments", "reading_order")}
    for found in made.values():
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1
    assert {r.doc: r.full_text for r in made["page_text"].collect()} == {"a": "x y \nz\nn m", None: "k"}
    lines = {(r.doc, r.line_no): (r.n_tokens, r.line_text) for r in made["line_segments"].collect()}
    assert lines == {("a", 1): (4, "x y "), ("a", 2): (1, "z"), ("a", 3): (2, "n m"), (None, 1): (1, "k")}
    assert {r.elem_id: r.reading_rank for r in made["reading_order"].collect()} == {1: 1, 0: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 7}


def test_token_filters(spark):
    rows = [("a", i, t, 0.0, 0.0, c) for i, (t, c) in enumerate([(" INVOICE ", 0.95), ("€123.45", 0.6), ("x y z w", 0.95), ("low", 0.2), ("edge", 0.3)])]
    df = token_table(spark, rows)
    assert [r.text for r in layout.confident_tokens(df).orderBy("elem_id").collect()] == ["INVOICE", "€123.45", "x y z w"]
    assert [r.elem_id for r in df.where(layout.is_header(F.col("text"), F.col("confidence"))).collect()] == [0]


def test_cells(spark):
    cells = [("t", i, float(x), float(y), float(x + 100), float(y + 40)) for i, (y, x) in enumerate([(y, x) for y in (100, 150) for x in (350, 50, 200)])]
    df = spark.createDataFrame(cells, "t string, cell_id int, x1 double, y1 double, x2 double, y2 double")
    grid = {(r.row_no, r.col_no): r.x1 for r in layout.cell_grid(df, ["t"]).collect()}
    assert grid == {(r, c): x for r in (1, 2) for c, x in enumerate((50.0, 200.0, 350.0), 1)}
    anchored = spark.createDataFrame([("t", i, 0.0, y) for i, y in enumerate((100.0, 108.0, 116.0))], "t string, cell_id int, x1 double, y1 double")
    assert {r.y1: r.row_no for r in layout.cell_grid(anchored, ["t"]).collect()} == {100.0: 1, 108.0: 1, 116.0: 2}
    tokens = token_table(spark, [("d", 0, "Unit", 60.0, 110.0, 1.0), ("d", 1, "price", 150.0, 140.0, 1.0), ("d", 2, "far", 999.0, 110.0, 1.0)])
    boxes = df.withColumn("doc", F.lit("d"))
    texts = {r.cell_id: r.cell_text for r in layout.token_cell_join(boxes, tokens, ["doc"], ["doc", "cell_id"], tile=7).collect()}
    assert texts == {0: "", 1: "Unit price", 2: "", 3: "", 4: "", 5: ""}


# --- tables --------------------------------------------------------------------------------------------------------
HTML = (
    "<table><tr><td>Description</td><td>Qty</td><td>Price</td><td>Total</td></tr><tr></tr>"
    "<tr><td> Software <b>License</b></td><td>1</td><td>100.00</td><td>100.00</td></tr>"
    "<tr><td>Support Services</td><td>1</td><td>€1.050,00</td>\n<td>50.00</td></tr><tr><td>short</td></tr>"
    "<tr><td> </td><td>1</td><td>1</td><td>1</td></tr></table>"
)


def test_html_line_items(spark):
    df = spark.createDataFrame([("a", HTML), ("b", "<p>none</p>"), ("c", "<tr><td>Random</td></tr><tr><td>x</td></tr>")], "doc string, html string")
    matrices = df.select("doc", tables.html_matrix(F.col("html")).alias("data"))
    got = tables.table_line_items(matrices, ["doc"]).orderBy("line_no").collect()
    assert [(r.doc, r.description, r.quantity, r.unit_price, r.line_total) for r in got] == [
        ("a", "Software License", Decimal(1), Decimal(100), Decimal(100)),
        ("a", "Support Services", Decimal(1), Decimal(1050), Decimal(50)),
    ]
    assert [r[0] for r in matrices.orderBy("doc").select(tables.is_line_item_table(F.col("data"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "header", [["Description", "Qty", "Unit Price", "Total Amount"], ["Beschreibung", "Menge", "Preis", "Gesamt"], ["Kirjeldus", "Kogus", "Hind", "Kokku"]]
)
def test_column_roles(spark, header):
    roles = tables.column_roles(F.col("data"))
    row = spark.createDataFrame([([header],)], "data array<array<string>>").select(*[c.alias(n) for n, c in roles.items()]).first()
    assert (row.description, row.quantity, row.unit_price, row.line_total, row.vat_rate) == (0, 1, 2, 3, None)


# --- responses and merging -----------------------------------------------------------------------------------------
def test_responses(spark):
    good = '{"invoice_id": "INV-2024-001", "issue_date": "15.01.2024", "supplier": {"name": "X"}, "total_incl_vat": "€123.45", "invoice_lines": [{"description": "S", "quantity": "2", "unit_price": "€50.00", "line_total": "100,00", "vat_rate": "19%"}]}'
    text = "Invoice #A-77 date 1.2.2024 Subtotal: 10.00 Total: 12,50"
    rows = [(1, good, text), (2, f"Here: {good} done", text), (3, f"```json\n{good}\n```", text), (4, "not json", text), (5, '{"invoice_id": ', text)]
    got = {r.id: r for r in responses.structured(spark.createDataFrame(rows, "id int, r string, t string"), "r", "t").collect()}
    for i in (1, 2, 3):
        assert (got[i].invoice_id, got[i].issue_date, got[i].total_incl_vat, got[i].confidence_score) == ("INV-2024-001", "2024-01-15", Decimal("123.45"), 1.0)
        line = got[i].invoice_lines[0]
        assert (line.quantity, line.unit_price, line.line_total, line.vat_rate) == (2, 50, 100, Decimal("0.19"))
    for i in (4, 5):
        assert (got[i].invoice_id, got[i].issue_date, got[i].total_incl_vat) == ("A-77", "1.2.2024", Decimal("12.50"))
        assert (got[i].extraction_method, got[i].confidence_score) == ("fallback", 0.3)


def test_outcomes_of_responses(spark):
    good = {"invoice_id": "A", "issue_date": "2024-01-01", "supplier": {"name": "S"}, "total_incl_vat": 1.5}
    cases = {
        json.dumps(good): ("model", []),
        "So: " + json.dumps(good | {"invoice_lines": [], "total_incl_vat": "1,50"}) + " end": ("model", []),
        json.dumps(good | {"supplier": "S", "total_incl_vat": None}): ("raw", ["supplier: has the wrong type", "total_incl_vat: field is required"]),
        json.dumps(good | {"invoice_id": 7, "invoice_lines": {}}): ("raw", ["invoice_id: has the wrong type", "invoice_lines: has the wrong type"]),
        "{}": ("raw", [f"{n}: field is required" for n in ("invoice_id", "issue_date", "supplier", "total_incl_vat")]),
        "none": ("fallback", []),
        '{"invoice_id": ': ("fallback", []),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "response string")
    got = {r.response: r for r in responses.judged_responses(df, "response").drop("record").collect()}
    assert {k: (got[k].outcome, got[k].reasons) for k in cases} == cases and got[None].outcome == "fallback"
    assert all((r.raw is not None) == (r.outcome == "raw") for r in got.values())
    assert json.loads(got['{}'].raw) == {}


def test_quality(spark):
    flags = {n: F.lit(True) for n in ("invoice_id", "issue_date", "supplier", "customer", "invoice_lines", "total_incl_vat")}
    row = spark.range(1).select(*[c.alias(n) for n, c in responses.quality(F.lit(0.9), flags).items()]).first()
    assert row.overall_quality == pytest.approx(0.97)


def test_prompts(spark):
    t = responses.render(responses.prompt_template("correction", F.lit("de")), errors=responses.bullet_list(F.array(F.lit("a"), F.lit("b"))), extracted_data=F.lit("{}"))
    text = spark.range(1).select(t.alias("t")).first().t
    assert "- a\n- b" in text and text.endswith("{}") and "{errors}" not in text


@pytest.mark.parametrize(
    "given, expected",
    [(("100", "19", "119", "100", 2), ("100", "19", "119", False)), (("0", None, None, "50", 1), ("50", "10", "60", True)),
     (("90", "19", "109", "100", 1), ("100", "19", "119", True)), (("90", "19", "109", None, 0), ("90", "19", "109", False))],
)
def test_repaired_totals(spark, given, expected):
    df = spark.createDataFrame([given], "a string, b string, c string, s string, n int")
    money = [F.col(x).cast("decimal(18,4)") for x in "abcs"]
    row = df.select(*[c.alias(n) for n, c in merging.repaired_totals(*money, F.col("n")).items()]).first()
    assert tuple(row) == (*[Decimal(x) for x in expected[:3]], expected[3])


def test_a_long_invoice_has_one_header_and_all_its_lines(spark):
    rows = [("a", i, f"r{i}", "x", i, 1, i) for i in range(12_000)] + [("b", 1, "r1", "y", 1, 2, 2)]
    lines = spark.createDataFrame(rows, "k string, no int, line_ref string, description string, quantity int, unit_price int, line_total int")
    got = folders.peppol_lines(lines, "k", "no")
    assert got.count() == 12_001 and got.where("k = 'a'").agg({"line_no": "max"}).first()[0] == 11_999


def test_company_names_of_any_length(spark):
    long = "Universal " * 12 + "Trading GmbH"
    text = f"1. {long}, Alpha Beta A/S; no name GmbH2 end. Gamma & Co AG\nlast words without any form"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.companies(F.col("t"))).first()[0] == [long, "Alpha Beta A/S", "Gamma & Co AG"]


def test_cells_without_a_box_stay(spark):
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0), (1, 2, None, None, None, None)], "d int, c int, x1 double, y1 double, x2 double, y2 double")
    tokens = spark.createDataFrame([(1, 1, "in", 5.0, 5.0)], "d int, elem_id int, text string, cx double, cy double")
    got = layout.token_cell_join(cells, tokens, ["d"], ["d", "c"]).collect()
    assert sorted((r.c, r.cell_text) for r in got) == [(1, "in"), (2, "")]


def test_streams_read_files_and_folders_of_parts(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    rows.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    rows.write.parquet(str(tmp_path / "events2.parquet"))
    got = live.appended_rows(spark, live.stream_table(spark, str(tmp_path), "events"), "test-stream")
    assert got.count() == 1000
    assert live.appended_rows(spark, live.stream_table(spark, "/root/testdata/sf0.001", "events").select("event_id"), "s").count() > 0


def test_unreadable_amounts_are_errors(spark):
    raw = '{"invoice_id": "I", "issue_date": "2020-01-01", "total_excl_vat": "abc", "total_vat": "1", "total_incl_vat": "2", "payable_amount": "not_a_number"}'
    parsed = spark.createDataFrame([(raw,)], "response string").withColumn("_r", responses.parsed_record(F.col("response")))
    typed = responses.typed_invoices(parsed, "_r")
    headers = validation.prepared(typed)
    found = validation.broken_rows(headers, [], validation.header_schema_rules(headers)).collect()
    assert {r.field for r in found if r.message == "is not a number"} == {"total_excl_vat", "payable_amount"}


def test_tax_rows_need_a_category(spark):
    taxes = spark.createDataFrame([("1", "0.2", "0.2", None)], "a string, b string, c string, tax_category string")
    taxes = taxes.selectExpr("1 AS k", *[f"CAST({x} AS DECIMAL(18,4)) AS {n}" for x, n in (("a", "taxable_amount"), ("b", "tax_amount"), ("c", "tax_rate"))], "tax_category")
    found = validation.broken_rows(taxes, ["k"], validation.tax_rules(F.col), validation.tax_prefix()).collect()
    assert [(r.field, r.message) for r in found] == [("tax_breakdown.0.2000.tax_category", "field is required")]


def test_xml_files_keep_every_text(spark, tmp_path):
    rows = [(1, "a & b <c> \"d\" 'e'", None), (2, "", ""), (3, " ", " x "), (4, "\n\té ]]> &amp;", "null"), (5, None, "<!-- y -->")]
    df = spark.createDataFrame(rows, "k long, a string, b string").repartition(3)
    folders.sink_xml(df, str(tmp_path / "x"), "Row", "Rows")
    got = folders.scan_xml(spark, str(tmp_path / "x"), df.schema, "Row")
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_split_counts_what_it_writes(spark, tmp_path):
    judged = spark.range(100).selectExpr("id", "id % 3 = 0 AS is_valid", "IF(id % 3 = 0, 0L, id) AS n_errors").repartition(4)
    counts = folders.split_to_sinks(judged, str(tmp_path / "out"))
    for target in ("valid", "quarantine"):
        back = spark.read.parquet(str(tmp_path / "out" / f"target={target}"))
        assert (back.count(), back.agg({"n_errors": "sum"}).first()[0]) == (counts[target], counts[f"{target}_errors"])
    assert counts["valid"] == 34 and folders.split_to_sinks(judged.where("false"), str(tmp_path / "none"))["valid"] == 0


def test_merge_sources(spark):
    t = spark.createDataFrame([("a", "t1"), ("a", "t2")], "k string, d string")
    m = spark.createDataFrame([("a", "m"), ("b", "m")], "k string, d string")
    got = {(r.k, r.d, r.source) for r in merging.merge_line_sources(t, m, "k").collect()}
    assert got == {("a", "t1", "table"), ("a", "t2", "table"), ("b", "m", "model")}


# --- activity ------------------------------------------------------------------------------------------------------
def test_index_percentiles(spark):
    rnd = random.Random(3)
    data = {"a": [float(i) for i in range(1, 11)], "hot": [rnd.choice([0.5, rnd.random() * 90]) for _ in range(997)], "one": [7.0]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "operation string, duration double")
    got = {r.operation: r for r in activity.index_percentiles(df, "operation", "duration", activity.QUANTILES).collect()}
    for k, xs in data.items():
        for name, q in activity.QUANTILES.items():
            assert got[k][name] == sorted(xs)[int(len(xs) * q)], (k, name)


def test_processing_stats(spark):
    df = spark.createDataFrame([(2.5, True), (1.0, False)], "duration double, success boolean")
    assert tuple(activity.processing_stats(df).first()) == (2, 1, 1, 3.5, 1.75)


def brute_quota(times, calls, period, keep_edge):
    log, out = [], []
    for t in times:
        log = [x for x in log if t - x < period or (keep_edge and t - x == period)]
        ok = len(log) < calls
        if ok:
            log.append(t)
        out.append((ok, calls - len(log) if ok else 0, 0 if ok else int(period - (t - log[0]))))
    return out


def test_rate_limit_hand_case(spark):
    df = spark.createDataFrame([(i, "c", at(t)) for i, t in enumerate((0, 10, 20, 61))], "event_id long, client string, ts timestamp")
    got = quotas.rate_limit(df, ["client"], 2, 60).orderBy("event_id").collect()
    assert [r.admitted for r in got] == [True, True, False, True]


@pytest.mark.parametrize("keep_edge", [False, True])
def test_rate_limit_against_brute_force(spark, keep_edge):
    rnd = random.Random(11)
    times = {"hot": sorted(rnd.randint(0, 3000) for _ in range(2000)), "cold": sorted(rnd.randint(0, 9000) for _ in range(40))}
    rows, expected = [], {}
    for client, ts in times.items():
        for t, result in zip(ts, brute_quota(ts, 5, 60, keep_edge)):
            expected[len(rows)] = result
            rows.append((len(rows), client, at(t)))
    df = spark.createDataFrame(rows, "event_id long, client string, ts timestamp").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # folds must carry state across batches
    try:
        got = quotas.rate_limit(df, ["client"], 5, 60, keep_edge).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.event_id: (r.admitted, r.remaining, r.retry_after) for r in got} == expected


BREACHES = [1000, 1200, 1300, 1301, 1601, 1602]


def test_cooldown(spark):
    df = spark.createDataFrame([(i, "m", at(t)) for i, t in enumerate(BREACHES)], "event_id long, metric string, ts timestamp")
    emitted = quotas.alert_cooldown(df, ["metric"]).where("emit").orderBy("event_id").collect()
    assert [r.event_id for r in emitted] == [0, 3, 5]


def test_cooldown_stream_equals_batch(spark, tmp_path):
    """Three files arrive out of order; a late sentinel moves the watermark past all breaches, a later row is dropped."""
    schema = "event_id long, metric string, ts timestamp"
    rows = [(i, "m", at(t)) for i, t in enumerate(BREACHES)] + [(99, "z", at(9000))]
    for n, part in enumerate([rows[1::2], rows[0::2]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = live.appended_rows(spark, live.emitted_alerts(stream, "metric", 300, "10 minutes"), "cooldown").collect()
    assert sorted(r.event_id for r in got if r.metric == "m") == [0, 3, 5]


def test_cooldown_stream_decides_all_at_its_end(spark, tmp_path):
    schema = "event_id long, metric string, ts timestamp"
    rows = [(i, "m", at(t)) for i, t in enumerate(BREACHES)] + [(50, None, at(1500)), (51, None, at(1600))]
    for part in (rows[1::2], rows[0::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = live.all_emitted_alerts(spark, stream, "metric", 300, "10 minutes").collect()
    assert sorted((r.metric or "", r.event_id) for r in got) == [("", 50), ("m", 0), ("m", 3), ("m", 5)]


def test_invoices_are_assembled_from_a_stream(spark, tmp_path):
    """Four files: lines before and after their header, an invoice without lines, one that stays open, and a late line."""
    heads, lines = "k long, ts timestamp, n_lines long", "k long, ts timestamp, d string"
    steps = [
        ([(1, at(0), 2), (2, at(0), 0), (3, at(0), 3)], [(1, at(1), "a"), (3, at(1), "x")]),
        ([], [(1, at(2), "b"), (4, at(30), "early"), (4, at(31), "er")]),
        ([(9, at(20_000), 0)], [(1, at(40), "late")]),
        ([(4, at(15_000), 2), (8, at(90_000), 0)], []),
    ]
    paths = [str(tmp_path / p) for p in ("heads", "lines")]
    found, folder = [], str(tmp_path / "work")
    for step in steps:
        for rows, schema, path in zip(step, (heads, lines), paths, strict=True):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(schema).parquet(path) for schema, path in zip((heads, lines), paths)]
        out = invoices.assembled(*streams, "k", "2 hours", 3600)
        live.run_to_end(out, "append", folder, live.batch_writer(folder))
        found.append({(r.key, r.outcome, r.expected, "".join(r.lines)) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()})
    line = '{{"d":"{}"}}'.format
    assert found[0] == {("2", "whole", 0, "")}
    assert found[1] == found[0] | {("1", "whole", 2, line("a") + line("b"))}
    partial = {("3", "partial", 3, line("x")), ("4", "partial", None, line("early") + line("er"))}
    assert found[2] == found[1] | partial | {("9", "whole", 0, ""), ("1", "late", 2, line("late"))}
    assert found[3] == found[2] | {("8", "whole", 0, "")}


def test_assembly_calls_python_for_buckets_of_invoices(spark, tmp_path):
    """Many invoices share a bucket, null keys too, and each keeps its own deadline there. Calls are counted in state rows."""
    heads, lines = "k long, ts timestamp, n_lines long", "k long, ts timestamp, d string"
    steps = [
        ([(i, at(0), 2) for i in range(200)] + [(None, at(0), 1)], [(i, at(i), f"a{i}") for i in range(200)] + [(None, at(1), "n")]),
        ([], [(i, at(200), f"b{i}") for i in range(0, 200, 2)]),
        ([(999, at(20_000), 0)], []),
        ([(998, at(20_000), 0)], []),
    ]
    paths, folder = [str(tmp_path / p) for p in ("heads", "lines")], str(tmp_path / "work")
    for step in steps:
        for rows, schema, path in zip(step, (heads, lines), paths, strict=True):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(schema).parquet(path) for schema, path in zip((heads, lines), paths)]
        out = invoices.assembled(*streams, "k", "2 hours", 3600, buckets=3)
        live.run_to_end(out, "append", folder, live.batch_writer(folder))
    got = [(r.key, r.outcome, len(r.lines)) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()]
    whole = {(str(i), "whole", 2) for i in range(0, 200, 2)} | {("998", "whole", 0), ("999", "whole", 0), (None, "whole", 1)}
    assert len(got) == len(set(got)) and set(got) == whole | {(str(i), "partial", 1) for i in range(1, 200, 2)}
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() <= 3


def test_assembly_shuffles_lines_once_and_without_texts(spark, tmp_path):
    """The texts of lines are longer than the lines; they are made where Python reads them, behind the one shuffle."""
    heads, lines = "k long, ts timestamp, n_lines long", "k long, ts timestamp, d string, q double"
    for rows, schema, name in (([(1, at(0), 2)], heads, "heads"), ([(1, at(0), "b", 1.0), (1, at(5), None, 21168.23)], lines, "lines")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for schema, name in ((heads, "heads"), (lines, "lines"))]
    folder = str(tmp_path / "work")
    out = invoices.assembled(*streams, "k", "2 hours", 3600)
    query = out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(live.batch_writer(folder)).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("Exchange hashpartitioning(bucket") == 1
    texts = [m.start() for m in re.finditer("to_?json", plan, re.IGNORECASE)]
    assert texts and max(texts) < plan.index("Exchange hashpartitioning(bucket")
    (row,) = spark.read.schema(out.schema).parquet(f"{folder}/out").collect()
    assert (row.outcome, row.lines) == ("whole", ['{"d":"b","q":1.0}', '{"q":21168.23}'])


def test_lineitems_in_arrays_give_the_lines_of_the_table(spark):
    lineitem = views.table(spark, "/root/testdata/sf0.001", "lineitem")
    rows = lineitem.unionByName(lineitem.limit(5).selectExpr("l_orderkey", *[f"CAST(NULL AS {t}) AS {c}" for c, t in lineitem.dtypes[1:]]))
    text = F.to_json(F.struct(*views.line_inputs(lineitem))).alias("t")
    packed = rows.select(F.col("l_orderkey").alias("doc_key"), F.array(text).alias("texts"))
    parsed = packed.select("doc_key", invoices.parsed_lines("texts", lineitem.select(*views.line_inputs(lineitem)).schema.simpleString()).alias("items"))
    got = parsed.select("doc_key", F.explode(views.lines_in("items", "doc_key")).alias("x"))
    wanted = views.lines_of(rows).select("doc_key", F.struct("line_ref", *views.LINE_FIELDS).cast(views.LINE_STRUCT).alias("x"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_nested_invoices_join_their_headers_without_arrays(spark):
    sf = "/root/testdata/sf0.001"
    whole = views.nested_invoices(spark, sf)
    arrays = ["invoice_lines", "tax_breakdown"]
    judged = validation.validate_nested(whole.select("doc_key", *arrays), views.AS_OF, headers=whole.drop(*arrays), key="doc_key")
    wanted = validation.validate_nested(whole, views.AS_OF)
    columns = [c for c in wanted.columns if c not in arrays]
    assert sorted(map(repr, judged.select(*columns).collect())) == sorted(map(repr, wanted.select(*columns).collect()))
    assert not set(arrays) & set(judged.columns)
    with pytest.raises(ValueError):
        validation.validate_nested(whole, views.AS_OF, listed=True, headers=whole, key="doc_key")


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = spark.conf.get(folders.SHUFFLES_GO)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in name}

    known = shuffled()
    table = folders.written(spark.range(100).repartition(3, "id"), "dropped", drop_shuffles=True)
    assert sorted(r.id for r in table.collect()) == list(range(100)) and spark.conf.get(folders.SHUFFLES_GO) == before
    until = time.time() + 20
    while shuffled() - known and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - known


def test_tax_rows_of_nested_lines(spark):
    rows = [("1.005", "0.2", "S"), ("2", "0.2", "S"), ("3", "0.1", "S"), ("4", None, "Z"), (None, "0.1", "S")]
    lines = [f"named_struct('line_total', CAST({a or 'NULL'} AS DECIMAL(18,4)), 'vat_rate', CAST({r or 'NULL'} AS DECIMAL(9,6)), 'vat_category', '{c}')" for a, r, c in rows]
    got = spark.range(1).selectExpr(f"array({', '.join(lines)}) AS l").select(invoices.tax_breakdown("l").alias("t")).first().t
    assert [(float(t.taxable_amount), float(t.tax_amount), t.tax_rate and float(t.tax_rate), t.tax_category) for t in got] == [
        (3.005, 0.6, 0.2, "S"), (3.0, 0.3, 0.1, "S"), (4.0, 0.0, None, "Z"),
    ]


def test_window_stream_drops_late_rows(spark, tmp_path):
    schema = "operation string, duration double, success boolean, ts timestamp"
    first = [("a", 1.0, True, at(0)), ("a", 3.0, False, at(60)), ("a", 5.0, True, at(4 * 3600))]
    late = [("a", 100.0, True, at(30))]
    path = str(tmp_path / "in")
    folder = str(tmp_path / "work")
    for rows in (first, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = live.performance_windows(spark.readStream.schema(schema).parquet(path), "1 hour")
        live.run_to_end(stream, "update", folder, live.batch_writer(folder))
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out").where(F.col("window_start") == F.lit(at(0)))
    assert [(r.total_operations, r.average_duration, r.success_rate) for r in out.collect()] == [(2, 2.0, 0.5)]


def test_health(spark):
    rows = [("h1", "cpu", at(0), 1, 99.0), ("h1", "cpu", at(9), 2, 10.0), ("h2", "cpu", at(0), 3, 90.0), ("h3", "gpu", at(0), 4, None), ("h3", "cpu", at(0), 5, 95.0)]
    df = spark.createDataFrame(rows, "host string, metric string, ts timestamp, event_id long, value double")
    assert {r.host: r.status for r in activity.health_rollup(df).collect()} == {"h1": "healthy", "h2": "degraded", "h3": "unhealthy"}


# --- files ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "name, size, reason",
    [("a.pdf", 1024, None), ("A.PNG", 1, None), ("a.txt", 1, "Unsupported file type"), ("", 1, "Filename is required"),
     ("b.pdf", 50 * 2**20 + 1, "File too large"), ("b.pdf", 50 * 2**20, None), (None, 1, "Filename is required"), (".pdf", 1, "Unsupported file type")],
)
def test_upload_rules(spark, name, size, reason):
    df = spark.createDataFrame([(name, size)], "n string, s long")
    assert df.select(files.reject_reason(F.col("n"), F.col("s"))).first()[0] == reason
