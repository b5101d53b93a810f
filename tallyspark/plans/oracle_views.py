"""The input views once more as DuckDB SQL, used as common table expressions of the oracle queries."""

from __future__ import annotations

import re

from tallyspark.functions import fixed_values as fv
from tallyspark.plans import views as w

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def money(text: str, to: str = "DECIMAL(18,4)") -> str:
    kept = rf"regexp_replace({text}, '[^0-9.,\-]', '', 'g')"
    return (
        f"TRY_CAST(CASE WHEN strpos({kept}, '.') > 0 AND strpos({kept}, ',') > 0 THEN"
        f" CASE WHEN strpos(reverse({kept}), ',') < strpos(reverse({kept}), '.')"
        f" THEN replace(replace({kept}, '.', ''), ',', '.') ELSE replace({kept}, ',', '') END"
        f" WHEN regexp_full_match({kept}, '[^,]*,[^,]{{0,2}}') THEN replace({kept}, ',', '.')"
        f" ELSE replace({kept}, ',', '') END AS {to})"
    )


def parse_date(text: str, slash_iso: bool = True) -> str:
    slash = f"WHEN regexp_full_match({text}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN try_strptime({text}, '%Y/%m/%d')"
    return (
        f"CAST(CASE WHEN regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime({text}, '%Y-%m-%d')"
        f" WHEN regexp_full_match({text}, '[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}') THEN try_strptime({text}, '%d.%m.%Y')"
        f" WHEN regexp_full_match({text}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({text}, '%d/%m/%Y')"
        f" WHEN regexp_full_match({text}, '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') THEN try_strptime({text}, '%d-%m-%Y')"
        f" {slash if slash_iso else ''} END AS DATE)"
    )


LINE_SQL = dict(w.LINE_COLUMNS)
LINE_SQL["line_total"] = f"CAST({LINE_SQL['line_total']} AS DECIMAL(18,4))"

LINE_BROKEN = "abs(quantity * unit_price - line_total) > 0.01"
LINE_ERRORS = (
    f"CAST({LINE_BROKEN} AS INT) + CAST(trim(description) = '' AS INT) + CAST(line_id IS NULL AS INT)"
    " + CAST(length(unit_code) > 10 AS INT) + CAST(vat_category NOT IN ('S','Z','E','AE','O') AS INT)"
)
TAX_BROKEN = "abs(taxable_amount * CAST(tax_rate AS DECIMAL(9,6)) - tax_amount) > 0.01"

HEADER_SQL = {k: s for k, s in w.HEADER_COLUMNS.items()}
DAY = "strftime(o_orderdate, '%Y-%m-%d')"
US_NUMBER = "format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE))"
TEXT = w.text_sql(
    DAY, "strftime(o_orderdate, '%-d %B %Y')", "strftime(o_orderdate, '%B %-d, %Y')", US_NUMBER
)
WORDS = r"regexp_extract_all(text, '\S+')"
SENTENCES = r"regexp_extract_all(text, '[^.\n]+')"
TABLE_NUMBER = "format('{:,.2f}', CAST(CAST((length(s) * 37 + i - 1) * 1.05 AS DECIMAL(18,2)) AS DOUBLE))"
TABLE_LOCAL = f"CASE WHEN doc_id % 2 = 0 THEN {TABLE_NUMBER} ELSE translate({TABLE_NUMBER}, ',.', '.,') END"
TABLE_ROW = (
    "concat('<tr><td class=\"d\">', CASE WHEN (i - 1) % 13 = 6 THEN '<b> </b>' ELSE concat('<b> ',"
    " trim(regexp_replace(s, '[<>&]', '', 'g')), ' </b>') END, '</td><td>', (i - 1) % 9 + 1, '</td>',"
    f" CASE WHEN (i - 1) % 11 = 5 THEN '' ELSE concat('<td>€', {TABLE_LOCAL}, '</td><td>', {TABLE_LOCAL}, '</td><td>',"
    " CASE (i - 1) % 3 WHEN 0 THEN '19%' WHEN 1 THEN '7.5 %' ELSE 'none' END, '</td>') END, '</tr>')"
)
CELL_TEXT = (
    "list_filter(list_transform(regexp_extract_all(html, '(?s)<tr[^>]*>(.*?)</tr>', 1), lambda r:"
    " list_transform(regexp_extract_all(r, '(?s)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>', 1), lambda c:"
    " regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'))), lambda r: len(r) > 0)"
)


def _role(words: list[str]) -> str:
    test = " OR ".join(f"contains(regexp_replace(lower(h), '^\\s+|\\s+$', '', 'g'), '{x}')" for x in words)
    return f"list_position(list_transform(data[1], lambda h: {test}), true)"


LINE_TABLE = " OR ".join(f"contains(lower(array_to_string(data[1], ' ')), '{x}')" for x in fv.LINE_TABLE_WORDS)


def _at(role: str) -> str:
    return f"regexp_replace(r[at_{role}], '^\\s+|\\s+$', '', 'g')"


PERCENT = "CAST(" + money("replace(" + _at("vat_rate") + ", '%', '')") + " * 0.01 AS DECIMAL(9,6))"

VIEWS = {
    "v_lines": "SELECT " + ", ".join(f"{s} AS {n}" for n, s in LINE_SQL.items()) + " FROM lineitem",
    "v_taxes": "SELECT doc_key, vat_rate AS tax_rate, vat_category AS tax_category,"
    " CAST(sum(line_total) AS DECIMAL(18,4)) AS taxable_amount,"
    " CAST(sum(round(line_total * vat_rate, 2)) AS DECIMAL(18,4)) AS tax_amount FROM v_lines GROUP BY ALL",
    "v_line_sums": "SELECT doc_key, count(*) AS n_lines, CAST(sum(line_total) AS DECIMAL(18,4)) AS line_sum,"
    f" sum(CAST(quantity > 0 AND unit_price > 0 AND line_total > 0 AND {LINE_BROKEN} AS INT)) AS bad_lines,"
    f" sum({LINE_ERRORS}) AS line_errors, min(l_suppkey) AS supplier_key,"
    " FROM v_lines GROUP BY doc_key",
    "v_tax_sums": "SELECT doc_key, CAST(sum(tax_amount) AS DECIMAL(18,4)) AS vat_sum,"
    f" sum(CAST(taxable_amount > 0 AND tax_rate > 0 AND {TAX_BROKEN} AS INT)) AS bad_taxes,"
    f" sum(CAST({TAX_BROKEN} AS INT) + CAST(tax_category NOT IN ('S','Z','E','AE','O') AS INT)) AS tax_errors"
    " FROM v_taxes GROUP BY doc_key",
    "v_orders": f"SELECT o_orderkey AS doc_key, o_orderkey, o_custkey, {DAY} AS iso_day,"
    " strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS iso_due,"
    " strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS iso_before FROM orders",
    "v_headers": "SELECT doc_key, " + ", ".join(f"{s} AS {n}" for n, s in HEADER_SQL.items()) + ","
    " n_lines, line_sum, bad_lines, line_errors, bad_taxes, tax_errors,"
    " CAST(line_sum + CASE WHEN o_orderkey % 83 = 0 THEN 0.5 * line_sum ELSE 0 END AS DECIMAL(18,4)) AS total_excl_vat,"
    " vat_sum AS total_vat,"
    " CAST(line_sum + vat_sum + CASE WHEN o_orderkey % 7 = 0 THEN 5 WHEN o_orderkey % 89 = 0 THEN line_sum ELSE 0 END AS DECIMAL(18,4)) AS total_incl_vat,"
    " CAST(line_sum + vat_sum - CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS payable_amount"
    " FROM (SELECT o.*, coalesce(n_lines, 0) AS n_lines, coalesce(line_sum, 0)::DECIMAL(18,4) AS line_sum, coalesce(bad_lines, 0) AS bad_lines,"
    " coalesce(line_errors, 0) AS line_errors, coalesce(supplier_key, 0) AS supplier_key, coalesce(vat_sum, 0)::DECIMAL(18,4) AS vat_sum,"
    " coalesce(bad_taxes, 0) AS bad_taxes, coalesce(tax_errors, 0) AS tax_errors FROM v_orders AS o"
    " LEFT JOIN v_line_sums USING (doc_key) LEFT JOIN v_tax_sums USING (doc_key))",
    "v_invoice_texts": f"SELECT concat('I', o_orderkey) AS doc_id, {TEXT} AS text FROM orders",
    "v_texts": "SELECT doc_id, text FROM v_invoice_texts UNION ALL SELECT concat('D', doc_id), text FROM documents",
    "v_words": f"SELECT doc_id, unnest({WORDS}) AS text, unnest(range(len({WORDS}))) AS i FROM documents",
    "v_tokens": f"SELECT doc_id, CAST(i // {w.PAGE_TOKENS} + 1 AS INT) AS page_no, i AS elem_id, text,"
    " CAST((doc_id * 31 + i * 17) % 100 AS DOUBLE) / 100 AS confidence, CAST(100 + 150 * (i % 8) AS DOUBLE) AS cx,"
    f" CAST(110 + 30 * ((i % {w.PAGE_TOKENS}) // 8) - CASE WHEN ((i % {w.PAGE_TOKENS}) // 8) % 3 = 2 THEN 18 ELSE 0 END"
    " + (i * 7) % 5 AS DOUBLE) AS cy FROM v_words",
    "v_ordered": "SELECT *, row_number() OVER p AS reading_rank, cy - lag(cy) OVER p AS gap FROM v_tokens"
    " WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY cy, cx, elem_id)",
    "v_pages": f"SELECT doc_id, unnest(range(1, CAST((len({WORDS}) - 1) // {w.PAGE_TOKENS} AS BIGINT) + 2)) AS page_no FROM documents",
    "v_cells": "SELECT doc_id, CAST(page_no AS INT) AS page_no, 1 AS table_id, cell_id, CAST(40 + 420 * (cell_id % 3) AS DOUBLE) AS x1,"
    " CAST(96 + 60 * (cell_id // 3) + (cell_id * 5) % 9 AS DOUBLE) AS y1, x1 + 400 AS x2, y1 + 55 AS y2"
    " FROM v_pages, (SELECT unnest(range(45)) AS cell_id)",
    "v_html": f"SELECT doc_id, concat('<table>', {w.header_html('(doc_id % 4)')}, array_to_string("
    f"list_transform({SENTENCES}, lambda s, i: {TABLE_ROW}), ''), '</table>') AS html FROM documents",
    "v_matrix": f"SELECT doc_id, {CELL_TEXT} AS data FROM v_html",
    "v_roles": "SELECT doc_id, data, "
    + ", ".join(f"nullif({_role(x)}, 0) AS at_{r}" for r, x in fv.COLUMN_ROLE_WORDS.items())
    + f" FROM v_matrix WHERE len(data) >= 2 AND ({LINE_TABLE})",
    "v_table_rows": "SELECT * EXCLUDE (r0), r0 AS r FROM (SELECT *, unnest(data[2:]) AS r0, unnest(range(len(data) - 1)) AS line_no FROM v_roles)",
    "v_table_lines": "SELECT doc_id, CAST(line_no AS INT) AS line_no, "
    + f"{_at('description')} AS description, {money(_at('quantity'))} AS quantity, {money(_at('unit_price'))} AS unit_price,"
    + f" {money(_at('line_total'))} AS line_total, {PERCENT} AS vat_rate FROM v_table_rows"
    + f" WHERE len(r) >= len(data[1]) AND {_at('description')} <> ''",
    "v_responses": "SELECT o_orderkey AS doc_key, CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'et' ELSE 'fr' END AS lang,"
    f" {w.response_sql(DAY)} AS response, {TEXT} AS text FROM orders",
    "v_log": "SELECT event_id, event_type AS operation, value AS duration, ts, event_type <> 'error' AS success, user_id FROM events",
    "v_samples": f"SELECT event_id, {w.metric_sql()} AS metric, concat('host', user_id % 40) AS host, ts, value FROM events",
    "v_requests": "SELECT event_id, concat('10.0.0.', user_id) AS client, 'POST' AS method, concat('/', event_type) AS path, ts FROM events",
    "v_page_metrics": "SELECT p_partkey AS page_key, (p_retailprice - 900) * 2 AS sharpness, CAST(p_size AS DOUBLE) AS contrast,"
    " CAST(p_partkey % 256 AS DOUBLE) AS brightness FROM part",
    "v_files": f"SELECT doc_id, CASE WHEN doc_id % 50 = 49 THEN '' ELSE concat(source, '_', doc_id, {w.pick(w.FILE_EXTENSIONS, '(doc_id % 8)')}) END AS filename,"
    " n_chars * 5000 AS length, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (doc_id % 2000) AS modificationTime FROM documents",
}


def with_views(sql: str, recursive: bool = False) -> str:
    """Puts the views a query mentions, and those they mention, in front of it."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        for name in re.findall(r"\bv_[a-z_]+\b", queue.pop()):
            if name in VIEWS and name not in needed:
                needed.add(name)
                queue.append(VIEWS[name])
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}, {sql.removeprefix(head)}" if sql.startswith("WITH ") else f"{head}{ctes} {sql}"
