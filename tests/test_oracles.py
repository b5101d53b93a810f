"""Every registered query against its SQL on the smallest data set."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallyspark.sources import folders
from tallyspark.streaming import activity as live

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def test_every_query_has_an_oracle():
    numbered = {name for name in QUERIES if re.match(r"op\d+_|pipeline$", name)}  # tested with their subpackage
    assert set(QUERIES) - set(ORACLES) <= numbered
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert ours and ours == theirs


def test_all_matches_and_all_errors_are_listed(spark):
    matches = {tuple(r) for r in QUERIES["distinct_matches_with_addresses"](spark, SF).collect()}
    lines = [(r["doc_id"], a) for r in QUERIES["extract_addresses"](spark, SF).collect() for a in r["result"].split("|") if a]
    assert lines and set(lines) <= matches
    listed = QUERIES["concat_all_errors"](spark, SF).collect()
    fields = sum(len(r["fields"].split("|")) for r in listed if r["fields"])
    assert fields == QUERIES["quick_validate"](spark, SF).count()
    assert any("invoice_lines." in r["fields"] or "tax_breakdown." in r["fields"] for r in listed)


def test_folders_are_scanned_and_streamed(spark):
    wanted = {p.name: p.stat().st_size for p in Path(SF).glob("*.parquet")}
    scanned = folders.scan_files(spark, SF, "*.parquet").select("filename", "length")
    arriving = folders.stream_files(spark, SF, "*.parquet").select("filename", "length")
    for found in (scanned, live.appended_rows(spark, arriving, "stream-listing")):
        assert {r.filename: r.length for r in found.collect()} == wanted


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
