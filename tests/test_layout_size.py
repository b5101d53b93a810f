"""Page operators at size: what they shuffle and write, and that the shorter ways give the same rows."""

import random

import pytest

from tallyspark.operators import layout
from tallyspark.plans.catalog import QUERIES


def _documents(spark, folder):
    rows = [(i, " ".join(f"w{i}x{n}" for n in range(7 * i))) for i in range(90)] + [(90, None), (91, ""), (3, "again here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def test_token_cell_join_shuffles_texts_and_not_their_tokens(spark, tmp_path):
    _documents(spark, tmp_path)
    found = QUERIES["token_cell_join"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange" in line]
    assert dealt and all("hashpartitioning(doc_id#" in line and "page_no" not in line for line in dealt), plan
    texts = {(r.doc_id, r.page_no, r.cell_id): r.cell_text for r in found.collect()}
    assert texts[(50, 1, 0)].startswith("w50x0 w50x1") and texts[(50, 2, 0)].startswith("w50x240 ")


def _grid_by_hand(cells):
    """Rows and columns of one table: a cell over 10 below the first of its row opens the next."""
    row, first, rows = 0, None, {}
    for cell in sorted((c for c in cells if c[2] is not None), key=lambda c: c[2]):
        if first is None or cell[2] - first > 10:
            row, first = row + 1, cell[2]
        rows.setdefault(row, []).append(cell)
    return {c[3]: (no, at) for no, cs in rows.items() for at, c in enumerate(sorted(cs, key=lambda c: (c[1], c[2], c[3])), 1)}


@pytest.mark.parametrize("high", [False, True])
def test_cell_grid_follows_chains_only_in_tables_with_high_islands(spark, monkeypatch, high):
    dice = random.Random(5)
    flat = [(t, float(x), 40.0 * y + dice.choice([0, 0.5, 4, 10]), 100 * y + x) for t in ("a", "b", None) for y in range(9) for x in range(4)]
    steps = [("c", float(n % 3), 4.0 * n, n) for n in range(50)] if high else []
    cells = flat + steps + [("a", 1.0, None, 999)]
    if not high:
        monkeypatch.setattr(layout, "row_starts", lambda *_: pytest.fail("no island is higher than a row"))
    found = layout.cell_grid(spark.createDataFrame(cells, "t string, x1 double, y1 double, cell_id int").repartition(4), ["t"])
    assert found.columns == ["t", "x1", "y1", "cell_id", "row_no", "col_no"]
    got = {}
    for r in found.collect():
        got.setdefault(r.t, {})[r.cell_id] = (r.row_no, r.col_no)
    assert got == {t: _grid_by_hand([c for c in cells if c[0] == t]) for t in {c[0] for c in cells}}
