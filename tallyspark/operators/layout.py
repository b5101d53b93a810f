"""Positioned tokens to reading order, page text, text lines and table cells.

Order inside a page depends on the tokens' y centres first. As nearly every token has a y of its own, tokens are not gathered
by y: they are shuffled once, by page, and one sort serves the numbers, gaps and texts. A page is read by one task, from a
sort that goes to disk when it must.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.chains import chain, group_key
from tallyspark.sources.folders import written

NEW_TEXT_LINE = 10.0
NEW_SEGMENT = 15.0
ROW_TOLERANCE = 10.0


def confident_tokens(tokens: DataFrame, least: float = 0.3) -> DataFrame:
    """Tokens with confidence strictly above `least`, text stripped."""
    return tokens.where(F.col("confidence") > least).withColumn("text", F.trim(F.col("text")))


def is_header(text: Column, confidence: Column) -> Column:
    """Confident and at most three words."""
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    return (confidence > 0.9) & (words <= 3)


def page_summary(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.groupBy(*keys).agg(
        F.count("*").alias("total_elements"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence")
    )


def reading_order(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of each token in its page by (cy, cx, elem_id). A token without a page or cy is left out; one without cy counts for
    the ranks of its page, ahead of all others."""
    page = Window.partitionBy(*keys).orderBy("cy", "cx", "elem_id")
    paged = tokens.where(reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    return paged.withColumn("reading_rank", F.row_number().over(page).cast("long")).where(F.col("cy").isNotNull())


def _read(tokens: DataFrame, keys: list[str], new_line: float) -> DataFrame:
    """The tokens of each page numbered in order (_at). _opens tells the first token of a y level, _gap how far that lies below
    the level before (null at the first), _line counts gaps over new_line, and _blank tells a text that follows another in its
    level. Tokens are shuffled once, by page, and sorted there; all windows read the same order."""
    page = Window.partitionBy(*keys).orderBy("cy", "cx", "elem_id", "text")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    cy, own = F.col("cy"), F.col("text").isNotNull().cast("int")
    numbered = tokens.select(*keys, "cy", "cx", "elem_id", "text").withColumns(
        {"_at": F.row_number().over(page), "_above": F.lag("cy").over(page), "_texts": F.count("text").over(upto) - own}
    )
    opened = numbered.withColumn("_opens", (F.col("_at") == 1) | ~cy.eqNullSafe(F.col("_above")))
    gaps = opened.withColumn("_gap", F.when(F.col("_opens"), cy - F.col("_above")))
    new = F.coalesce(F.col("_gap") > new_line, F.lit(False))
    before = F.max(F.when(F.col("_opens"), F.col("_texts"))).over(upto)
    return gaps.withColumns(
        {"_line": F.sum(new.cast("int")).over(upto) + 1, "_new": new, "_blank": F.col("text").isNotNull() & (F.col("_texts") > before)}
    )


def _joined(pieces: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct("_at", F.col(pieces).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "")


def page_text(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Whole text of each page: a newline where y moves by more than 10, else a space."""
    read = _read(tokens, keys, NEW_TEXT_LINE)
    first = F.when(F.col("_gap").isNull(), "").when(F.col("_new"), "\n").otherwise(" ")
    between = F.when(F.col("_opens"), first).when(F.col("_blank"), " ").otherwise("")
    pieces = read.withColumn("_piece", F.concat(between, F.coalesce("text", F.lit(""))))
    return pieces.groupBy(*keys).agg(F.trim(_joined("_piece")).alias("full_text"))


def line_segments(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Text lines of each page: a new one where y moves by more than 15 from the previous token."""
    read = _read(tokens, keys, NEW_SEGMENT).withColumnRenamed("_line", "line_no")
    begins = (F.col("_at") == 1) | F.col("_new")
    between = F.when(begins, "").when(F.col("_opens") | F.col("_blank"), " ").otherwise("")
    pieces = read.withColumn("_piece", F.concat(between, F.coalesce("text", F.lit(""))))
    return pieces.groupBy(*keys, "line_no").agg(F.count("*").alias("n_tokens"), _joined("_piece").alias("line_text"))


def row_starts(cells: DataFrame, table_keys: list[str]) -> DataFrame:
    """(_key, _at, row_no) for each level y1 of a table, in millionths. A level opens a row when it is more than 10 below
    the level that opened the row before.

    Only the distinct levels decide. They are cut into islands at gaps over the tolerance, where a row opens in any case;
    within islands, pointers from each level to the next start are doubled. No array or task holds a whole table for that.
    """
    levels = cells.where("y1 is not null").select(group_key(table_keys).alias("_key"), millionths("y1").alias("_at")).distinct()
    levels = written(levels, "levels")
    starts = chain(levels, round(ROW_TOLERANCE * 1e6)).withColumn("_opens", F.lit(1))
    upto = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    marked = levels.join(starts, ["_key", "_at"], "left")
    return marked.select("_key", "_at", F.sum(F.coalesce("_opens", F.lit(0))).over(upto).cast("int").alias("row_no"))


def millionths(place: str) -> Column:
    return F.round(F.col(place) * F.lit(1e6)).cast("long")


def cell_grid(cells: DataFrame, table_keys: list[str]) -> DataFrame:
    """Row and column number of each table cell (x1, y1, cell_id). Levels are told apart to a millionth; a cell without y1
    has no row and is left out.

    A gap over the tolerance always opens a row, and an island between two such gaps that is no higher than the tolerance is
    one row. So one sort of each table numbers its rows, and only tables with a higher island need `row_starts`. A table is
    read by one task, from a sort that goes to disk when it must; the numbered cells are written once.
    """
    tolerance = round(ROW_TOLERANCE * 1e6)
    down = Window.partitionBy(*table_keys).orderBy("_at")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.where("y1 is not null").withColumn("_at", millionths("y1")).withColumn("_above", F.lag("_at").over(down))
    opened = placed.withColumn("_opens", F.col("_above").isNull() | (F.col("_at") - F.col("_above") > tolerance))
    islands = opened.withColumns(
        {"row_no": F.sum(F.col("_opens").cast("int")).over(upto).cast("int"), "_top": F.max(F.when(F.col("_opens"), F.col("_at"))).over(upto)}
    )
    numbered = written(_columns_numbered(islands.drop("_above", "_opens"), table_keys), "grid")
    higher = numbered.where(F.col("_at") - F.col("_top") > tolerance).select(group_key(table_keys).alias("_key")).distinct()
    own = [*cells.columns, "row_no", "col_no"]
    if higher.isEmpty():
        return numbered.select(own)
    keyed = numbered.withColumn("_key", group_key(table_keys))
    again = keyed.join(higher, "_key", "left_semi").drop("row_no", "col_no")
    rows = again.join(row_starts(again, table_keys), ["_key", "_at"])
    return keyed.join(higher, "_key", "left_anti").select(own).unionByName(_columns_numbered(rows, table_keys).select(own))


def _columns_numbered(rows: DataFrame, table_keys: list[str]) -> DataFrame:
    in_row = Window.partitionBy(*table_keys, "row_no").orderBy("x1", "y1", "cell_id")
    return rows.withColumn("col_no", F.row_number().over(in_row))


def token_cell_join(
    cells: DataFrame, tokens: DataFrame, page_keys: list[str], cell_keys: list[str], tile: float = 1 / 1024
) -> DataFrame:
    """Text of each cell: tokens whose centre lies inside its box (edges included), joined in token order.

    The page is tiled on several levels; tiles of level n have edges of `tile` * 2^n. A cell enters on the level whose
    tiles are just longer than its own longer edge, so it touches four tiles at most, whatever the scale of the coordinates.
    A token enters once on each level that a cell of its page occupies. A cell without a finite box has no text.
    """
    box = ["x1", "y1", "x2", "y2"]
    finite = F.lit(True)
    for c in box:
        finite = finite & F.col(c).isNotNull() & (F.abs(c) < F.lit(float("inf")))
    edge = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    level = F.when(edge < tile, 0).otherwise(F.floor(F.log2(edge / F.lit(tile))) + 1).cast("int")
    sized = cells.withColumn("_level", F.when(finite, level))

    def tile_of(v: str) -> Column:
        return F.floor(F.col(v) / (F.lit(tile) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")

    spread = sized.withColumn("_tx", F.explode_outer(F.sequence(tile_of("x1"), tile_of("x2"))))
    spread = spread.withColumn("_ty", F.explode_outer(F.sequence(tile_of("y1"), tile_of("y2"))))
    occupied = sized.where("_level is not null").select(*page_keys, "_level").distinct()
    placed = tokens.select(*page_keys, "elem_id", "text", "cx", "cy").join(occupied.hint("shuffle_hash"), page_keys)
    placed = placed.withColumns({"_tx": tile_of("cx"), "_ty": tile_of("cy")})
    c, t = spread.alias("c"), placed.alias("t")
    on = F.col("t.cx").between(F.col("c.x1"), F.col("c.x2")) & F.col("t.cy").between(F.col("c.y1"), F.col("c.y2"))
    for k in [*page_keys, "_level", "_tx", "_ty"]:
        on = on & (F.col(f"c.{k}") == F.col(f"t.{k}"))
    hit = F.when(F.col("t.elem_id").isNotNull(), F.struct(F.col("t.elem_id").alias("e"), F.col("t.text").alias("t")))
    return (
        c.join(t, on, "left")
        .groupBy(*[F.col(f"c.{k}").alias(k) for k in cell_keys])
        .agg(F.sort_array(F.collect_list(hit)).alias("hits"))
        .select(*cell_keys, F.trim(F.array_join(F.transform("hits", lambda h: h["t"]), " ")).alias("cell_text"))
    )
