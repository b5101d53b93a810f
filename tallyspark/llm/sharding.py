"""Sharding by best-fit-decreasing bin packing of groups that must stay together."""

from __future__ import annotations

import random
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut

SLICES = 1_024  # rows are numbered within so many slices of a shard, groups within so many of a size
BROADCAST_ROWS = 1_000_000  # rows of 28 bytes up to which the places of all sizes are broadcast


class _Bin:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key: tuple[int, int], rank: float):
        self.key, self.rank, self.left, self.right = key, rank, None, None


def _split(tree: _Bin | None, key: tuple[int, int]) -> tuple[_Bin | None, _Bin | None]:
    """The bins before key, and the others."""
    if tree is None:
        return None, None
    if tree.key < key:
        tree.right, others = _split(tree.right, key)
        return tree, others
    before, tree.left = _split(tree.left, key)
    return before, tree


def _merge(a: _Bin | None, b: _Bin | None) -> _Bin | None:
    """One tree of two, all of whose bins stand in that order."""
    if a is None or b is None:
        return a or b
    if a.rank < b.rank:
        a.right = _merge(a.right, b)
        return a
    b.left = _merge(a, b.left)
    return b


class OpenBins:
    """Open bins by (room, number) in a treap, a tree that random ranks keep balanced. The ranks are the same in each run."""

    def __init__(self):
        self.tree, self.random = None, random.Random(0)

    def add(self, room: int, number: int) -> None:
        before, after = _split(self.tree, (room, number))
        self.tree = _merge(_merge(before, _Bin((room, number), self.random.random())), after)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the bin of the least room that holds size (ties: the smallest number) and returns (room, number)."""
        before, after = _split(self.tree, (size, -1))
        key = None
        if after is not None:
            first = after
            while first.left is not None:
                first = first.left
            key = first.key
            _, after = _split(after, (key[0], key[1] + 1))
        self.tree = _merge(before, after)
        return key


def pack_runs(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit-decreasing over runs (size, count) of equal sizes, largest size first, without a loop over the items.

    The tightest bin that holds one item of a run stays the tightest until it holds no further one, so it takes as many at
    once as it has room for. Returns (size, first, end, bin): items first to end of that size, by number within the size. None
    if a size exceeds the capacity or more than `most` bins are needed.
    """
    bins, placed, opened = OpenBins(), [], 0
    for size, count in runs:
        if size > capacity:
            return None
        first = 0
        while first < count:
            room, number = bins.take(size) or (capacity, opened)
            if number == opened:
                opened += 1
                if most is not None and opened > most:
                    return None
            n = min(count - first, room // size) if size else count - first
            placed.append((size, first, first + n, number))
            bins.add(room - n * size, number)
            first += n
    return placed


def level_runs(runs: list[tuple[int, int]], n_bins: int) -> list[tuple[int, int, int, int]]:
    """Packs runs into at most n_bins bins of the smallest capacity that a search finds to do, so that their contents come
    out nearly equal. What exceeds an equal share has a bin of its own, and the rest is levelled over the others."""
    runs, placed, taken = list(runs), [], 0
    left, done = sum(s * n for s, n in runs), {}
    while runs and taken < n_bins - 1 and runs[0][0] * (n_bins - taken) > left:
        size, count = runs.pop(0)
        at = done.get(size, 0)
        placed.append((size, at, at + 1, taken))
        done[size] = at + 1
        left, taken = left - size, taken + 1
        if count > 1:
            runs.insert(0, (size, count - 1))
    if not runs:
        return placed
    bins = n_bins - taken
    failed, step = max(-(-left // bins), runs[0][0]) - 1, 1
    best = None
    while best is None:  # doubling steps above the least thinkable capacity, then bisection
        works = min(failed + step, max(left, runs[0][0]))
        best = pack_runs(runs, works, bins)
        if best is None:
            failed, step = works, step * 2
    while failed + 1 < works:
        middle = (failed + works) // 2
        tried = pack_runs(runs, middle, bins)
        if tried is None:
            failed = middle
        else:
            best, works = tried, middle
    return placed + [(s, a + done.get(s, 0), e + done.get(s, 0), taken + b) for s, a, e, b in best]


def _runs(sizes: list[int]) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """The runs of a list of sizes, and the places of each size in it."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    places = {size: list(at) for size, at in groupby(order, key=lambda k: sizes[k])}
    return [(size, len(at)) for size, at in places.items()], places


def _spread(placed: list[tuple[int, int, int, int]], places: dict[int, list[int]], n: int) -> list[int]:
    bins = [0] * n
    for size, first, end, number in placed:
        for k in places[size][first:end]:
            bins[k] = number
    return bins


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int] | None:
    """Bin of each size, or None if one exceeds the capacity. Equal sizes go in in the given order."""
    runs, places = _runs(sizes)
    placed = pack_runs(runs, capacity)
    return None if placed is None else _spread(placed, places, len(sizes))


def pack(sizes: list[int], n_bins: int) -> list[int]:
    """level_runs for a list of sizes: the bin of each."""
    runs, places = _runs(sizes)
    return _spread(level_runs(runs, n_bins), places, len(sizes))


def numbered(rows: DataFrame, by: str, slice_by, order: list, name: str) -> DataFrame:
    """rows with a column `name`: their number from 0 within each value of `by`, without gaps, by slices of the hash slice_by
    and then by order. A value that holds most rows is numbered by 1,024 tasks; their starts come from partial counts."""
    sliced = rows.withColumn("_slice", F.pmod(slice_by, F.lit(SLICES)).cast("int"))
    counts = sliced.groupBy(by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(by, "_slice").orderBy(*order)) - 1
    return (
        sliced.withColumn("_nth", nth)
        .join(starts, [by, "_slice"])
        .withColumn(name, (F.col("_start") + F.col("_nth")).cast("long"))
        .drop("_slice", "_nth", "_start")
    )


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int | None = None,
) -> DataFrame:
    """One row per document: id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Size: UTF-8 bytes of the text plus 1 (null: 1). Rows with equal texts form a group and share a shard; null and empty
    texts are one group. Groups are packed by best-fit-decreasing: into n_shards shards levelled by bytes, where a group
    beyond an equal share gets a shard of its own, or, with a capacity, into as few shards of at most so many bytes as the
    method finds; a group above the capacity then gets a shard of its own.

    The driver packs the distinct group sizes with their counts, at most the root of twice all bytes, as distinct sizes add
    up to no more than those. A group finds its shard by its number within its size, in order of hashes. Slots run
    from 0 without gaps in each shard, by slices of the id's hash and then by id, size and text_crc32, so rows that differ in
    none of these are interchangeable. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit("group"), text).alias("g2"),
        )
    )
    groups = cut(rows.groupBy("g1", "g2").agg(F.sum("size").alias("group_size")))
    sizes = groups.groupBy("group_size").agg(F.count("*").alias("n")).toArrow()
    runs = sorted(zip(*(sizes.column(k).to_pylist() for k in ("group_size", "n")), strict=True), reverse=True)
    if capacity is None:
        placed = level_runs(runs, n_shards)
    else:
        large, at = [(s, n) for s, n in runs if s > capacity], 0
        placed = []
        for s, n in large:
            placed += [(s, k, k + 1, at + k) for k in range(n)]
            at += n
        placed += [(s, a, e, at + b) for s, a, e, b in pack_runs(runs[len(large) :], capacity)]
    columns = list(zip(*placed, strict=True)) or [()] * 4
    types = {"group_size": pa.int64(), "first": pa.int64(), "end": pa.int64(), "shard": pa.int32()}
    table = pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))
    bins = docs.sparkSession.createDataFrame(table)
    if len(placed) <= BROADCAST_ROWS:  # above that Spark shuffles, and splits a size that many groups share
        bins = F.broadcast(bins)
    of_group = (
        numbered(groups, "group_size", F.xxhash64("g2", "g1"), ["g1", "g2"], "nth")
        .join(bins, "group_size")
        .where("nth >= first AND nth < end")
        .select("g1", "g2", "shard")
    )
    in_shards = cut(rows.join(of_group, ["g1", "g2"]).select("doc_id", "size", "text_crc32", "shard"))
    return numbered(in_shards, "shard", F.xxhash64("doc_id"), ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
