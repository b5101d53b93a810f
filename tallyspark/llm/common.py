"""Helpers that several operators share: the shared work folder, written cuts of the lineage, bounded reads, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


BATCH_ROWS = "512"  # rows of text that go to a Python worker at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Texts can be long, so the session's Arrow batches are set to few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. A plain local session without that
    setting, as in a test, gets one under /tmp/checkpoints; a cluster without it is refused."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, so that a lost executor repeats no earlier stage."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, **fields: str) -> StructType:
    """The schema of df with more fields at its end: name=type."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items())).fields])


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that is small by its nature. Fails, rather than cutting off, where it holds more than most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def slices(batches, rows: int = 512):
    """Batches cut to few rows, so that a task holds the texts and results of so many rows at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def compute(
    docs: DataFrame,
    text_column: str,
    work: Callable[[list[str]], list],
    fields: dict[str, str],
    keep: Sequence[str] | None = None,
    where: Callable[[list], list[bool]] | None = None,
) -> DataFrame:
    """The columns of keep (all of docs) and new ones: work takes the texts of a batch (null: empty) and returns a list of
    values for each field. where takes those lists and tells which rows stay. Columns with the names of fields go."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in fields]
    rows = docs.select(*names, F.col(text_column).alias("_text_of_row"))
    out = with_fields(docs.select(*names), **fields)
    types = [to_arrow_type(f.dataType) for f in out.fields[len(names) :]]
    at = [i for i, c in enumerate(names) if c == text_column]
    if at:  # the text travels once
        rows = docs.select(*names)

    def run(batches):
        for batch in slices(batches):
            found = work(texts_of(batch.column(at[0] if at else len(names))))
            columns = [*batch.columns[: len(names)], *(pa.array(x, t) for x, t in zip(found, types, strict=True))]
            made = pa.RecordBatch.from_arrays(columns, names=[*names, *fields])
            yield made.filter(pa.array(where(found), pa.bool_())) if where else made

    return rows.mapInArrow(run, out)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of unsigned integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the edges a-b: label spreading with pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _forest(batches):
    """Edges of one partition, reduced batch by batch to one edge for each node that has a smaller one within reach."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = find_roots(at[: len(u)], at[len(u) :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch({"u": pa.array(nodes[own]), "v": pa.array(nodes[root[own]])})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): the smallest node within reach.

    Alternates large-star and small-star steps until the edges no longer change; every step is grouping and joining, and
    each round is written to the shared folder. Nodes whose component is themselves appear too. Nulls and loops are left out.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.mapInArrow(_forest, "u long, v long").distinct())
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    old = None
    while True:
        new = e.agg(mark.alias("m")).first()["m"]
        if new == old:
            break
        old = new
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        moved = star.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
