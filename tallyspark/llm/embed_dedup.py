"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import components, cut, find_roots

SEED = 20_240_101
BUCKET_ROWS = 256  # rows of a bucket that chance alone fills
MISSED = 0.001  # share of pairs exactly at the threshold that may meet in no bucket
SIGMAS = 4.0  # width of the confidence bounds
TILE = 1_024


def rotations(dim: int, count: int) -> np.ndarray:
    """count random orthogonal matrices, the same everywhere."""
    rng = np.random.default_rng(SEED + dim)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def code(units: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, signs +1/-1, correction factors): the factor is the inner product of a rotated unit vector with
    its own code at length 1."""
    rotated = units @ rotation.T
    signs = np.where(rotated >= 0, 1.0, -1.0)
    return rotated, signs, np.abs(rotated).sum(axis=1) / math.sqrt(units.shape[1])


def estimate(signs: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of the inner products of coded vectors (rows) with rotated queries (columns). The estimate
    is unbiased over random rotations; the bound is SIGMAS standard deviations, one for each coded vector."""
    dim = signs.shape[1]
    products = (signs.astype(np.float32) @ queries.T.astype(np.float32)) / (math.sqrt(dim) * factors[:, None])
    spread = np.sqrt(np.maximum(0.0, 1.0 - factors**2)) / factors / math.sqrt(max(1, dim - 1))
    return products, SIGMAS * spread


def plan(n_rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a bucket key, number of keys): buckets of about BUCKET_ROWS by chance, and as many keys as a pair exactly at
    the threshold needs to share one with probability 1 - MISSED."""
    bits = max(1, math.ceil(math.log2(max(2.0, n_rows / BUCKET_ROWS))))
    same = (1.0 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1.0 - same))) if same < 1 else 1


def bucket_keys(units: np.ndarray, bits: int, n_keys: int) -> np.ndarray:
    """Integer keys (rows x n_keys) cut from the sign codes under several rotations."""
    dim = units.shape[1]
    stack = rotations(dim, -(-bits * n_keys // dim)).reshape(-1, dim)[: bits * n_keys]
    on = (units @ stack.T >= 0).reshape(len(units), n_keys, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with cosine >= threshold. Codes of a estimate all products with b; only pairs whose upper
    confidence bound reaches the threshold are computed again, exactly and in double precision."""
    rotation = rotations(a.shape[1], 1)[0]
    _, signs, factors = code(a, rotation)
    products, bound = estimate(signs, factors, b @ rotation.T)
    i, j = np.nonzero(products + bound[:, None] >= threshold)
    out = np.zeros(products.shape, dtype=bool)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rows_out(ids, others, counts) -> pa.RecordBatch:
    return pa.record_batch(
        {"a": pa.array(ids, pa.int64()), "b": pa.array(others, pa.int64()), "n": pa.array(counts, pa.int64())}
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Bit-equal vectors form a class first; the work is on classes. A class enters one bucket for each of several keys cut from
    its rotated sign code (key length and number follow the number of rows, see plan). A pair is looked at in the first
    bucket it shares only. Buckets are compared in tiles of 1024 x 1024, so no task holds a whole bucket; a tile returns
    counts and a spanning forest, never its pairs. Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing; vectors of unlike length never link. Ids must be unique; a null id gives a row that links with nothing.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    ok = F.coalesce(usable, F.lit(False))
    rows = rows.withColumn("v", F.when(ok, F.transform("v", lambda x: x + F.lit(0.0))))  # one zero only
    seen = F.col("v").isNotNull()
    rows = rows.withColumn("h1", F.when(seen, F.xxhash64("v"))).withColumn("h2", F.when(seen, F.xxhash64(F.lit(1), "v")))
    rows = cut(rows)
    keyed = rows.where(seen)
    classes = cut(
        keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("v").alias("v"))
    )
    bits, n_keys = plan(classes.count(), threshold)

    def assign(batches):
        for batch in batches:
            for dim in {len(v) for v in batch.column("v").to_pylist()}:
                some = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("v")), dim))
                units = unit_rows(_vectors(some.column("v")))
                keys = bucket_keys(units, bits, n_keys)
                n = len(units)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * n_keys, keys.reshape(-1))
                unit = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, units.reshape(-1))
                yield pa.record_batch(
                    [some.column("rep"), some.column("members"), unit, lists, pa.array([dim] * n, pa.int32())],
                    names=["rep", "members", "unit", "keys", "dim"],
                )

    schema = "rep long, members long, unit array<double>, keys array<long>, dim int"
    coded = cut(classes.select("rep", "members", "v").mapInArrow(assign, schema))
    placed = coded.select("rep", "dim", F.posexplode("keys").alias("key_no", "bucket"))
    fill = cut(placed.groupBy("dim", "key_no", "bucket").agg(F.count("*").alias("rows")).where("rows > 1"))
    # each row takes a tile of its bucket by hash, and goes to every pair of tiles that holds its own
    tiled = coded.select("rep", "members", "unit", "keys", "dim", F.posexplode("keys").alias("key_no", "bucket")).join(
        fill, ["dim", "key_no", "bucket"]
    )
    tiled = tiled.withColumn("tiles", F.ceil(F.col("rows") / TILE).cast("int")).withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    )
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "dim",
        "key_no",
        "bucket",
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
        "tile",
        "rep",
        "members",
        "unit",
        "keys",
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        low, high, key_no = (group.column(k)[0].as_py() for k in ("low", "high", "key_no"))
        tile = group.column("tile").to_numpy()
        rep, members = group.column("rep").to_numpy(), group.column("members").to_numpy()
        units, keys = (_vectors(group.column(k).chunk(0)) for k in ("unit", "keys"))
        ids, others, counts = [], [], []
        side_a, side_b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        forest = ([], [])
        gained = np.zeros(len(rep), dtype=np.int64)
        for p in range(0, len(side_a), TILE):
            for q in range(0, len(side_b), TILE):
                i, j = side_a[p : p + TILE], side_b[q : q + TILE]
                linked = linked_pairs(units[i], units[j], threshold)
                x, y = np.nonzero(linked)
                new = rep[i[x]] < rep[j[y]] if low == high else np.ones(len(x), dtype=bool)
                for k in range(key_no):
                    new &= keys[i[x], k] != keys[j[y], k]
                x, y = i[x[new]], j[y[new]]
                np.add.at(gained, x, members[y])
                np.add.at(gained, y, members[x])
                nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = find_roots(at[: len(x)], at[len(x) :], len(nodes))
                own = np.flatnonzero(root != np.arange(len(nodes)))
                forest[0].append(rep[nodes[own]])
                forest[1].append(rep[nodes[root[own]]])
        got = np.flatnonzero(gained)
        ids = np.concatenate([rep[got], *forest[0]])
        others = np.concatenate([rep[got], *forest[1]])
        counts = np.concatenate([gained[got], np.zeros(len(ids) - len(got), dtype=np.int64)])
        return pa.Table.from_batches([_rows_out(ids, others, counts)])

    found = cut(
        tiled.groupBy("dim", "key_no", "bucket", "low", "high").applyInArrow(compare, "a long, b long, n long")
    )
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    component = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    least = classes.select("h1", "h2", "rep", "members").join(links, "rep", "left").join(component, "rep", "left")
    least = cut(
        least.select(
            "h1",
            "h2",
            (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        ).where("n_links > 0")
    )
    alone = rows.select("vec_id", "h1", "h2").join(least, ["h1", "h2"], "left")
    return alone.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
