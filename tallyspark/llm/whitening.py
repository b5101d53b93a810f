"""Whitening of embeddings along their leading components, which FEAST finds: quadrature of complex shifted solves projects a
subspace onto an interval of eigenvalues, Rayleigh-Ritz extracts the components, and inertia counts show that none is missing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, cut, slices

STEPS = 256  # steps of a unit
MOST_DIMS = 1_024  # the driver holds matrices of this order at most
NODES = 8  # solves on the half circle
ROUNDS = 40
EXACT = 1 << 53  # doubles hold integers below exactly
SEED = 20_240_102


# --- eigenvalues of a small symmetric matrix --------------------------------------------------------------------------
def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of (positive, negative) eigenvalues, from the pivots of a symmetric elimination with complete pivoting: the
    largest diagonal entry, or two by two around the largest other entry where that is much larger."""
    a, plus, minus = a.copy(), 0, 0
    keep = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(a.diagonal())
        k, top = int(diagonal.argmax()), diagonal.max()
        off = np.abs(a - np.diag(a.diagonal()))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if max(top, off[i, j]) == 0:
            break
        if top >= keep * off[i, j]:
            pivot = [k]
            plus, minus = plus + int(a[k, k] > 0), minus + int(a[k, k] < 0)
        else:  # a pivot of this kind has a negative determinant
            pivot = [int(i), int(j)]
            plus, minus = plus + 1, minus + 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return plus, minus


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above shift."""
    return inertia(a - shift * np.eye(len(a)))[0]


def bracket(a: np.ndarray, count: int, floor: float) -> tuple[float, float]:
    """(low, high) with all eigenvalues below high and at least count above low; exactly count where a gap allows it."""
    top = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-12)
    low, under, high = floor, top, top
    for _ in range(60):  # the end above the largest
        middle = (low + under) / 2
        if above(a, middle):
            low = middle
        else:
            under = high = middle
        if under - low <= 0.05 * under:
            break
    low, over = floor, high
    for _ in range(60):
        if above(a, low) == count or over - low <= 1e-9 * high:
            break
        middle = (low + over) / 2
        if above(a, middle) >= count:
            low = middle
        else:
            over = middle
    return low, high


def project(a: np.ndarray, basis: np.ndarray, low: float, high: float) -> np.ndarray:
    """The contour integral of the resolvent around [low, high] applied to a basis; conjugate halves are one half's real part."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(basis)
    for x, w in zip(points, weights, strict=True):
        turn = np.exp(0.5j * np.pi * (x + 1))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(a)) - a, basis.astype(complex))
        out += w / 2 * (radius * turn * solved).real
    return out


def feast(a: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues within (low, high), falling, and their unit vectors as columns. Fails unless the inertia counts at both
    ends show that all were found."""
    size, wanted = len(a), above(a, low) - above(a, high)
    scale = float(np.abs(a).sum(axis=1).max())
    width = min(size, max(2 * wanted, wanted + 4))
    while True:
        basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0]
        last = np.inf
        for _ in range(ROUNDS):
            if width < size:
                basis = np.linalg.qr(project(a, basis, low, high))[0]
            values, turned = np.linalg.eigh(basis.T @ a @ basis)
            basis = basis @ turned
            inside = (values > low) & (values <= high)
            off = float(np.abs(a @ basis[:, inside] - basis[:, inside] * values[inside]).max(initial=0.0))
            if inside.sum() == wanted and (off <= 1e-14 * scale or 0.9 * last <= off <= 1e-11 * scale):
                return values[inside][::-1], basis[:, inside][:, ::-1]
            last = off
        if width == size:
            raise ArithmeticError(f"{int(inside.sum())} components found between {low} and {high}, {wanted} counted")
        width = min(size, 2 * width)


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues, falling, and their vectors as columns; values that rounding can't tell from 0 are left out."""
    floor = float(np.trace(a)) * len(a) * 1e-15
    count = min(count, above(a, floor)) if floor > 0 else 0
    if not count:
        return np.zeros(0), np.zeros((len(a), 0))
    values, vectors = feast(a, *bracket(a, count, floor))
    return values[:count], vectors[:, :count]


# --- vectors ----------------------------------------------------------------------------------------------------------
def _rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (row numbers, matrix) of the vectors that hold finite entries only."""
    flat = column.flatten()
    valid = ~flat.is_null().to_numpy(zero_copy_only=False)
    values = np.where(valid, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.nan)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        matrix = values[starts[at][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1)
        found[size] = at[good], matrix[good]
    return found


def steps_of(matrix: np.ndarray) -> np.ndarray:
    """floor(256 * entry) as integers; what 64 bits don't hold stays at their ends."""
    with np.errstate(over="ignore"):
        steps = np.floor(matrix * STEPS) + 0.0
    inside = np.clip(steps, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(steps >= 2.0**63, np.iinfo(np.int64).max, inside)


def fixed_point(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vector in fixed point, as the bytes of its 64-bit integers. Rows whose vector is null, empty, or
    holds null or non-finite entries are left out."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, column = batch.columns
            for at, matrix in _rows(column).values():
                x = [r.tobytes() for r in steps_of(matrix)]
                yield pa.record_batch({"vec_id": ids.take(pa.array(at)), "x": pa.array(x, pa.binary())})

    return rows.mapInArrow(run, f"vec_id {kind}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(len(column), -1)


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they can't overflow, else Python's."""
    largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if n * largest + max(map(abs, sums)) < 1 << 63:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of squares of n * x - sums, exact; null where 64 bits don't hold it."""
    d = from_mean(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # one column for each component
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return from_mean(x, self.n, self.sums).astype(np.float64) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _products(fit: DataFrame, rows_of, size: int) -> np.ndarray:
    """Sum over all rows of the products of every two entries of rows_of(x), for which tasks send one matrix each."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for part in slices([batch], 4_096):
                rows = rows_of(_matrix(part.column(0)))
                total += rows.T @ rows
        i, j = np.indices(total.shape)
        yield pa.record_batch({"i": pa.array(i.ravel()), "j": pa.array(j.ravel()), "v": pa.array(total.ravel())})

    sums = fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in bounded_rows(sums, size * size, "products"):
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def fit(vectors: DataFrame, count: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> Whitening | None:
    """Mean and leading components of the distinct vectors; None where no vector is usable.

    Vectors of another dimension than most distinct ones (of several such, the largest) are left out. Distinct vectors are
    found by Spark and written to the shared folder; tasks reduce them to integer sums and to products of centred rows. Only
    those sums, whose size depends on the dimension alone, reach the driver, which runs FEAST on that matrix.
    """
    distinct = cut(fixed_point(vectors, id_column, vector_column).select("x").distinct())
    common = distinct.groupBy(F.octet_length("x").alias("bytes")).agg(F.count("*").alias("n"))
    common = common.orderBy(F.col("n").desc(), F.col("bytes").desc()).limit(1).first()
    if common is None:
        return None
    size, n = common["bytes"] // 8, common["n"]
    if size > MOST_DIMS:
        raise ValueError(f"vectors of {size} dimensions; {MOST_DIMS} at most")
    used = distinct.where(F.octet_length("x") == common["bytes"])

    def add(batches):
        total = [0] * size
        for batch in batches:
            x = _matrix(batch.column(0))
            for half, weight in ((x >> 32, 1 << 32), (x & 0xFFFFFFFF, 1)):
                total = [t + weight * int(s) for t, s in zip(total, half.sum(axis=0), strict=True)]
        yield pa.record_batch({"i": pa.array(range(size)), "s": pa.array([str(t) for t in total])})

    partial = used.mapInArrow(add, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(bounded_rows(partial, size, "sums"))]
    made = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    covariance = _products(used, made.centred, size) / n
    made.trace = float(np.trace(covariance))
    made.values, made.vectors = leading(covariance, count)
    if len(made.values):
        seen = _products(used, made.apply, len(made.values)) / n  # rows are centred, so their mean is 0
        made.identity_error = float(np.abs(seen - np.eye(len(seen))).max())
    return made


def whitened(vectors: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each usable vector of the model's dimension and each component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error. Repeated rows appear as often as they stand there. Map only."""
    rows = fixed_point(vectors, id_column, vector_column)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.where("false").selectExpr("vec_id", *(f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in schema.split(", ")[1:]))
    size, k = len(model.sums), len(model.values)

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1))
            new = model.apply(x)
            columns = [
                ids.take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, model.n, dtype=np.int64)),
                pa.array([d for d in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                pa.array(new.ravel()),
                pa.array(np.tile(model.values / model.trace if model.trace else model.values, len(x))),
                pa.array(np.full(len(x) * k, model.identity_error)),
            ]
            yield pa.record_batch(columns, names=[f.split()[0] for f in schema.split(", ")])

    return rows.where(F.octet_length("x") == 8 * size).mapInArrow(run, schema)
