"""Quality scores: random-indexing word vectors pooled for each document, then a two-layer network with calibrated output."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, compute, crc_mod, slices, texts_of

BUCKETS = 8_192  # words share this many vectors by hash
DIM = 32
NONZERO = 4  # parts of a random index vector that are not 0: half of them +1, half -1
WINDOW = 2  # neighbours on either side that make up a context
SUM_COLUMNS = [f"s{d}" for d in range(DIM)]
SAMPLE = 20_000  # labelled rows that the network is fitted on, at most in expectation
SEED = 7
HALF = BUCKETS // 2  # words and shapes have half the buckets each
SIGNS = bytes(c for c in range(128) if not chr(c).isalpha())
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
SAME = re.compile(rb"([Aa9])\1+")
PIECE_TOKENS = 1 << 18  # tokens worked on at once
KNOWN_WORDS = 120_000


def index_vectors() -> np.ndarray:
    """Sparse random index vectors, one row for each bucket: the parts that are +1 (first half) and -1 (second half)."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(DIM, NONZERO, replace=False) for _ in range(BUCKETS)])


class Buckets(dict):
    """Word bucket times BUCKETS plus shape bucket of each blank-separated token. The word is its letters in lower case; the
    shape keeps case, digits and signs but no letter: runs of capitals, of small letters and of digits count as one."""

    def __missing__(self, token: str) -> int:
        raw = token.encode("utf-8", "surrogatepass")
        word = token.lower().encode("utf-8", "surrogatepass").translate(None, SIGNS) or raw
        shape = SAME.sub(rb"\1", raw.translate(SHAPE))
        pair = zlib.crc32(word) % HALF * BUCKETS + HALF + zlib.crc32(shape) % HALF
        if len(self) < KNOWN_WORDS:
            self[token] = pair
        return pair


_KNOWN = Buckets()


def _blocks(texts: list[str]):
    """Tokens of the texts in blocks of about PIECE_TOKENS: (text numbers, starts, word buckets, shape buckets). A long text
    is cut into several runs."""
    owners, runs, size = [], [], 0
    for i, text in enumerate(texts):
        tokens = text.split()
        for k in range(0, len(tokens), PIECE_TOKENS):
            some = tokens[k : k + PIECE_TOKENS]
            owners.append(i)
            runs.append(np.fromiter(map(_KNOWN.__getitem__, some), dtype=np.int64, count=len(some)))
            size += len(some)
            if size >= PIECE_TOKENS:
                yield _block(owners, runs)
                owners, runs, size = [], [], 0
    if runs:
        yield _block(owners, runs)


def _block(owners: list[int], runs: list[np.ndarray]):
    starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
    both = np.concatenate(runs)
    return np.array(owners), starts, both // BUCKETS, both % BUCKETS


def _contexts(batches):
    """Sums of context vectors of one partition, one row for each bucket seen."""
    cells = index_vectors()
    sums = np.zeros(BUCKETS * DIM, dtype=np.int64)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in slices(batches):
        for _, starts, words, shapes in _blocks(texts_of(batch.column(0))):
            first = np.zeros(len(words) + WINDOW, dtype=np.int64)
            first[starts] = 1
            run = np.cumsum(first)[: len(words)]  # texts don't see each other
            for stream in (words, shapes):
                counts += np.bincount(stream, minlength=BUCKETS)
                for step in range(1, WINDOW + 1):
                    same = np.flatnonzero(run[step:] == run[:-step])
                    a, b = stream[same], stream[same + step]
                    for own, other in ((a, b), (b, a)):
                        at = own * DIM
                        for k in range(NONZERO):
                            found = np.bincount(at + cells[other, k], minlength=BUCKETS * DIM)
                            if k < NONZERO // 2:
                                sums += found
                            else:
                                sums -= found
    used = np.flatnonzero(counts)
    sums = sums.reshape(BUCKETS, DIM)
    columns = [pa.array(used, pa.int32()), pa.array(counts[used]), *(pa.array(sums[used, d]) for d in range(DIM))]
    yield pa.record_batch(columns, names=["bucket", "n", *SUM_COLUMNS])


def word_vectors(docs: DataFrame, text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of all buckets from every token of every text. A vector is the sum of the index vectors of the
    neighbours, at length 1; the weight falls with the token's share of the corpus. Tasks send at most 2.2 MB each, the
    driver gets as much once."""
    schema = "bucket int, n long, " + ", ".join(f"{c} long" for c in SUM_COLUMNS)
    partial = docs.select(F.col(text_column).alias("text")).mapInArrow(_contexts, schema)
    total = partial.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", *SUM_COLUMNS)))
    sums, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for row in bounded_rows(total, BUCKETS, "word vectors"):
        counts[row[0]], sums[row[0]] = row[1], row[2:]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    share = counts / max(1.0, counts.sum() / 2)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row for each text: weighted mean word vector, mean shape vector, and the same two over distinct tokens. A text
    without tokens gets zeros."""
    out = np.zeros((len(texts), 4 * DIM + 1))
    totals = np.zeros((len(texts), 4))
    heavy = vectors * weights[:, None]
    for owners, starts, words, shapes in _blocks(texts):
        which = np.repeat(owners.astype(np.int64), np.diff(np.append(starts, len(words)))) * BUCKETS
        for k, (stream, table) in enumerate(((words, heavy), (shapes, vectors))):
            keys = np.sort(which + stream)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times = np.diff(np.append(first, len(keys)))
            owner, bucket = keys[first] // BUCKETS, keys[first] % BUCKETS
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            found = table[bucket]
            for part, rows in ((2 + k, found), (k, found * times[:, None].astype(np.float32))):
                at = slice(part * DIM, (part + 1) * DIM)
                np.add.at(out[:, at], owner[first], np.add.reduceat(rows, first, axis=0))
            np.add.at(totals[:, k], owner[first], np.add.reduceat(times, first))
            np.add.at(totals[:, 2 + k], owner[first], np.diff(np.append(first, len(owner))))
    for k in range(4):
        out[:, k * DIM : (k + 1) * DIM] /= np.maximum(totals[:, k], 1.0)[:, None]
    out[:, -1] = totals[:, 2] / np.maximum(totals[:, 0], 1.0)  # weight of the pool of distinct words
    return out


class Network:
    """Two layers with tanh between them, and a temperature that divides the output before the logistic function."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 300, batch: int = 256):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        fit, hold = order[len(order) // 5 :], order[: len(order) // 5]
        self.w = [
            rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]),
            np.zeros(hidden),
            rng.standard_normal(hidden) / np.sqrt(hidden),
            np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))]),
        ]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.w]
        step = 0
        for _ in range(min(epochs, 1 + 40_000 * batch // max(1, 8 * len(fit)))):
            some = rng.permutation(fit)
            for k in range(0, len(some), batch):
                rows = some[k : k + batch]
                step += 1
                inner = np.tanh(x[rows] @ self.w[0] + self.w[1])
                error = (_logistic(inner @ self.w[2] + self.w[3][0]) - y[rows]) / len(rows)
                back = np.outer(error, self.w[2]) * (1 - inner**2)
                slopes = [x[rows].T @ back + 1e-4 * self.w[0], back.sum(axis=0), inner.T @ error, np.array([error.sum()])]
                for p, g, m in zip(self.w, slopes, moments, strict=True):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        z, truth = self._raw(x[hold]), y[hold]
        grid = np.exp(np.linspace(np.log(0.25), np.log(16.0), 121))
        losses = [np.logaddexp(0, np.where(truth == 1, -z, z) / t).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))]) if len(hold) else 1.0

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._raw((x - self.mean) / self.scale) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class Model:
    """What scoring needs: word vectors, their weights and the network; about 1.2 MB whatever the corpus."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, network: Network | None):
        self.vectors, self.weights, self.network = vectors, weights, network

    def score(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.score(pool(texts, self.vectors, self.weights))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5, held_fold: int = 0
) -> Model:
    """Word vectors from all docs, the network from at most `sample` labelled rows (in expectation, chosen by hash of the
    id, the same at each run). Labels of rows whose crc32(id) mod folds is held_fold are never read; null labels are left
    out. Repeated rows count once; where an id bears many texts, `4 * sample` of all rows at most are taken, those of least hash.
    Without two classes of labels every score is 0.5."""
    vectors, weights = word_vectors(docs)
    usable = labels.where(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod("doc_id", folds) != held_fold)
    ).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def pooled(batches):
        for batch in slices(batches):
            x = pool(texts_of(batch.column("text")), vectors, weights)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "y": batch.column("y"),
                    "x": pa.array([row.astype(np.float32).tobytes() for row in x], pa.binary()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(usable.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id"
    )
    found = rows.mapInArrow(pooled, "doc_id long, y int, x binary").distinct()
    got = found.orderBy(F.xxhash64("doc_id", "y", "x")).limit(4 * sample).collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    y = np.array([r["y"] for r in got], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model(vectors, weights, None)
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got]).astype(np.float64)
    return Model(vectors, weights, Network(x, y))


def scored(
    docs: DataFrame,
    model: Model,
    column: str = "score",
    text_column: str = "text",
    keep: Sequence[str] | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """docs (its columns of keep) with its score; a column of that name is replaced. Texts are read whole; a null text counts
    as empty and gets the score of a text without words. With min_score, rows below it go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    good = None if min_score is None else lambda found: [x >= min_score for x in found[0]]
    return compute(docs, text_column, lambda texts: [held.value.score(texts).tolist()], {column: "double"}, keep, good)
