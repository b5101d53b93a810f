"""Benchmark decontamination: BM25 retrieval of test items for every passage by block-max WAND, then overlap checks."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, compute, cut, slices, texts_of

K1, B = 1.2, 0.75
RETRIEVE = 0.6  # share of an item's own score that a passage must reach
NUMERATOR, DENOMINATOR = 75, 100  # share of shingles that must be found
SHINGLE = 5
BLOCK = 4  # items of a block
INDEX_ITEMS = 20_000  # items of one index; further items get further indexes
ITEM_CHARS = 1 << 24  # total size of the items of one index (in expectation)
ENTRIES = 1 << 20  # block maxima that are summed at once
CELLS = 1 << 20  # passages times blocks that are held at once
PIECE_WORDS = 1 << 18
# A-Z to a-z, digits, a-z and all bytes of non-ASCII characters stay, everything else becomes a blank.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
LAST_SENTENCE = re.compile(r"[.!?…]\s+(?=\S[^.!?…]*[.!?…]?\s*$)")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item up to its last sentence, and of the last sentence; an item of one sentence is all question."""
    found = LAST_SENTENCE.search(text)
    if not found:
        return words_of(text), []
    return words_of(text[: found.end()]), words_of(text[found.end() :])


def shingle_set(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct 5-word shingles; fewer words are one shingle, no words none."""
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


class _Terms(dict):
    """Numbers of the terms; -1 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Counts(NamedTuple):
    """What BM25 takes from all items of a test set: their number, mean and largest length in words, and for each word the
    number of items that hold it."""

    items: int
    mean: float
    longest: int
    spread: dict[bytes, int]


def counts_of(parsed: list[list[bytes]]) -> Counts:
    lengths = [len(words) for words in parsed]
    mean = sum(lengths) / max(1, len(lengths))
    return Counts(len(lengths), mean, max(lengths, default=0), Counter(w for words in parsed for w in set(words)))


class _Lists:
    """Lists of (number, value) pairs by term, held as three arrays."""

    def __init__(self, terms: np.ndarray, numbers: np.ndarray, values: np.ndarray, size: int):
        """The pairs come ordered by term and number."""
        self.edges = np.searchsorted(terms, np.arange(size + 1))
        self.numbers, self.values = numbers.astype(np.int32), values

    def __getitem__(self, term: int) -> list[tuple[int, float]]:
        at = slice(self.edges[term], self.edges[term + 1])
        return list(zip(self.numbers[at].tolist(), self.values[at].tolist(), strict=True))


class Index:
    """Inverted index of items: postings by term, ordered by item, in blocks of BLOCK items with the block's largest impact.
    Postings and block maxima are held only where a term occurs, so the size follows that of the items.

    An impact is the BM25 weight of a term in an item over the item's own score (that of a passage with all its words), so
    scores run from 0 to 1 and one threshold serves items of any length. A passage counts each of its words once.
    Without counts those of the given items are taken; an index over a part of a test set gets the counts of all of it, so
    that scores and passages don't depend on the parts.
    """

    def __init__(self, items: list[tuple[int, str]], counts: Counts | None = None):
        parsed = [(i, t, words_of(t)) for i, t in items]
        parsed = [p for p in parsed if p[2]]
        total, mean, longest, spread = counts or counts_of([p[2] for p in parsed])
        # items of one vocabulary stand together, which keeps the blocks' bounds tight
        parsed.sort(key=lambda p: (max((spread[w], w) for w in set(p[2]))[1], sorted(set(p[2]), key=lambda w: (-spread[w], w))))
        self.ids = [p[0] for p in parsed]
        self.longest = longest
        self.texts = [p[1] for p in parsed]
        self.terms = _Terms((w, k) for k, w in enumerate(sorted({w for p in parsed for w in p[2]})))
        self.blocks = -(-len(parsed) // BLOCK)
        size = sum(len(set(p[2])) for p in parsed)
        terms, items, impacts = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64), np.empty(size)
        at = 0
        for n, (_, _, words) in enumerate(parsed):
            weights = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (total - spread[w] + 0.5) / (spread[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            own = sum(weights.values())
            for w, x in weights.items():
                terms[at], items[at], impacts[at] = self.terms[w], n, x / own
                at += 1
        order = np.lexsort((items, terms))
        terms, items, impacts = terms[order], items[order], impacts[order]
        self.postings = _Lists(terms, items, impacts, len(self.terms))
        blocks = items // BLOCK
        first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])][: len(terms)])
        most = np.maximum.reduceat(impacts, first) if len(first) else impacts
        self.bounds = _Lists(terms[first], blocks[first], most.astype(np.float32), len(self.terms))

    def parts(self, item: int) -> tuple[set, set, set]:
        """The shingles of an item, of its question and of its answer."""
        question, answer = question_and_answer(self.texts[item])
        return shingle_set(words_of(self.texts[item])), shingle_set(question), shingle_set(answer)

    def search(self, terms: list[int], blocks: set[int], threshold: float) -> list[tuple[int, float]]:
        """All items scoring at least threshold, by WAND over the postings of the given terms. At each step the pivot is
        the first item that the remaining terms' bounds allow; its block's bounds decide if it is scored or its block is
        left behind."""
        lists = [(self.postings[t], dict(self.bounds[t])) for t in terms]
        heads = [0] * len(lists)
        best = [max(b.values()) for _, b in lists]
        found = []
        while True:
            alive = sorted(
                (lists[k][0][heads[k]][0], k) for k in range(len(lists)) if heads[k] < len(lists[k][0])
            )
            reach, pivot = 0.0, None
            for item, k in alive:
                reach += best[k]
                if reach >= threshold - 1e-6:
                    pivot = item
                    break
            if pivot is None:
                return found
            block = pivot // BLOCK
            here = [k for item, k in alive if item <= pivot or item // BLOCK == block]
            if block not in blocks or sum(lists[k][1].get(block, 0.0) for k in here) < threshold - 1e-6:
                ahead = (block + 1) * BLOCK  # no item of this block can reach the threshold
            elif alive[0][0] == pivot:
                score = sum(lists[k][0][heads[k]][1] for item, k in alive if item == pivot)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                ahead = pivot + 1
            else:
                ahead = pivot
            for item, k in alive:
                if item < ahead:
                    postings, at = lists[k][0], heads[k]
                    while at < len(postings) and postings[at][0] < ahead:
                        at += 1
                    heads[k] = at

    def candidates(self, words: list[bytes], threshold: float = RETRIEVE) -> list[tuple[int, int, float]]:
        """(item, passage, score) of all passages of a run of words. Passages are twice as long as the longest item and
        overlap by half, so each stretch of an item's length lies in one of them. The block bounds of all passages are
        summed at once, and only passages with a block that may reach the threshold are searched."""
        step = max(1, self.longest)
        ids = np.fromiter(map(self.terms.__getitem__, words), dtype=np.int64, count=len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        size = len(self.terms)
        own = at // step
        keys = np.unique(np.concatenate([own, np.maximum(own - 1, 0)]) * size + np.concatenate([ids[at], ids[at]]))
        passages, terms = keys // size, keys % size
        starts = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]])
        edges = np.append(starts, len(keys))
        out = []
        rows_at_once = max(1, CELLS // self.blocks)
        for k in range(0, len(starts), rows_at_once):
            some = edges[k : k + rows_at_once + 1]
            reach = self._reach(terms[some[0] : some[-1]], np.repeat(np.arange(len(some) - 1), np.diff(some)), len(some) - 1)
            rows, blocks = np.nonzero(reach >= threshold - 1e-4)
            for row in np.unique(rows):
                held = terms[some[row] : some[row + 1]].tolist()
                for item, score in self.search(held, set(blocks[rows == row].tolist()), threshold):
                    out.append((item, int(passages[some[row]]), score))
        return out

    def _reach(self, terms: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """For n passages (rows) and every block, the sum of the terms' maxima in the block, some entries at a time."""
        starts = self.bounds.edges[terms]
        lengths = self.bounds.edges[terms + 1] - starts
        upto = np.cumsum(lengths)
        reach, k = np.zeros(n * self.blocks), 0
        while k < len(terms):
            done = upto[k] - lengths[k]
            end = max(k + 1, int(np.searchsorted(upto, done + ENTRIES, side="right")))
            size = lengths[k:end]
            at = np.arange(upto[end - 1] - done) + np.repeat(starts[k:end] - (upto[k:end] - size - done), size)
            low, high = rows[k] * self.blocks, (rows[end - 1] + 1) * self.blocks
            cells = np.repeat(rows[k:end] * self.blocks - low, size) + self.bounds.numbers[at]
            reach[low:high] += np.bincount(cells, self.bounds.values[at], high - low)
            k = end
        return reach.reshape(n, self.blocks)

    def hits(self, text: str) -> list[tuple[int, float, float, float, float]]:
        """(item id, best BM25 share, question, answer and whole overlap) of the items that a text holds. An item counts
        where a passage holds 75 % of its shingles, or 75 % of its question's and 75 % of its answer's."""
        words = words_of(text)
        step, best, parts = max(1, self.longest), {}, {}
        for begin in range(0, max(1, len(words)), PIECE_WORDS):
            piece = words[begin : begin + PIECE_WORDS + 2 * step]
            for item, passage, score in self.candidates(piece):
                first = passage * step
                got = shingle_set(piece[first : first + 2 * step])
                if item not in parts:
                    parts[item] = self.parts(item)
                whole, question, answer = (_share(part, got, piece[first : first + 2 * step]) for part in parts[item])
                both = min(question, answer if parts[item][2] else 1.0)
                if max(whole, both) * DENOMINATOR >= NUMERATOR:
                    best[item] = max(best.get(item, (0.0,) * 4), (score, question, answer, whole))
        return [(self.ids[i], *best[i]) for i in sorted(best, key=lambda i: self.ids[i])]


def _share(part: set, got: set, words: list[bytes]) -> float:
    """Share of a part's shingles among the passage's; a part of fewer than five words must stand there word by word."""
    if not part:
        return 0.0
    short = next(iter(part))
    if len(short) < SHINGLE:
        n = len(short)
        return float(any(tuple(words[i : i + n]) == short for i in range(len(words) - n + 1)))
    return len(part & got) / len(part)


def _words(batches):
    """(part, i, t) -> (part, word, words): each word of an item once; words is the item's length in one of its rows, else 0."""
    for batch in slices(batches):
        parts, found, lengths = [], [], []
        for part, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), strict=True):
            words = words_of(text)
            held = set(words)
            parts += [part] * len(held)
            found += held
            lengths += [len(words), *[0] * (len(held) - 1)] if held else []
        columns = [pa.array(parts, pa.int32()), pa.array(found, pa.binary()), pa.array(lengths, pa.int64())]
        yield pa.record_batch(columns, names=["part", "word", "words"])


def _each_index(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Index]:
    """The indexes over all items one by one, of INDEX_ITEMS items and ITEM_CHARS characters at most in expectation; a longer
    test set gives more of them. Spark counts words and lengths over all items, and each index gets the counts of its words, so
    scores are the same for any number of indexes. Tasks build them, and the driver holds one at a time. Rows of the same id
    and text count once; null texts and ids and texts without words are left out."""
    known = items.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")
    )
    known = known.dropDuplicates(["i", "t"])
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-size // ITEM_CHARS))
    placed = known.select(F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int").alias("part"), "i", "t")
    held = placed.mapInArrow(_words, "part int, word binary, words long").groupBy("part", "word")
    held = held.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("words") > 0).alias("items"),
        F.sum("words").alias("words"),
        F.max("words").alias("most"),
    )
    held = cut(held)
    total, words, most = held.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("items"), F.sum("words"), F.max("most")))).first()
    spread = held.groupBy("word").agg(F.sum("n").alias("spread"))
    spread = held.select("part", "word").join(spread, "word").select("part", "word", "spread")

    def build(group: pa.Table, counted: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("i").to_pylist(), group.column("t").to_pylist(), strict=True))
        known = dict(zip(counted.column("word").to_pylist(), counted.column("spread").to_pylist(), strict=True))
        index = Index(rows, Counts(total, words / max(1, total), most, known))
        return pa.table([group.column("part").slice(0, 1), pa.array([pickle.dumps(index)], pa.binary())], names=["part", "index"])

    built = placed.groupBy("part").cogroup(spread.groupBy("part")).applyInArrow(build, "part int, index binary")
    if parts > 1:
        built = cut(built)
    for part in range(parts):
        for row in bounded_rows(built.where(F.col("part") == part), 1, "indexes of a part"):
            yield pickle.loads(row["index"])


def indexes(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> list[Index]:
    """All indexes at once, for a test set of few; an empty one where there is no item."""
    return list(_each_index(items, id_column, text_column)) or [Index([])]


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap,
    overlap. Every passage of every text is a query; null and empty texts give none, repeated documents repeat their rows.
    Items of equal id and text count once, those of equal id and other text each give theirs. Words are runs of letters and digits without case."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _each_index(items, text_column="text"):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches, held=held):
            for batch in slices(batches):
                got = []
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    got += [(doc, *hit) for hit in held.value.hits(text)]
                columns = list(zip(*got, strict=True)) if got else [[]] * 6
                types = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"],
                )

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item; columns as given. Null texts stay."""
    out, mark = docs, "_clean"
    while mark in docs.columns:
        mark += "_"
    for index in _each_index(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def find(texts, held=held):
            return [[not held.value.hits(t) for t in texts]]

        out = compute(out, text_column, find, {mark: "boolean"}, None, lambda found: found[0]).drop(mark)
    return out
