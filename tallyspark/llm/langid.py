"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, compute, cut, slices, texts_of

PROFILE = 400  # n-grams of a profile, for languages and for documents
LANGUAGES = 1_000  # more distinct values than that are not languages
NOT_LETTERS = re.compile(r"[\W\d_]+")
POINT_BITS = np.uint64(21)  # a code point fits, so three of them fit into one integer without collision
BATCH_CHARS = 1 << 20


def letters_only(text: str) -> str:
    """Lower case, every run of other characters than letters as one space, padded with one space. "" without a letter."""
    out = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {out} " if any(map(str.isalpha, out)) else ""  # the pattern passes numbers like "½" too


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of a padded text, without those that hold an inner space and without lone spaces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    space = points == 32
    two = (points[:-1] << POINT_BITS) | points[1:]
    three = (two[:-1] << POINT_BITS) | points[2:]
    return np.concatenate([points[~space], two[~(space[:-1] & space[1:])], three[~space[1:-1]]])


def ranked(text: str, most: int) -> np.ndarray:
    """The most frequent n-grams in order of rank; equal counts in order of code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    if len(codes) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    """Rank tables of the learned languages, in alphabetical order of their names."""

    def __init__(self, ranks: dict[str, list[int]], most: int = PROFILE):
        self.names, self.most, self.tables = sorted(ranks), most, []
        for name in self.names:
            codes = np.array(ranks[name], dtype=np.uint64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language: differences of rank, and `most` for an n-gram that it lacks."""
        out = np.empty(len(self.tables))
        place = np.arange(len(mine))
        for k, (codes, ranks) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            out[k] = np.where(codes[at] == mine, np.abs(ranks[at] - place), self.most).sum()
        return out

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score): score is 1 minus the distance over the largest possible one. Ties go to the first name."""
        padded = letters_only(text)
        if not padded or not self.tables:
            return "und", 0.0
        mine = ranked(padded, self.most)
        found = self.distances(mine)
        best = int(np.argmin(found))
        return self.names[best], float(1.0 - found[best] / (self.most * len(mine)))


def _count_grams(batches):
    """(lang, gram, n) of one partition, each gram of a language once for about a million characters."""
    for batch in slices(batches):
        texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
        waiting: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def flush(lang, waiting=waiting, sizes=sizes):
            codes, counts = np.unique(grams(" ".join(waiting.pop(lang))), return_counts=True)
            sizes[lang] = 0
            return pa.record_batch(
                {
                    "lang": pa.array([lang] * len(codes)),
                    "gram": pa.array(codes.astype(np.int64)),
                    "n": pa.array(counts.astype(np.int64)),
                }
            )

        for text, lang in zip(texts, langs, strict=True):
            padded = letters_only(text)
            if padded:
                waiting.setdefault(lang, []).append(padded[1:-1])
                sizes[lang] = sizes.get(lang, 0) + len(padded)
                if sizes[lang] > BATCH_CHARS:
                    waiting[lang][0] = " " + waiting[lang][0]
                    waiting[lang][-1] += " "
                    yield flush(lang)
        for lang in list(waiting):
            waiting[lang][0] = " " + waiting[lang][0]
            waiting[lang][-1] += " "
            yield flush(lang)


def learn(docs: DataFrame, most: int = PROFILE, text_column: str = "text", lang_column: str = "lang") -> Profiles:
    """Profiles of all languages named in docs, from the counts of every n-gram of every text. Null texts and languages are
    left out. What reaches the driver is `most` n-grams for each language."""
    known = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    counts = (
        known.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = "row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place"
    top = cut(counts).selectExpr("*", order).where(F.col("place") <= most)
    ranks: dict[str, list[int]] = {}
    for row in bounded_rows(top.orderBy("lang", "place"), most * LANGUAGES, "language profiles"):
        ranks.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(ranks, most)


def identify(
    docs: DataFrame,
    profiles: Profiles,
    text_column: str = "text",
    keep: Sequence[str] | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """docs (its columns of keep) with lang_pred and score; columns of these names are replaced. A text that is null or has
    no letter gets "und" and 0; texts are read whole. With min_score, only texts in one of the learned languages stay: those
    with a letter that are not as far as that from every profile."""

    def work(texts):
        return [list(c) for c in zip(*map(profiles.predict, texts), strict=True)] if texts else [[], []]

    def accepted(found):
        return [lang != "und" and score >= min_score for lang, score in zip(*found, strict=True)]

    fields = {"lang_pred": "string", "score": "double"}
    return compute(docs, text_column, work, fields, keep, None if min_score is None else accepted)
