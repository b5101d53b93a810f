"""License scans: exact phrases, and a fuzzy search for short notices by exact seeds and bounded-error matching."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, texts_of

# The exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices that are searched with errors, in the words of the licenses themselves.
NOTICES = {
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
CHARS_PER_ERROR = 8  # a notice may have one edit for each so many characters
# A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; everything else becomes a blank.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Scanner:
    """Searches word runs. A notice of up to k edits, cut into k + 1 pieces, holds one piece unchanged; such seeds are found
    by one automaton over the text, and only around them the bounded-error pattern is tried."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], chars_per_error: int = CHARS_PER_ERROR):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices, self.seeds = [], ahocorasick.Automaton()
        hits: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, label) in enumerate(notices.items()):
            errors = len(phrase) // chars_per_error
            pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase)}){{e<={errors}}}(?![^ ])")
            self.notices.append((phrase, label, errors, pattern))
            edges = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                hits.setdefault(phrase[a:b], []).append((n, a))
        for seed, places in hits.items():
            self.seeds.add_word(seed, (len(seed), places))
        if hits:
            self.seeds.make_automaton()

    def exact(self, folded: bytes) -> list[tuple[int, str]]:
        """(first word, label) of each place of a base phrase."""
        out = []
        for phrase, label in self.base:
            at = folded.find(phrase)
            word, before = 0, 0
            while at >= 0:
                word += folded.count(b" ", before, at)
                before = at
                out.append((word, label))
                at = folded.find(phrase, at + 1)
        return sorted(out)

    def fuzzy(self, text: str) -> list[dict]:
        """Places of notices: label, first_word, last_word, errors, similarity. Where notices overlap, one with more errors
        than another goes."""
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.seeds.iter(text) if len(self.seeds) else ():
            for n, offset in places:
                starts.setdefault(n, set()).add(end - size + 1 - offset)
        matches = []
        for n, begins in starts.items():
            phrase, _, errors, pattern = self.notices[n]
            spans = set()
            # each seed's window by itself: the best match of a longer stretch would hide other places before it
            for start in begins:
                low, high = max(0, start - errors - 1), min(start + len(phrase) + errors + 1, len(text))
                spans.update((sum(m.fuzzy_counts), *m.span()) for m in pattern.finditer(text, low, high))
            matches += [(low, n, e, text[low:high].strip().count(" ")) for e, low, high in _apart(spans)]
        found, first, before = [], 0, 0
        for start, n, errors, blanks in sorted(matches):
            first += text.count(" ", before, start)
            before = start
            phrase, label, _, _ = self.notices[n]
            found.append(
                {
                    "label": label,
                    "first_word": first - 1,
                    "last_word": first - 1 + blanks,
                    "errors": errors,
                    "similarity": 1.0 - errors / len(phrase),
                }
            )
        found.sort(key=lambda f: (f["first_word"], f["last_word"], f["label"]))
        firsts = [f["first_word"] for f in found]
        longest = max((f["last_word"] - f["first_word"] for f in found), default=0)

        def beaten(f: dict) -> bool:
            near = found[bisect_left(firsts, f["first_word"] - longest) : bisect_right(firsts, f["last_word"])]
            return any(g["errors"] < f["errors"] and _overlap(f, g) for g in near)

        return [f for f in found if not beaten(f)]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[dict]]:
        """(number of words, base places, notices) of a whole text."""
        words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
        folded = b" " + b" ".join(words) + b" " if words else b""
        return len(words), self.exact(folded), self.fuzzy(folded.decode("utf-8", "surrogatepass"))


def _apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (errors, start, end) of one notice those that overlap none with fewer errors, or as many and an earlier start."""
    kept: list[tuple[int, int]] = []
    out = []
    for errors, start, end in sorted(spans):
        at = bisect_left(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            kept.insert(at, (start, end))
            out.append((errors, start, end))
    return out


def _overlap(f: dict, g: dict) -> bool:
    return f["first_word"] <= g["last_word"] and g["first_word"] <= f["last_word"]


@lru_cache(4)
def scanner(base: tuple, notices: tuple, chars_per_error: int) -> Scanner:
    return Scanner(dict(base), dict(notices), chars_per_error)


SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label: string, first_word: long, last_word: long, errors: int, similarity: double>>"
)


def scan(
    docs: DataFrame,
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    chars_per_error: int = CHARS_PER_ERROR,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each document: its id, the number of words, places of base phrases (count, smallest and largest first
    word), labels, score and the notices found with their spans.

    Words count from 0 and are runs of letters, digits and non-ASCII characters, A-Z in lower case; texts are read whole.
    score is the best similarity: 1 where a base phrase or an unchanged notice stands, 0 where nothing is found. A null or
    empty text has no words, null places and empty labels; repeated rows repeat their result.
    """
    chosen = (tuple((BASE if base is None else base).items()), tuple((NOTICES if notices is None else notices).items()))
    names = [f.split()[0] for f in SCAN.split(", ")[:7]] + ["notices"]

    def work(batches):
        tool = scanner(*chosen, chars_per_error)
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch.column(1)):
                n, places, found = tool.scan(text)
                base_labels = sorted({label for _, label in places})
                labels = sorted({*base_labels, *(f["label"] for f in found)})
                ends = (places[0][0], places[-1][0]) if places else (None, None)
                score = 1.0 if places else max((f["similarity"] for f in found), default=0.0)
                rows.append((n, len(places), *ends, ",".join(base_labels), ",".join(labels), score, found))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            found_type = pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("first_word", pa.int64()),
                        ("last_word", pa.int64()),
                        ("errors", pa.int32()),
                        ("similarity", pa.float64()),
                    ]
                )
            )
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), found_type]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_column, *names])

    rows = docs.select(id_column, F.col(text_column).alias("_text"))
    kind = dict(docs.dtypes)[id_column]
    return rows.mapInArrow(work, f"`{id_column}` {kind}, {SCAN}")
