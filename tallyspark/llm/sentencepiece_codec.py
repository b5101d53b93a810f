"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.common import slices, with_fields

BLANK = "▁"
KNOWN_RUNS = 150_000  # short runs whose ids a worker remembers; only speed depends on it
RUN_CHARS = 512
CELLS = 1 << 19  # characters searched in step
TEXTS = 512
UNKNOWN_PENALTY = 10.0
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabulary:
    """Pieces, their scores and ids of a SentencePiece model file; the file's scores are taken as log-probabilities."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.model = model
        self.texts, self.scores, self.bytes = [], {}, {}
        for i in range(model.piece_size()):
            piece = model.id_to_piece(i)
            self.texts.append("" if model.is_control(i) else piece)
            if model.is_byte(i):
                self.bytes[int(BYTE.fullmatch(piece)[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[piece] = (model.get_score(i), i)
        self.unknown_id = model.unk_id()
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.scores), default=1)
        # no piece has a blank after another character: then every path has a boundary before such a blank
        self.breaks_at_blank = not any(BLANK in p.lstrip(BLANK) for p in self.scores)
        self.byte_of = {i: b for b, i in self.bytes.items()}

    def normalised(self, text: str) -> str:
        return self.model.normalize(text) if text else ""


class StreamingViterbi:
    """Best segmentation of a stream of characters, found with a window.

    Each position keeps the score of its best path and the start of that path's last piece. Only positions within the
    longest piece of the end can begin a new piece; once the paths that lead to them all pass one boundary, the ids before
    it are final: they are given out and the window moves on. Equal scores take the longer last piece.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chars: list[str] = []
        self.best: list[float] = [0.0]
        self.back: list[int] = [0]
        self.piece: list[int] = [-1]

    def _extend(self, char: str) -> None:
        self.chars.append(char)
        end, scores = len(self.chars), self.v.scores
        low = max(0, end - self.v.longest)
        tail = "".join(self.chars[low:])
        top, start, piece = self.best[end - 1] + self.v.unknown, end - 1, -1
        for i in range(end - low):
            found = scores.get(tail[i:])
            if found is not None and self.best[low + i] + found[0] > top:
                top, start, piece = self.best[low + i] + found[0], low + i, found[1]
        self.best.append(top)
        self.back.append(start)
        self.piece.append(piece)

    def _ids(self, upto: int) -> list[int]:
        spans = []
        while upto > 0:
            spans.append(upto)
            upto = self.back[upto]
        out = []
        for end in reversed(spans):
            if self.piece[end] >= 0:
                out.append(self.piece[end])
            else:
                raw = self.chars[end - 1].encode("utf-8", "surrogatepass")
                out += [self.v.bytes.get(b, self.v.unknown_id) for b in raw] if self.v.bytes else [self.v.unknown_id]
        return out

    def _boundary(self) -> int:
        """The last boundary that the best paths to all positions within reach have in common."""
        end = len(self.chars)
        alive = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        return alive.pop()

    def feed(self, text: str) -> list[int]:
        """Takes more characters and returns the ids that have become final."""
        out = []
        for char in text:
            self._extend(char)
            if len(self.chars) % self.v.longest == 0:
                upto = self._boundary()
                if upto > 0:
                    out += self._ids(upto)
                    self.chars = self.chars[upto:]
                    floor = self.best[upto]
                    self.best = [b - floor for b in self.best[upto:]]
                    self.back = [0, *(b - upto for b in self.back[upto + 1 :])]
                    self.piece = [-1, *self.piece[upto + 1 :]]
        return out

    def finish(self) -> list[int]:
        out = self._ids(len(self.chars))
        self.chars, self.best, self.back, self.piece = [], [0.0], [0], [-1]
        return out


class Lanes:
    """The same search for many short runs in step: at step t all runs that long take their t-th character. Pieces are looked
    up by a rolling 64-bit hash in an open-addressing table."""

    BASE, MIX, BITS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.powers = self.BASE ** np.arange(vocabulary.longest + 1, dtype=np.uint64)
        self.scores = np.full(len(vocabulary.texts) + 1, -np.inf)
        slots: dict[int, tuple[int, int]] = {}
        self.probes = 1
        for piece, (score, i) in vocabulary.scores.items():
            self.scores[i] = score
            key = 0
            for c in piece:
                key = (key * int(self.BASE) + ord(c) + 1) % (1 << 64)
            at = key * int(self.MIX) % (1 << 64) >> (64 - self.BITS)
            tries = 1
            while at in slots:
                at, tries = (at + 1) % (1 << self.BITS), tries + 1
            slots[at] = (key, i)
            self.probes = max(self.probes, tries)
        # ids of characters without a piece that are one byte long; others stay -1
        self.single = np.array([vocabulary.bytes.get(b, -1) for b in range(128)] + [-1], dtype=np.int32)
        self.keys = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.ids = np.full(1 << self.BITS, -1, dtype=np.int32)
        for at, (key, i) in slots.items():
            self.keys[at], self.ids[at] = key, i

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * self.MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.ids[at], -1)
        for _ in range(1, self.probes):
            at = (at + 1) & ((1 << self.BITS) - 1)
            out = np.where(self.keys[at] == keys, self.ids[at], out)
        return out

    def segment(self, runs: list[str]) -> list[bytes | None]:
        """Little-endian 32-bit ids of each run; None where the best path has a character that takes several byte pieces."""
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        lengths = np.array([len(runs[k]) for k in order])
        longest = int(lengths[0])
        chars = np.array([runs[k] for k in order], dtype=f"U{longest}").view(np.uint32).reshape(len(runs), longest)
        n, reach = len(runs), self.v.longest
        hashes = np.zeros((longest + 1, n), dtype=np.uint64)
        best = np.zeros((longest + 1, n))
        step = np.ones((longest + 1, n), dtype=np.int16)
        piece = np.full((longest + 1, n), -1, dtype=np.int32)
        for t in range(1, longest + 1):
            m = int(np.searchsorted(-lengths, -t, side="right"))
            hashes[t, :m] = hashes[t - 1, :m] * self.BASE + chars[:m, t - 1].astype(np.uint64) + np.uint64(1)
            top = best[t - 1, :m] + self.v.unknown
            piece[t, :m] = self.single[np.minimum(chars[:m, t - 1], 128)]
            for size in range(min(reach, t), 0, -1):
                found = self._lookup(hashes[t, :m] - hashes[t - size, :m] * self.powers[size])
                at = np.flatnonzero(found >= 0)
                score = best[t - size, at] + self.scores[found[at]]
                better = score > top[at]
                at = at[better]
                top[at], step[t, at], piece[t, at] = score[better], size, found[at]
            best[t, :m] = top
        ids = np.empty((n, longest), dtype="<i4")  # filled from the right
        place, count = lengths.copy(), np.zeros(n, dtype=np.int64)
        broken = np.zeros(n, dtype=bool)
        live = np.arange(n)
        while len(live):
            here = piece[place[live], live]
            broken[live] |= here < 0
            count[live] += 1
            ids[live, longest - count[live]] = here
            place[live] -= step[place[live], live]
            live = live[place[live] > 0]
        raw, width = ids.tobytes(), 4 * longest
        out: list[bytes | None] = [None] * n
        for row, k in enumerate(order):
            if not broken[row]:
                end = (row + 1) * width
                out[k] = raw[end - 4 * int(count[row]) : end]
        return out


class Codec:
    """Encodes and decodes texts. Where the vocabulary makes all paths meet before a blank, a text is cut there: each run is a
    stream of its own, short runs go in step, and runs seen before come from a bounded memory. Else a text is one stream."""

    RUNS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.lanes = Lanes(self.v)
        byte_of = self.v.byte_of
        self.texts = [chr(byte_of[i]) if byte_of.get(i, 128) < 128 else t for i, t in enumerate(self.v.texts)]
        self.many = np.array([byte_of.get(i, 0) >= 128 for i in range(len(self.texts))])  # parts of longer characters
        self.known: dict[str, bytes] = {}

    def _stream(self, run: str) -> bytes:
        search = StreamingViterbi(self.v)
        return np.array(search.feed(run) + search.finish(), dtype="<i4").tobytes()

    def _runs(self, text: str) -> list[str]:
        """Runs of a text without the blank they begin with, where that is one; else with all their blanks."""
        if not text:
            return []
        if BLANK + BLANK not in text and text[0] == BLANK and text[-1] != BLANK:
            return text[1:].split(BLANK)
        return [r[1:] if r[0] == BLANK and r[1:2] not in (BLANK, "") else BLANK + r for r in self.RUNS.findall(text)]

    def _learn(self, runs: list[str]) -> list[str]:
        """Remembers the ids of new runs; returns the long ones, which are to be forgotten after use."""
        short = []
        for r in runs:
            if len(r) <= RUN_CHARS:
                short.append(r)
            else:
                self.known[r] = self._stream(self._whole(r))
        short.sort(key=len)
        while short:
            some = short[-max(1, CELLS // (len(short[-1]) + 1)) :]
            del short[-len(some) :]
            for r, ids in zip(some, self.lanes.segment([self._whole(r) for r in some]), strict=True):
                self.known[r] = self._stream(self._whole(r)) if ids is None else ids
        return [r for r in runs if len(r) > RUN_CHARS]

    @staticmethod
    def _whole(run: str) -> str:
        """A run as it stands in the text: names that begin with a blank have one too many, others one too few."""
        return run[1:] if run[0] == BLANK else BLANK + run

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        texts = [self.v.normalised(t) for t in texts]
        if not self.v.breaks_at_blank:
            return [np.frombuffer(self._stream(t), dtype="<i4") for t in texts]
        out = []
        for k in range(0, len(texts), TEXTS):
            runs = [self._runs(t) for t in texts[k : k + TEXTS]]
            if len(self.known) > KNOWN_RUNS:
                self.known = {}
            known = self.known
            long = self._learn(list({r for some in runs for r in some if r not in known}))
            out += [np.frombuffer(b"".join([known[r] for r in some]), dtype="<i4") for some in runs]
            for r in long:
                del known[r]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes put together, blanks restored, without the blank the model puts first."""
        if self.many[ids].any():
            byte_of, raw = self.v.byte_of, bytearray()
            for i in ids.tolist():
                raw += bytes([byte_of[i]]) if i in byte_of else self.v.texts[i].encode("utf-8", "surrogatepass")
            text = raw.decode("utf-8", "replace")
        else:
            texts = self.texts
            text = "".join([texts[i] for i in ids.tolist()])
        return text.replace(BLANK, " ").removeprefix(" ")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """docs with the ids of the whole text as an array (a column of that name is replaced). A null text has null ids, an
    empty one none; repeated rows repeat their result."""
    docs = docs.drop(ids_column)

    def work(batches):
        for batch in slices(batches):
            tool = codec(model_path)
            texts = batch.column(text_column).to_pylist()
            found = iter(tool.encode([t for t in texts if t is not None]))
            ids = [None if t is None else next(found) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_column]
            )

    return docs.mapInArrow(work, with_fields(docs, **{ids_column: "array<int>"}))


def decode(rows: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """rows with the text of their ids (a column of that name is replaced). Null ids give a null text, no ids an empty one."""
    rows = rows.drop(text_column)

    def work(batches):
        for batch in slices(batches):
            tool, column = codec(model_path), batch.column(ids_column)
            flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            absent = column.is_null().to_pylist()
            texts = [None if absent[i] else tool.decode(flat[edges[i] : edges[i + 1]]) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_column]
            )

    return rows.mapInArrow(work, with_fields(rows, **{text_column: "string"}))

