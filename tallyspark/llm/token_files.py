"""Token ids in Arrow files of equal-length sequences, with zero-copy random access to sequences and masks.

A folder holds, for each range of documents, two Arrow IPC files: `part-N.tokens.arrow` with record batches of two
fixed-size-list columns, `ids` (uint16 where the vocabulary fits, else uint32) and `mask` (uint8, 1 for a token, 0 for padding at the end of the file), and
`part-N.docs.arrow`, the index: doc_id, first token within the file, number of tokens. Every batch but the last of a file has
SEQUENCES_PER_BATCH sequences, so sequence i lies in batch i // SEQUENCES_PER_BATCH.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, cut, slices, texts_of, work_dir

SEQUENCE = 2_048
SEQUENCES_PER_BATCH = 256
CACHE_ENTRIES = 250_000  # words whose ids a worker remembers; only speed depends on it
PIECE_ENTRIES = 600_000  # pieces of words, likewise
MANIFEST_FILES = 2_000_000
DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class WordEncoder:
    """Ids of texts. A tokenizer of the form below lowers case, drops white space and cuts a text into pieces (letters, single
    digits, runs of signs) that don't depend on each other. So a text of Latin letters and signs is cut alike and its pieces
    are looked up in a bounded memory, new ones in the tokenizer's model. Other texts go word by word, as nothing is joined
    across a space. Texts that hold the start of a special token's name, and texts for any other tokenizer, are encoded whole."""

    # The normalizer and the cuts that the piece patterns below repeat.
    NORMALIZERS = [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]
    CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    # One code point for each letter, and case that doesn't depend on neighbours.
    LATIN = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ÿ]*")
    PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_piece = (
            (form["normalizer"] or {}).get("normalizers") == self.NORMALIZERS
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": self.CUTS}, "Removed", True)
            and (cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == (False, False)
            and form["post_processor"] is None
        )
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
        return np.array([t.id for t in found], dtype="<u4").tobytes()

    def _latin(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > PIECE_ENTRIES:
            self.pieces = {}
        found = [self.PIECES.findall(t.lower()) for t in texts]
        self.pieces.update((x, self._piece(x)) for x in set().union(*found).difference(self.pieces))
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in found]

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*parts).difference(self.known)
        latin = [w for w in new if self.LATIN.fullmatch(w)]
        self.known.update(zip(latin, self._latin(latin), strict=True))
        other = list(new.difference(latin))
        for i in range(0, len(other), 4_096):
            self.known.update(zip(other[i : i + 4_096], self._ids(other[i : i + 4_096]), strict=True))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def _way(self, text: str):
        if not self.by_piece or "<|" in text:
            return self._ids
        return self._latin if self.LATIN.fullmatch(text) else self._by_word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ways = [self._way(t) for t in texts]
        found = {way: iter(way([t for t, w in zip(texts, ways, strict=True) if w == way])) for way in set(ways)}
        return [next(found[way]) for way in ways]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


class _Sequences:
    """Collects token bytes and writes full batches of sequences."""

    def __init__(self, sink, length: int, narrow: bool):
        self.kind = "<u2" if narrow else "<u4"
        ids = pa.uint16() if narrow else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.length, self.held, self.parts, self.total = length, 0, [], 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= self.length * SEQUENCES_PER_BATCH:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), dtype="<u4")
        step = self.length * SEQUENCES_PER_BATCH
        upto = len(ids) if last else len(ids) // step * step
        for i in range(0, upto, step):
            some = ids[i : min(i + step, upto)]
            padding = -len(some) % self.length
            mask = np.ones(len(some) + padding, dtype=np.uint8)
            mask[len(some) :] = 0
            some = np.concatenate([some, np.zeros(padding, dtype="<u4")]).astype(self.kind)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (some, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.parts, self.held = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        self._write(True)
        self.writer.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 2,
    sequence: int = SEQUENCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Writes the ids of all texts in ascending order of id (null ids first, equal ids by text) and returns the files:
    file_no, file, n_tokens, n_docs, in that order of numbers. A null text counts as empty: its ids are the end id alone.

    Documents are dealt to files by ranges of their id. A file is written under a name of the attempt and then renamed, so a
    repeated task replaces equal content. A task holds one batch of texts and one batch of sequences.
    """

    def write(batches):
        context = TaskContext.get()
        number = context.partitionId()
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        name = f"{root}/part-{number:06d}"
        temp = f"{root}/_attempt-{number:06d}-{context.taskAttemptId()}"
        encode, n_docs = encoder(tokenizer_path).encode, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        with place.open_output_stream(f"{temp}.tokens") as a, place.open_output_stream(f"{temp}.docs") as b:
            narrow = max(end_id + 1, encoder(tokenizer_path).tokenizer.get_vocab_size()) <= 1 << 16
            sequences = _Sequences(a, sequence, narrow)
            index = pa.ipc.new_file(b, DOCS_SCHEMA)
            for batch in slices(batches):
                firsts, counts, texts = [], [], texts_of(batch.column(1))
                for i in range(0, len(texts), 256):
                    for ids in encode(texts[i : i + 256]):
                        firsts.append(sequences.total)
                        counts.append(len(ids) // 4 + 1)
                        sequences.add(ids + end)
                n_docs += len(texts)
                columns = [batch.column(0).cast(pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())]
                index.write_batch(pa.record_batch(columns, schema=DOCS_SCHEMA))
            sequences.close()
            index.close()
        for kind in ("tokens", "docs"):
            place.move(f"{temp}.{kind}", f"{name}.{kind}.arrow")
        if n_docs:
            yield pa.record_batch(
                {
                    "file_no": pa.array([number], pa.int32()),
                    "file": pa.array([f"{folder.rstrip('/')}/part-{number:06d}"]),
                    "n_tokens": pa.array([sequences.total], pa.int64()),
                    "n_docs": pa.array([n_docs], pa.int64()),
                }
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, "file_no int, file string, n_tokens long, n_docs long"))


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    place, name = _place(path)
    if isinstance(place, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(name))
    return pa.ipc.open_file(place.open_input_file(name))


class SequenceFile:
    """Random access to the sequences of one file. Arrays are views of the mapped file where the file system can map. The last
    batch is kept, so that reading in order fetches each batch once from a store that can't map."""

    def __init__(self, file: str):
        self.reader = _open(f"{file}.tokens.arrow")
        self.batches = self.reader.num_record_batches
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.last = (-1, None)

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of batch i, one row for each sequence."""
        if self.last[0] != i:
            got = self.reader.get_batch(i)
            arrays = tuple(c.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.sequence) for c in got.columns)
            self.last = (i, arrays)
        return self.last[1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // SEQUENCES_PER_BATCH)
        return ids[i % SEQUENCES_PER_BATCH], mask[i % SEQUENCES_PER_BATCH]

    def tokens(self, first: int, count: int):
        """Token ids from first on, in pieces that lie in one batch each."""
        step = self.sequence * SEQUENCES_PER_BATCH
        while count > 0:
            ids = self.batch(first // step)[0].reshape(-1)
            piece = ids[first % step : first % step + count]
            yield piece
            first, count = first + len(piece), count - len(piece)


def read_tokens(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """One row per document of the given (file, tokens before it): doc_id, start, n_tokens, ids_crc32, from the files alone."""

    def read(batches):
        for batch in slices(batches):
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, sequences = _open(f"{file}.docs.arrow"), SequenceFile(file)
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    firsts, counts = (docs.column(k).to_numpy() for k in (1, 2))
                    sums = []
                    for first, count in zip(firsts.tolist(), counts.tolist(), strict=True):
                        crc = 0
                        for piece in sequences.tokens(first, count):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.record_batch(
                        [docs.column(0), pa.array(firsts + before), docs.column(2), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listed = spark.createDataFrame(files, "file string, before long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes all documents and reads them back; what reaches the driver is one row for each file. An empty table gives no
    files and no rows."""
    spark = docs.sparkSession
    files, before = [], 0
    written = write_tokens(docs, folder or work_dir(spark), tokenizer_path, **options)
    for row in bounded_rows(written.orderBy("file_no"), MANIFEST_FILES, "token files"):
        files.append((row["file"], before))
        before += row["n_tokens"]
    return read_tokens(spark, files)
