"""Repair of the structure of conversations: the cheapest edits that make the roles alternate, by branch-and-bound.

A conversation is well formed when its rows' role initials read `(s?(ua)+)?`: perhaps a system row, then user and assistant
in turns. Rows are kept, given another role, deleted or inserted, each at a price. The search sees one byte a row (its
initial and its fault), so texts are shuffled only to apply the edits found.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, with_fields

WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
WINDOW = 1 << 16  # rows that the search holds at once
BATCH = 8_192

# Prices of the edits; an undeleted truncated row costs TRUNCATED on top.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Fault of a row, of which the first that applies counts.
SOUND, CUT_OFF, DUPLICATE, BLANK = range(4)
# What stands so far: nothing, the system row, an open user row, whole pairs. The next row must be `WANTED`.
START, SYSTEM, USER, PAIRS = range(4)
WANTED = "uuau"
AFTER = {"s": SYSTEM, "u": USER, "a": PAIRS}


Row = tuple[str, int]  # initial of the role (`?` for any but s, u, a), fault


# --- the search -------------------------------------------------------------------------------------------------------
def moves(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, price, next state) of what may happen to the next row, in ASCII order of the edits."""
    out = [("D", DELETE, state)]
    if fault < DUPLICATE:
        extra = TRUNCATED if fault == CUT_OFF else 0
        wanted = WANTED[state]
        if initial == wanted or (initial == "s" and state == START):
            out.append(("K", extra, AFTER[initial]))
        if initial != wanted:
            out.append(("R", REROLE + extra, AFTER[wanted]))
    return out


TABLE = {(i, f): [moves(i, f, s) for s in range(4)] for i in "sua?" for f in range(4)}


def suffix_bounds(rows: list[Row], goals: tuple[int, ...], closing: bool) -> array:
    """At 4 * row + state: the least price of the rest, which no completion undercuts. Rows may be inserted behind the last
    one only when closing."""
    n, far = len(rows), 1 << 30
    bounds = array("l", bytes(8 * 4 * (n + 1)))
    here = [0 if state in goals else far for state in range(4)]
    for i in range(n, -1, -1):
        if i < n:
            options, at = TABLE[rows[i]], 4 * i + 4
            here = [min([price + bounds[at + to] for _, price, to in options[state]]) for state in range(4)]
        if i < n or closing:
            here[USER] = min(here[USER], here[PAIRS] + INSERT)
            for state in (START, SYSTEM, PAIRS):
                here[state] = min(here[state], here[USER] + INSERT)
        bounds[4 * i : 4 * i + 4] = array("l", here)
    return bounds


def search(rows: list[Row], roots: list[tuple[int, int]], goals: tuple[int, ...], closing: bool) -> tuple[int, int, str] | None:
    """(price, root, edits) of the cheapest way through the rows to one of the goal states, of equally cheap ones the
    ASCII-least; None if there is none. roots: (price so far, state), in ASCII order of the edits so far.

    Depth-first, in ASCII order, on an explicit stack. A prefix is left when its price plus the suffix bound exceeds the
    incumbent's price, or reaches it once the search itself has found the incumbent (what comes later is ASCII-greater), and
    when an earlier prefix came to the same row and state no dearer, as that one is better in every completion. The first
    incumbent's price is that of a descent along the bounds. The empty stack proves the incumbent the best.
    """
    n, bounds = len(rows), suffix_bounds(rows, goals, closing)

    def steps(i: int, state: int) -> list[tuple[str, int, int, int]]:
        out = [(edit, price, i + 1, to) for edit, price, to in TABLE[rows[i]][state]] if i < n else []
        if i < n or closing:
            out.insert(len(out[:1]), ("I", INSERT, i, AFTER[WANTED[state]]))
        return out

    price, state = min(roots, key=lambda r: r[0] + bounds[r[1]])
    if price + bounds[state] >= 1 << 30:
        return None
    i = 0
    while i < n or state not in goals:
        _, more, i, state = min(steps(i, state), key=lambda s: s[1] + bounds[4 * s[2] + s[3]])
        price += more
    limit, best = price, None
    reached = array("l", [-1]) * (4 * (n + 1))  # dominance table: least price at each row and state
    path: list[str] = []  # the root, then the edits on the way to the node in hand
    stack = [(0, state, price, 0, k) for k, (price, state) in reversed(list(enumerate(roots)))]
    while stack:
        i, state, price, depth, edit = stack.pop()
        del path[depth:]
        path.append(edit)
        node = 4 * i + state
        at_least = price + bounds[node]
        if at_least > limit or (best and at_least == limit) or 0 <= reached[node] <= price:
            continue
        reached[node] = price
        if i == n and state in goals:
            limit, best = price, (price, path[0], "".join(path[1:]))
            continue
        for edit, more, row, to in reversed(steps(i, state)):
            stack.append((row, to, price + more, depth + 1, edit))
    return best


class Search:
    """The cheapest repair of rows that arrive one after the other, at most `window` of them held. At the end of a window the
    best way to each state is kept; no edits of one are a prefix of another's there, so their order holds for good."""

    def __init__(self, window: int = WINDOW):
        self.window, self.rows = window, []
        self.roots: list[tuple[int, int]] = [(0, START)]
        self.chains: list[tuple] = [()]  # edits of each root, as (earlier edits, last piece)

    def add(self, row: Row) -> None:
        if len(self.rows) == self.window:
            found = [(s, search(self.rows, self.roots, (s,), closing=False)) for s in range(4)]
            found = sorted((way[1], way[2], way[0], s) for s, way in found if way)
            self.roots = [(price, s) for _, _, price, s in found]
            self.chains = [(self.chains[root], edits) for root, edits, _, _ in found]
            self.rows = []
        self.rows.append(row)

    def finish(self) -> tuple[int, str]:
        price, root, edits = search(self.rows, self.roots, (START, PAIRS), closing=True)
        pieces, chain = [edits], self.chains[root]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return price, "".join(reversed(pieces))


def cheapest(rows: Iterable[Row], window: int = WINDOW) -> tuple[int, str]:
    """(price, edits) of the cheapest repair, of equally cheap ones the ASCII-least. Memory besides the edits: one window."""
    running = Search(window)
    for row in rows:
        running.add(row)
    return running.finish()


# --- conversations as tables ------------------------------------------------------------------------------------------
def filled(name: str) -> Column:
    """A column as text; nulls count as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows, damaged by a hash of conversation and turn: some go, lose their text or
    the ends of their sentences, stand there twice or change role."""
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text, role = filled("text"), filled("role")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
    )


def with_row_key(rows: DataFrame) -> DataFrame:
    """Adds `key`, which tells conversation, turn, role and text, and `said`, which tells role and text."""
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    where = F.to_json(F.struct(filled("conv_id").alias("c"), F.col("conv_id").isNull().alias("m"), filled("turn").alias("t"), F.col("turn").isNull().alias("n")))
    rows = rows.withColumn("said", said)
    return rows.withColumn("key", F.unhex(F.sha2(F.concat(where.cast("binary"), F.col("said")), 256)))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows without their texts: conv_id, turn, role, fault, key and pos, their number in the conversation from 0. The
    order is by turn, rows without one first; ties by role, then by a digest of the text."""
    end = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    narrow = rows.select("conv_id", "turn", "role", "said", "key", end.alias("end"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    by_turn = F.col("turn").asc_nulls_first()
    earlier = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy(by_turn)) > 1
    fault = F.when(F.col("end") == "", BLANK).when(earlier, DUPLICATE).when(~F.col("end").isin(*ENDS), CUT_OFF).otherwise(SOUND)
    # Of equal rows the one that counts as first must come first: the fault orders them.
    place = Window.partitionBy("conv_id").orderBy(by_turn, "role", "said", "fault")
    return narrow.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "fault", "key", (F.row_number().over(place) - 1).cast("long").alias("pos")
    )


FIELDS = {c: "long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "string", "leads": "boolean"}


class _Conversation:
    """Counts and search of one conversation, row by row. Held besides the search: one byte a row, as in the edits."""

    def __init__(self, conv_id):
        self.id, self.search, self.last = conv_id, Search(), None
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.initials = bytearray()

    def add(self, turn, initial: str, fault: int) -> None:
        if turn is not None:
            if self.turn is None or turn != self.turn:
                self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.faults[fault] += 1
        kind = initial if initial in AFTER else "?"
        self.initials += kind.encode()
        self.search.add((kind, fault))

    def finish(self) -> tuple:
        cost, audit = self.search.finish()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        stays = len(audit) - len(audit.lstrip("D"))
        leads = audit[stays : stays + 1] == "K" and self.initials[stays] == ord("s")
        return (self.id, gaps, *(self.faults[f] for f in (BLANK, DUPLICATE, CUT_OFF)), self.illegal, cost, audit, leads)


def plan(rows: DataFrame) -> DataFrame:
    """For each conversation of numbered rows: its gaps, faults and illegal neighbours, the cost and the edits (audit) of the
    cheapest repair, and whether a system row leads then. Rows, without texts, are sorted by conversation and streamed; a
    task holds one window of them and the edits, which are one cell of the result. The order makes a conversation one chain."""
    schema = with_fields(rows.select("conv_id"), **FIELDS)
    sent = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", "pos")

    def results(done: list[_Conversation], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*(c.finish() for c in done), strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or conv != now.id:
                    done += [now] if now else []
                    now = _Conversation(conv)
                now.add(turn, initial, fault)
                if len(done) == BATCH:
                    yield results(done, kind)
                    done = []
        done += [now] if now else []
        if done:
            yield results(done, kind)

    return sent.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)


def edits(plans: DataFrame) -> DataFrame:
    """The edits as rows: conv_id, step (from 0), edit (K, R, D, I), pos of the row in hand (null for an inserted one) and
    new_role (of rows inserted or given another role). Long audits are dealt with in pieces."""
    schema = with_fields(plans.select("conv_id"), step="long", edit="string", pos="long", new_role="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (audit, leads) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                row = stays = 0
                for start in range(0, len(audit), BATCH):
                    piece = np.frombuffer(audit[start : start + BATCH].encode(), dtype="S1")
                    own, stay = piece != b"I", piece != b"D"
                    pos, order = row + np.cumsum(own) - 1, stays + np.cumsum(stay) - 1 - int(leads)
                    row, stays = row + int(own.sum()), stays + int(stay.sum())
                    new = (piece == b"I") | (piece == b"R")
                    roles = np.where(order % 2 == 0, "user", "assistant").astype(object)
                    yield pa.record_batch(
                        [
                            pa.repeat(batch.column(0)[k], len(piece)),
                            pa.array(np.arange(start, start + len(piece))),
                            pa.array(piece.astype(str).astype(object), pa.string()),
                            pa.array(pos, mask=~own),
                            pa.array(roles, pa.string(), mask=~new),
                        ],
                        names=schema.names,
                    )

    return plans.select("conv_id", "audit", "leads").mapInArrow(run, schema)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; null meets null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*(f"_{k}" for k in keys))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, repaired rows) of conversations given as conv_id, turn, role, text, copies (see damaged), none null but
    conv_id and turn. Other columns are not read.

    summaries: see plan; a conversation is there if it has a row. repaired: conv_id, step, edit, role, text of the rows that
    stay, in the order of step. Conversations without id are one conversation; rows without turn come first; equal turns are
    ordered by role and text, so equal rows stand together and all but the first count as duplicates. Role and text are told
    apart by SHA-256.

    The search runs on rows without texts; those are written to the shared folder. Each text is then looked up by the key
    of its row, so that a long conversation is spread over all tasks.
    """
    keyed = with_row_key(rows)
    narrow = cut(numbered(keyed))
    plans = cut(plan(narrow))
    staying = edits(plans).where("edit <> 'D'")
    old = joined(staying.where("edit <> 'I'"), narrow.select("conv_id", "pos", "key", "role"), ["conv_id", "pos"])
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    old = old.join(texts, "key").select("conv_id", "step", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    new = staying.where("edit = 'I'").select("conv_id", "step", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return plans.drop("leads"), old.unionByName(new)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of the conversation's `role:text`, newline-joined in the order of step. The hash of a conversation is
    one chain by nature: its rows are streamed in order, and only the state of the hash is held."""
    schema = with_fields(repaired.select("conv_id"), sha256="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, ids, found = None, None, [], []
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        ids, found = [*ids, now], [*found, state.hexdigest()]
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array(ids, kind), pa.array(found, pa.string())], names=schema.names)
            ids, found = [], []
        if state is not None:
            yield pa.record_batch([pa.array([now], kind), pa.array([state.hexdigest()])], names=schema.names)

    rows = repaired.select("conv_id", "step", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "step").mapInArrow(run, schema)
