"""Jaccard join of documents on word shingles, with prefix filters under several global token orders.

Documents with equal shingle sets form a class. A class's shingles are put in several global orders: all orders put rare
shingles first and differ in how they break ties. Two sets of similarity t or more share a shingle within their prefixes
under EVERY order, so only pairs that do are verified. Dense groups are settled by comparing with one hub for each shingle
first; later only pairs that lie in different components are formed, or compared in tiles where a list is long. That gives the components. All links lie inside
components, so with_links then compares every two classes of each component and counts.
"""

from __future__ import annotations

from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, components, cut, find_roots, slices, splitmix

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
ORDERS = 3
ALL = (1 << ORDERS) - 1
HUB_ROUNDS = 1
LIST_PAIRS = 4_096  # a shingle whose list would give more pairs is settled in tiles instead
TILE = 1_024
TILE_ITEMS = 2_000_000  # shingles of a tile of a component, and of a bucket of small components, in expectation
COMMON = 32  # shingles of more rows than that are counted by a matrix product
COUNTERS = 1 << 16  # counters of the frequency sketch
GROUP_TOKENS = 1_000_000  # shingles of a counting group
FLUSH_TOKENS = 500_000
BITMAP_BITS = 1 << 24
KNOWN_WORDS = 120_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_KNOWN = _WordHashes()


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. Words are runs of other characters than the ASCII blanks, with
    A-Z in lower case. Fewer words than k make one shingle; no words make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(k, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        h = splitmix(h ^ w[i : i + n])
    return np.unique(h)


def fingerprint(h: np.ndarray) -> int:
    """A 64-bit hash of a whole set, as a signed number."""
    mixed = splitmix(h ^ np.uint64(0x5851F42D4C957F2D))
    total = np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(h))], dtype=np.uint64)
    return int(splitmix(splitmix(total) ^ np.bitwise_xor.reduce(mixed))[0].view(np.int64))


def _profile(batches):
    """One row for each document (doc_id, n, fp) and, at the end, the partition's counters (slot, count)."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    seen: set[int] = set()
    for batch in slices(batches):
        sizes, prints = [], []
        for text in batch.column(1).to_pylist():
            h = shingles(text)
            sizes.append(len(h))
            prints.append(fingerprint(h) if len(h) else None)
            if len(h) and prints[-1] not in seen:
                if len(seen) < KNOWN_WORDS:
                    seen.add(prints[-1])
                counts += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        none = pa.nulls(len(sizes), pa.int64())
        yield pa.record_batch(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.nulls(len(sizes), pa.int32()), none],
            names=["doc_id", "n", "fp", "slot", "count"],
        )
    used = np.flatnonzero(counts)
    none = pa.nulls(len(used), pa.int64())
    yield pa.record_batch(
        [none, none, none, pa.array(used, pa.int32()), pa.array(counts[used])], names=["doc_id", "n", "fp", "slot", "count"]
    )


def _order_keys(tokens: np.ndarray, order: int) -> np.ndarray:
    return splitmix(tokens.astype(np.uint64) ^ np.uint64(0x1234567 * (order + 1)))


def _prefix_masks(tokens: np.ndarray, weights: np.ndarray, take: int) -> np.ndarray:
    """For each token a bit for every order in which it is among the first `take` by (weight, order's own key)."""
    if take >= len(tokens):
        return np.full(len(tokens), ALL, dtype=np.int32)
    masks = np.zeros(len(tokens), dtype=np.int32)
    for order in range(ORDERS):
        masks[np.lexsort((_order_keys(tokens, order), weights))[:take]] |= 1 << order
    return masks


class _Exchange:
    """Collects documents' tokens and cuts them by group: `bits` leading bits of the token choose it."""

    def __init__(self, bits: int):
        self.bits, self.docs, self.tokens, self.held = bits, [], [], 0

    def add(self, fp: int, n: int, base: int, tokens: np.ndarray) -> None:
        self.docs.append((fp, n, base, len(tokens)))
        self.tokens.append(tokens)
        self.held += len(tokens)

    def flush(self):
        if not self.docs:
            return
        fps, ns, bases, lengths = (np.array(c, dtype=np.int64) for c in zip(*self.docs, strict=True))
        tokens = np.concatenate(self.tokens)
        group = (tokens >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(tokens), dtype=np.int64)
        owner = np.repeat(np.arange(len(fps)), lengths)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange((1 << self.bits) + 1))
        rows = []
        for g in np.flatnonzero(np.diff(edges)):
            at = order[edges[g] : edges[g + 1]]
            docs, counts = np.unique(owner[at], return_counts=True)
            rows.append(
                (
                    int(g),
                    fps[docs].tobytes(),
                    ns[docs].astype(np.int32).tobytes(),
                    bases[docs].astype(np.int32).tobytes(),
                    counts.astype(np.int32).tobytes(),
                    (tokens[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    None,
                )
            )
        self.docs, self.tokens, self.held = [], [], 0
        yield _exchange_rows(rows)


EXCHANGE = "grp int, fps binary, ns binary, bases binary, counts binary, tokens binary, masks binary"
SHARED = "fp long, token long, freq long, n int, base int, mask int"


def _exchange_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = ["grp", "fps", "ns", "bases", "counts", "tokens", "masks"]
    return pa.record_batch([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], names=names)


def _dealer(levels: np.ndarray, bits: int):
    """Deals the tokens of classes to counting groups. levels: the sketch's count where a counter is hot, else 0. Hot tokens
    come last in every order and stay here: those that fall into a prefix go on at once, with their masks."""

    def deal(batches):
        exchange, seen, ready = _Exchange(bits), set(), []
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                h = shingles(text)
                if not len(h):
                    continue
                fp = fingerprint(h)
                if fp in seen:
                    continue
                if len(seen) < KNOWN_WORDS:
                    seen.add(fp)
                n = len(h)
                prefix = n - -(-NUMERATOR * n // DENOMINATOR) + 1
                level = levels[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                plain = h[level == 0]
                exchange.add(fp, n, prefix - len(plain), plain)
                if prefix > len(plain):
                    hot = h[level > 0]
                    masks = _prefix_masks(hot, level[level > 0], prefix - len(plain))
                    ready.append((fp, n, token_ids(hot[masks > 0], bits), masks[masks > 0], prefix - len(plain)))
                if exchange.held >= FLUSH_TOKENS:
                    yield from exchange.flush()
                if len(ready) >= 1_000:
                    yield _ready_rows(ready)
                    ready = []
        yield from exchange.flush()
        if ready:
            yield _ready_rows(ready)

    return deal


def _ready_rows(ready: list[tuple]) -> pa.RecordBatch:
    rows = []
    for part in range(64):
        some = [r for r in ready if r[0] % 64 == part]
        if some:
            fps, ns = np.array([r[0] for r in some]), np.array([r[1] for r in some], dtype=np.int32)
            counts = np.array([len(r[2]) for r in some], dtype=np.int32)
            bases = np.array([r[4] for r in some], dtype=np.int32)
            tokens, masks = (np.concatenate([r[i] for r in some]) for i in (2, 3))
            columns = (fps, ns, bases, counts, tokens, masks)
            rows.append((-1 - part, *(c.tobytes() for c in columns)))
    return _exchange_rows(rows)


def token_ids(h: np.ndarray, bits: int) -> np.ndarray:
    """The group and the low 32 bits of hashes as one signed number. Two shingles that fall together only widen the search."""
    group = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), dtype=np.uint64)
    return ((group << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _shared_tokens(group: pa.Table) -> pa.Table:
    """Of one counting group, the tokens that at least two classes have, with their exact frequency."""
    number = group.column("grp")[0].as_py()
    fps, ns, bases, counts = (
        np.concatenate([np.frombuffer(b, dtype=t) for b in group.column(c).to_pylist()])
        for c, t in (("fps", np.int64), ("ns", np.int32), ("bases", np.int32), ("counts", np.int32))
    )
    raw = b"".join(group.column("tokens").to_pylist())
    if number < 0:
        owner = np.repeat(np.arange(len(fps)), counts)
        tokens = np.frombuffer(raw, dtype=np.int64)
        masks = np.frombuffer(b"".join(group.column("masks").to_pylist()), dtype=np.int32)
        first = np.zeros(len(fps), dtype=bool)
        first[np.unique(fps, return_index=True)[1]] = True
        keep = first[owner]
        return _shared_table(fps[owner][keep], tokens[keep], None, ns[owner][keep], bases[owner][keep], masks[keep])
    first = np.zeros(len(fps), dtype=bool)  # a class that several tasks sent counts once
    first[np.unique(fps, return_index=True)[1]] = True
    owner = np.repeat(np.arange(len(fps)), counts)
    tokens = np.frombuffer(raw, dtype=np.uint32)
    keep = first[owner]
    both = np.sort((tokens[keep].astype(np.uint64) << np.uint64(32)) | owner[keep].astype(np.uint64))
    tokens, owner = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(tokens)))
    freq = np.repeat(lengths, lengths)
    keep = freq > 1
    ids = (np.int64(number) << 32) | tokens[keep].astype(np.int64)
    own = owner[keep]
    return _shared_table(fps[own], ids, freq[keep], ns[own], bases[own], np.zeros(len(own), dtype=np.int32))


def _shared_table(fp, token, freq, n, base, mask) -> pa.Table:
    freq = np.zeros(len(fp), dtype=np.int64) if freq is None else freq.astype(np.int64)
    columns = [pa.array(fp), pa.array(token), pa.array(freq), pa.array(n), pa.array(base), pa.array(mask)]
    return pa.table(columns, names=["fp", "token", "freq", "n", "base", "mask"])


def _prefixes(group: pa.Table) -> pa.Table:
    """Prefix tokens of the classes of one group, with m, the number of the class's tokens that others have too. Tokens of
    one class alone come first in every order; they take their places but need no row, so of the shared ones
    base + (number of shared ones) are left for the prefix."""
    fp, token, freq, n, base, mask = (group.column(c).to_numpy() for c in ("fp", "token", "freq", "n", "base", "mask"))
    order = np.argsort(fp, kind="stable")
    out, m = mask.copy(), np.zeros(len(fp), dtype=np.int32)
    starts = np.flatnonzero(np.r_[True, fp[order][1:] != fp[order][:-1]])
    for own in np.split(order, starts[1:]):
        at = own[mask[own] == 0]
        first = own[0]
        prefix = n[first] - -(-NUMERATOR * n[first] // DENOMINATOR) + 1
        m[own] = n[first] - (prefix - base[first] - len(at))
        if len(at):
            take = int(base[first]) + len(at)
            if take > 0:
                out[at] = _prefix_masks(token[at], freq[at], take)
    keep = out > 0
    columns = [pa.array(x[keep]) for x in (token, fp, n, m, out)]
    return pa.table(columns, names=["token", "fp", "n", "m", "mask"])


def _similar(batches):
    for batch in slices(batches):
        keep = []
        for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, items) for the classes of wanted (doc_id, fp). A bitmap of 2 MB, whatever the input, keeps most other documents
    from being cut into shingles and shuffled; the join that follows is exact."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    words = wanted.select(F.floor(at / 64).cast("int").alias("word"), at.alias("at"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    for row in bounded_rows(words, BITMAP_BITS // 64, "words of the bitmap"):
        bitmap[row["word"]] = row["bits"]
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut_sets(batches):
        for batch in slices(batches):
            at = batch.column("at").to_numpy()
            hit = (held.value[at >> 6] >> (at & 63)) & 1 == 1
            some = batch.filter(pa.array(hit))
            sets = [shingles(t).tobytes() for t in some.column("text").to_pylist()]
            yield pa.record_batch([some.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "items"])

    rows = docs.where("doc_id IS NOT NULL").withColumn("at", at).mapInArrow(cut_sets, "doc_id long, items binary")
    return rows.join(wanted, "doc_id").select("fp", "items").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("sa")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("items").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_similar, "a long, b long")


def _sharing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose common prefix tokens cover every order."""
    return pairs.groupBy("a", "b").agg(F.bit_or("mask").alias("mask")).where(F.col("mask") == ALL).select("a", "b")


def _sizes_fit(n1: str, m1: str, n2: str, m2: str):
    """Whether the sizes, and the numbers of tokens that are not a class's alone, leave room for the overlap needed."""
    both, ratio = NUMERATOR + DENOMINATOR, f"{DENOMINATOR}L * least({n1}, {n2}) >= {NUMERATOR}L * greatest({n1}, {n2})"
    return F.expr(f"{ratio} AND {both}L * least({m1}, {m2}) >= {NUMERATOR}L * ({n1} + {n2})")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a (rows) with sets b (columns). Rare items add their few pairs one by one, common
    ones go through a matrix product, some thousand items at a time."""
    sizes = np.array([len(x) for x in a + b])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    items, at = np.unique(np.concatenate(a + b), return_inverse=True)
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(items))
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for item in np.flatnonzero((counts > 1) & (counts <= COMMON)):
        rows = owner[order[edges[item] : edges[item + 1]]]
        left, right = rows[rows < len(a)], rows[rows >= len(a)] - len(a)
        if len(left) and len(right):
            out[np.ix_(left, right)] += 1
    common = np.flatnonzero(counts > COMMON)
    place = np.full(len(items), -1)
    place[common] = np.arange(len(common))
    for k in range(0, len(common), 4_096):
        mine = (place[at] >= k) & (place[at] < k + 4_096)
        matrix = np.zeros((len(sizes), min(4_096, len(common) - k)), dtype=np.float32)
        matrix[owner[mine], place[at][mine] - k] = 1
        out += matrix[: len(a)] @ matrix[len(a) :].T
    return out


def _link_tile(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between the classes of two tiles that lie in different components so far."""
    low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
    tile, fp, comp = (group.column(c).to_numpy() for c in ("tile", "fp", "comp"))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("items").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    sides = [np.flatnonzero(tile == t) for t in (low, high)]
    edges = [], []
    for p in range(0, len(sides[0]), TILE):
        for q in range(0, len(sides[1]), TILE):
            i, j = sides[0][p : p + TILE], sides[1][q : q + TILE]
            both = overlaps([sets[k] for k in i], [sets[k] for k in j]).astype(np.int64)
            linked = DENOMINATOR * both >= NUMERATOR * (sizes[i][:, None] + sizes[j][None, :] - both)
            x, y = np.nonzero(linked & (comp[i][:, None] != comp[j][None, :]))
            if len(x):
                nodes, at = np.unique(np.concatenate([fp[i[x]], fp[j[y]]]), return_inverse=True)
                root = find_roots(at[: len(x)], at[len(x) :], len(nodes))
                own = np.flatnonzero(root != np.arange(len(nodes)))
                edges[0].append(nodes[own])
                edges[1].append(nodes[root[own]])
    a, b = (np.concatenate([np.empty(0, dtype=np.int64), *e]) for e in edges)
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def _in_tiles(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among classes that long lists of shingles hold together: lists that share classes form a group, whose
    classes are dealt to tiles of 1024 and compared tile by tile. Rows grow with classes times tiles, not with pairs."""
    first = lists.groupBy("token").agg(F.min("fp").alias("b"))
    groups = cut(components(lists.select("token", F.col("fp").alias("a")).join(first, "token").select("a", "b")))
    members = groups.select(F.col("node").alias("fp"), F.col("component").alias("grp"))
    rows = members.join(lists.select("fp", "comp").distinct(), "fp").join(sets, "fp")
    tiles = members.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = rows.join(tiles, "grp").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(
        "grp", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fp", "comp", "items"
    )
    return rows.groupBy("grp", "low", "high").applyInArrow(_link_tile, "a long, b long")


def self_overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets (0 on the diagonal), rare and common items as in overlaps."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    items, at = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(at, minlength=len(items))
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    order = order[(counts[at[order]] > 1) & (counts[at[order]] <= COMMON)]
    who, what = owner[order], at[order]
    for d in range(1, COMMON):  # the d-th next holder of the same item
        same = what[d:] == what[:-d]
        if not same.any():
            break
        out += np.bincount(who[:-d][same] * n + who[d:][same], minlength=n * n).reshape(n, n)
    out += out.T
    common = np.flatnonzero(counts > COMMON)
    place = np.full(len(items), -1)
    place[common] = np.arange(len(common))
    for k in range(0, len(common), 4_096):
        mine = (place[at] >= k) & (place[at] < k + 4_096)
        matrix = np.zeros((n, min(4_096, len(common) - k)), dtype=np.float32)
        matrix[owner[mine], place[at][mine] - k] = 1
        out += matrix @ matrix.T
    np.fill_diagonal(out, 0)
    return out


def _count_tile(group: pa.Table) -> pa.Table:
    """For each class (fp), the rows n of the classes it links with, between the two tiles of a component or inside each
    component of a bucket."""
    low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
    tile, fp, comp, members = (group.column(c).to_numpy() for c in ("tile", "fp", "comp", "members"))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("items").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    gained = np.zeros(len(fp), dtype=np.int64)
    order = np.argsort(comp, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        parts = [
            [side[k : k + TILE] for k in range(0, len(side), TILE)] for side in (own[tile[own] == t] for t in (low, high))
        ]
        for i, j in combinations_with_replacement(parts[0], 2) if low == high else product(*parts):
            same = i is j
            both = self_overlaps([sets[k] for k in i]) if same else overlaps([sets[k] for k in i], [sets[k] for k in j])
            both = both.astype(np.int64)
            linked = DENOMINATOR * both >= NUMERATOR * (sizes[i][:, None] + sizes[j][None, :] - both)
            gained[i] += linked @ members[j]
            if not same:
                gained[j] += members[i] @ linked
    got = np.flatnonzero(gained)
    return pa.table([pa.array(fp[got]), pa.array(gained[got])], names=["fp", "n"])


def _link_counts(classes: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, others): the rows of all classes that a class links with. A component above a tile's size is compared tile by tile,
    the smaller ones go into buckets whole; rows grow with classes times tiles, not with pairs."""
    nodes = cut(labels.join(classes.select("fp", "n", "members"), "fp"))
    per = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_ITEMS)).cast("int")
    large = cut(nodes.groupBy("comp").agg(per.alias("tiles")).where("tiles > 1"))
    buckets = int((nodes.agg(F.sum("n")).first()[0] or 0) // TILE_ITEMS) + 1
    rows = nodes.join(large, "comp", "left").join(sets, "fp")
    rows = rows.withColumn("tile", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("tiles")), F.lit(-1)).cast("int"))
    others = F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    bucket = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("comp"), F.lit(buckets))).otherwise(F.col("comp"))
    rows = rows.withColumns({"other": F.explode(others), "grp": bucket}).select(
        "grp", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fp", "comp",
        "members", "items",
    )
    found = rows.groupBy("grp", "low", "high").applyInArrow(_count_tile, "fp long, n long")
    return found.groupBy("fp").agg(F.sum("n").alias("others"))


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest id reachable by links; documents link when 100 * intersection >= 75 * union of their sets
    of 5-word shingles (64-bit hashes). Null or empty texts have no shingles and link with nothing, as do rows with a null
    id; rows of equal id share their class's component. Whole texts are used; an empty table gives no rows.
    """
    return _joined(docs, id_column, text_column, False)


def with_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of join with n_links, the number of other rows that a row links with. Rows of equal sets link, whatever their
    ids; a row with a null id has 0 links and counts for no other row."""
    return _joined(docs, id_column, text_column, True)


def _joined(docs: DataFrame, id_column: str, text_column: str, counted: bool) -> DataFrame:
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, n long, fp long, slot int, count long"
    profile = cut(docs.mapInArrow(_profile, schema))
    rows = profile.where("slot IS NULL").select("doc_id", "n", "fp")
    linkable = rows.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    members = F.count("*").alias("members")
    classes = cut(linkable.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), members))
    counters = np.zeros(COUNTERS, dtype=np.int64)
    sums = profile.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("count").alias("count"))
    for row in bounded_rows(sums, COUNTERS, "counters"):
        counters[row["slot"]] = row["count"]
    total = classes.agg(F.sum("n")).first()[0] or 0
    levels = np.where(counters > 4 * counters.mean() + 1_000, counters, 0)
    groups = max(5, int(total // GROUP_TOKENS).bit_length())

    dealt = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_dealer(levels, groups), EXCHANGE)
    shared = dealt.groupBy("grp").applyInArrow(_shared_tokens, SHARED)
    part = F.pmod(F.xxhash64("fp"), F.lit(1 << groups))
    ranked = shared.groupBy(part.alias("part")).applyInArrow(_prefixes, "token long, fp long, n int, m int, mask int")
    postings = cut(ranked)
    busy = postings.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    postings = cut(postings.join(busy, "token"))
    sets = cut(_sets_of(docs, postings.select("fp").distinct().join(classes, "fp").select("doc_id", "fp")))

    links, labels = None, None
    for turn in range(HUB_ROUNDS + 1):
        p = postings
        if labels is not None:
            p = p.join(labels, "fp", "left")
            p = p.withColumn("comp", F.coalesce("comp", "fp"))
        else:
            p = p.withColumn("comp", F.col("fp"))
        if turn < HUB_ROUNDS:
            hub = F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), "fp", "n", "m", "mask", "comp")).alias("hub")
            heads = p.groupBy("token").agg(hub, F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2")
            near = p.join(heads, "token").where((F.col("comp") != F.col("hub.comp")) & _sizes_fit("n", "m", "hub.n", "hub.m"))
            near = near.select(
                F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b"), F.expr("mask & hub.mask").alias("mask")
            )
        else:
            p = cut(p)
            sizes = p.groupBy("token", "comp").agg(F.count("*").alias("rows"))
            most = sizes.groupBy("token").agg(F.max(F.struct("rows", "comp")).alias("top"), F.count("*").alias("comps"))
            mixed = cut(p.join(most.where("comps > 1").select("token", F.col("top.comp").alias("main")), "token"))
            small = F.count(F.when(F.col("comp") != F.col("main"), 1))
            lists = mixed.groupBy("token").agg(small.alias("few"), F.count("*").alias("rows"))
            dense = lists.where(F.col("few") * F.col("rows") > LIST_PAIRS).select("token")
            in_tiles = _in_tiles(mixed.join(dense, "token"), sets)
            mixed = mixed.join(dense, "token", "left_anti")
            few = mixed.where("comp <> main").selectExpr("token", "fp AS a", "n AS n1", "m AS m1", "mask AS k1", "comp AS c1")
            all_of = mixed.selectExpr(
                "token", "fp AS b", "n AS n2", "m AS m2", "mask AS k2", "comp AS c2", "comp = main AS in_main"
            )
            near = few.join(all_of, "token").where(
                F.expr("c1 <> c2 AND (in_main OR a < b)") & _sizes_fit("n1", "m1", "n2", "m2")
            )
            near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("k1 & k2").alias("mask"))
        found = _verified(_sharing(near.where("mask <> 0")), sets)
        found = cut(found if turn < HUB_ROUNDS else found.unionByName(in_tiles))
        links = found if links is None else links.unionByName(found)
        labels = cut(components(links).select(F.col("node").alias("fp"), F.col("component").alias("comp")))

    named = classes.join(labels, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class, columns = named.join(least, "comp"), []
    if counted:
        of_class = of_class.join(_link_counts(classes, labels, sets), "fp", "left")
        of_class = of_class.withColumn("n_links", F.col("members") - 1 + F.coalesce("others", F.lit(0)))
        columns = [F.when(F.col("doc_id").isNotNull(), F.col("n_links")).alias("n_links")]
    of_class = cut(of_class.select("fp", "component_id", *(["n_links"] if counted else [])))
    return rows.join(of_class, "fp", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias("n_links") for c in columns),
    )
