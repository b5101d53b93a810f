"""Exact duplicates, whitening and conversation repair: brute force, numpy, SQL, and odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import catalog, common, exact_dedup, whitening
from tallyspark.llm import conversations as cv

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_sql(name, **tables):
    con = duckdb.connect()
    for t in tables or ("documents", "conversations", "embeddings"):
        if t in tables:
            con.register(t, tables[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(catalog.ORACLES[name]).fetchall(), key=repr)


# --- exact duplicates ------------------------------------------------------------------------------------------------
TEXTS = [None, "", " \t\n", "a b", "ab", "a\x0bb ", "b a", "x" * 300, "x" * 299 + "y", "x" * 300 + " ", "é e", "é e", "ée", "\x00a", "\x1fa", "😀 a"]


def brute_dedup(pairs):
    """Rows without which of them stays, and for each group whether exactly one does."""
    groups = {}
    for doc, text in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for body, rows in groups.items():
        keep = min(rows)[3]
        out += [(r[3], keep, len(rows), hashlib.sha256(body.encode()).hexdigest()) for r in rows]
    return sorted(out, key=repr), len(groups)


def check_dedup(got, pairs):
    expected, groups = brute_dedup(pairs)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == expected
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_against_sql(spark):
    assert rows_of(catalog.op13_exact_dedup(spark, SF)) == by_sql("op13_exact_dedup")


def test_exact_dedup_on_odd_rows(spark):
    rng = random.Random(2)
    pairs = [(rng.choice([None, *range(30)]), rng.choice(TEXTS)) for _ in range(400)] + [(k, "the same " * 3) for k in range(500)] * 2
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    clash = docs.select("*", *(F.lit("clash").alias(c) for c in ("_row", "body", "size", "prefix", "open", "points", "kept", "keep_id")))
    check_dedup(exact_dedup.dedup(clash, digests=True).collect(), pairs)
    assert exact_dedup.dedup(docs.where("false"), digests=True).count() == 0


def test_exact_dedup_hashes_open_groups_only(spark):
    pairs = [(0, "abc"), (1, "a bc"), (2, "abd"), (3, "longer"), (4, "p" * 80 + "1"), (5, "p" * 80 + "2"), (6, "p" * 80 + "1")]
    got = {r["doc_id"]: r for r in exact_dedup.dedup(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert [d for d in got if got[d]["text_sha256"] is None] and {d for d in got if got[d]["text_sha256"]} == {0, 1, 4, 5, 6}
    assert {d: (got[d]["keep_id"], got[d]["group_size"], got[d]["kept"]) for d in got} == {
        0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True), 4: (4, 2, True), 5: (5, 1, True), 6: (4, 2, False),
    }


def test_exact_dedup_stays_native(spark):
    plan = exact_dedup.dedup(common.table(spark, SF, "documents"), digests=True)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


# --- whitening -------------------------------------------------------------------------------------------------------
def matrices():
    rng = np.random.default_rng(1)
    for trial in range(60):
        d = int(rng.integers(1, 50))
        kinds = [
            rng.random(d) ** 3 * 100,
            np.repeat(rng.random(-(-d // 3)), 3)[:d] * 50,
            np.concatenate([rng.random(min(d, 2)) * 1e6, np.zeros(max(0, d - 2))]),
            np.ones(d) + 1e-6 * rng.random(d),
            10.0 ** -np.arange(d) * 1e3,
        ]
        e = kinds[trial % 5]
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = (q * e) @ q.T
        yield (a + a.T) / 2, rng.random() * e.max()


def test_inertia_and_feast_against_numpy():
    for a, shift in matrices():
        e = np.linalg.eigvalsh(a)
        assert whitening.inertia(a - shift * np.eye(len(a))) == ((e > shift).sum(), (e < shift).sum())
        values, vectors = whitening.leading(a, 4)
        k = len(values)
        assert k == min(4, (e > e.max() * len(a) * len(a) * 1e-15).sum()) or k == min(4, len(a))
        assert np.abs(values - e[::-1][:k]).max() <= 1e-12 * e.max()
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * e.max()
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-12


def test_contour_projects_onto_the_interval():
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0]
    e = np.array([9.0, 8.5, 8.0] + [1.0] * 9)
    projected = whitening.project((q * e) @ q.T, np.eye(12), 7.0, 10.0)
    assert np.allclose(projected, q[:, :3] @ q[:, :3].T, atol=1e-6)


def test_feast_fails_rather_than_miss_one(monkeypatch):
    a = np.diag([5.0, 4.0, 1.0])
    monkeypatch.setattr(whitening, "above", lambda m, shift: 3 if shift < 4.5 else 0)
    with pytest.raises(ArithmeticError):
        whitening.feast(a, 3.0, 6.0)


def check_whitening(got, vectors):
    usable = {
        i: np.floor(256 * np.array(v, dtype=float)) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)
    }
    sizes = [len(x) for x in {x.tobytes(): x for x in usable.values()}.values()]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    usable = {i: x.astype(int) for i, x in usable.items() if len(x) == size}
    fit = np.unique(list(usable.values()), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(4, (e > e.sum() * size * 1e-15).sum())
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, j + 1) for i in usable for j in range(k))
    for r in got:
        j, x = r["component"] - 1, usable[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        assert abs(r["whitened"]) == pytest.approx(abs((x - s / n) @ q[:, j]) / np.sqrt(e[j]), abs=1e-8)
        assert r["explained"] == pytest.approx(e[j] / e.sum(), rel=1e-10) and r["identity_error"] < 1e-10


def test_whitening_against_numpy(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    check_whitening(catalog.op12_whitening(spark, SF).collect(), vectors)


def test_whitening_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = list(enumerate(rng.normal(size=(60, 6)).tolist()))
    copies = [(100 + k, vectors[0][1]) for k in range(50)]
    odd = [None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0], [-0.0] * 6]
    vectors += copies + list(enumerate(odd, 200))
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).repartition(5)
    check_whitening(whitening.whitened(table, whitening.fit(table)).collect(), vectors)
    for some in (table.where("false"), table.where("vec_id = 200"), table.where("vec_id = 3"), table.where("vec_id >= 100 and vec_id < 150")):
        assert whitening.whitened(some, whitening.fit(some)).count() == 0  # no variance, no component
    twice = table.where("vec_id < 60").unionByName(table.where("vec_id < 60"))
    assert whitening.whitened(twice, whitening.fit(twice)).count() == 2 * 60 * 4
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.5, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(huge, whitening.fit(huge)).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] < 2)


def test_deviations_are_exact_or_null():
    x = np.array([[3, -4], [1 << 40, 1]])
    assert whitening.deviations(x, 7, [2, 5]) == [19**2 + 33**2, None]
    assert whitening.deviations(np.array([[1 << 33]]), 1 << 30, [1]) == [None]
    assert whitening.deviations(np.array([[3_000_000_000]]), 1, [0]) == [9 * 10**18]


# --- conversations ---------------------------------------------------------------------------------------------------
def brute_repair(rows):
    """Cheapest edits by relaxing every state after every row."""

    def insert(now):
        changed = True
        while changed:
            changed = False
            for state, (price, edits) in list(now.items()):
                to, new = cv.AFTER[cv.WANTED[state]], (price + 5, edits + "I")
                if to not in now or new < now[to]:
                    now[to], changed = new, True
        return now

    now = {cv.START: (0, "")}
    for initial, fault in rows:
        after = {}
        for state, (price, edits) in insert(now).items():
            wanted, extra = cv.WANTED[state], 5 if fault == cv.CUT_OFF else 0
            options = [("D", 2, state)]
            if fault < cv.DUPLICATE:
                options.append(("R", 1 + extra, cv.AFTER[wanted]))
                if initial == wanted or (initial, state) == ("s", cv.START):
                    options.append(("K", extra, cv.AFTER[initial]))
            for edit, more, to in options:
                after[to] = min(after.get(to, (1 << 30, "")), (price + more, edits + edit))
        now = after
    return min(v for state, v in insert(now).items() if state in (cv.START, cv.PAIRS))


def test_search_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suuaa?"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(14))]
        expected = brute_repair(rows)
        assert cv.cheapest(rows) == expected
        for window in (1, 2, 5):
            assert cv.cheapest(rows, window) == expected


def test_search_proves_long_rows_quickly():
    rng = random.Random(2)
    rows = [(rng.choice("sua?"), rng.choice([0, 0, 1, 2, 3])) for _ in range(20_000)]
    assert cv.cheapest(rows) == cv.cheapest(rows, 997) == brute_repair(rows)


def brute_conversations(table):
    text = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, said in table:
        rows = found.setdefault(conv, [])
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = {1: "", 2: re.sub("[.!?]", "", said)}.get(kind, said)
        rows += [(turn, "user" if kind == 4 else role, said)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in found.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, codes, n = set(), [], [0] * 4
        for _, role, said in rows:
            body = said.strip(cv.WHITE)
            fault = cv.BLANK if not body else cv.DUPLICATE if (role, said) in seen else cv.CUT_OFF if body[-1] not in ".!?" else cv.SOUND
            seen.add((role, said))
            n[fault] += 1
            codes.append((role[:1] if role[:1] in cv.AFTER else "?", fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in cv.LEGAL for a, b in zip(rows, rows[1:]))
        cost, audit = brute_repair(codes)
        state, fixed, left = cv.START, [], iter(rows)
        for edit in audit:
            wanted = {"u": "user", "a": "assistant"}[cv.WANTED[state]]
            role, said = (wanted, "") if edit == "I" else next(left)[1:]
            if edit != "D":
                role = role if edit == "K" else wanted
                fixed.append(f"{role}:{said}")
                state = cv.AFTER[role[0]]
        out.append((conv, gaps, n[3], n[2], n[1], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def query_on(spark, tmp_path, rows, name="a"):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = table.select("*", *(F.lit("clash").alias(c) for c in ("copies", "said", "key", "fault", "pos", "step", "audit", "_kind")))
    clash.repartition(5).write.parquet(str(tmp_path / name / "conversations.parquet"))
    return rows_of(catalog.op11_conversation_repair(spark, str(tmp_path / name)))


def test_conversations_of_the_table(spark):
    con = duckdb.connect()
    table = con.execute(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert rows_of(catalog.op11_conversation_repair(spark, SF)) == brute_conversations(table)


def test_conversations_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cv, "BATCH", 50)  # long audits in several pieces
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "s"]
    texts = ["Yes.", "No!", "why?", "cut", "cut", None, "", " \n", "Done. \t", "é.", "\x00.", "w " * 5_000 + "."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 14))]
    rows += [(None, t, rng.choice(roles), f"line {t}.") for t in range(40)]
    rows += [(1000, t, ("user", "assistant")[t % 2], rng.choice(["ok.", f"turn {t}.", "cut"])) for t in range(3_000)]  # a long one
    rows += [(1001, 1, "user", "the same.")] * 700
    assert query_on(spark, tmp_path, rows) == brute_conversations(rows)
    assert query_on(spark, tmp_path, [], "none") == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "tool", "Yes."), (1, 2, "user", " "), (1, 3, "assistant", "Bye."), (2, 0, "system", "Be kind.")]
    rows += [(3, 0, "system", "S."), (3, 1, "user", "A."), (3, 2, "assistant", "B."), (4, 0, "user", "A."), (4, 1, "user", "B."), (4, 2, "x", "C.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    found, repaired = cv.repair(table)
    audits = {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()}
    assert audits == {1: (4, "KDDK"), 2: (2, "D"), 3: (0, "KKK"), 4: (3, "DKR")}
    got = [tuple(r) for r in repaired.orderBy("conv_id", "step").collect()]
    assert got == [
        (1, 0, "K", "user", "Hi."), (1, 3, "K", "assistant", "Bye."),
        (3, 0, "K", "system", "S."), (3, 1, "K", "user", "A."), (3, 2, "K", "assistant", "B."),
        (4, 1, "K", "user", "B."), (4, 2, "R", "assistant", "C."),
    ]
