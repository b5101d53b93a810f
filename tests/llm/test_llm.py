"""Operators for training text: brute force, exact round trips, held-out accuracy, and odd rows (nulls, empty and long texts,
ties, repeats, empty tables, clashing column names)."""

import json
import random
import zlib
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from tallyspark.llm import (
    catalog,
    common,
    decontaminate,
    embed_dedup,
    html_text,
    jaccard_join,
    langid,
    licenses,
    quality,
    sentencepiece_codec,
    sharding,
    token_files,
)

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", None, None, 5),
    (4, "one two", "en", "s", 7),
    (4, "one two", "en", "s", 7),
    (5, "x" * 200_000, "de", "s", 200_000),
    (6, "word " * 50_000, "de", "s", 250_000),
    (7, "日本語 😀 ▁ café café <|endoftext|> \x00   ﬁ 12 A!!", "fr", "s", 9),
    (None, "no id here, but some words", "en", "s", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that clash with those of the results."""
    extra = ["score", "lang_pred", "ids", "shard", "size", "n_shingles", "labels", "text_crc32", "start"]
    return spark.createDataFrame(ODD, DOCS).select("*", *(F.lit("clash").alias(c) for c in extra))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_registered():
    queries = entry_points.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert "pipeline" in queries and 4 <= len(corpus_pipeline.STAGES) <= 5


# --- connected components ------------------------------------------------------------------------------------------
def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5000 + i) for i in range(1, 300)]
    edges = [(a, b) for a, b in edges if a != b]
    got = dict(rows_of(common.components(spark.createDataFrame(edges, "a long, b long").repartition(7))))
    assert got == brute_components(edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 -------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def texts():
    con = duckdb.connect()
    return [r[0] for r in con.execute(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


def full_viterbi(vocabulary, text):
    """Best score over the whole text at once."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + vocabulary.unknown
        for start in range(max(0, end - vocabulary.longest), end):
            if text[start:end] in vocabulary.scores:
                best[end] = max(best[end], best[start] + vocabulary.scores[text[start:end]][0])
    return best[-1]


def score_of(vocabulary, text, ids):
    """Score of ids, checking that they spell the text."""
    total, spelt, held = 0.0, "", b""
    for i in ids:
        if i in vocabulary.byte_of:
            held += bytes([vocabulary.byte_of[i]])
            try:
                spelt, held, total = spelt + held.decode(), b"", total + vocabulary.unknown
            except UnicodeDecodeError:
                pass
        else:
            spelt += vocabulary.texts[i]
            total += vocabulary.scores[vocabulary.texts[i]][0]
    assert spelt == text and not held
    return total


def test_streaming_viterbi_is_optimal_and_streams(texts):
    codec = sentencepiece_codec.Codec(PIECES)
    for text in [t[:600] for t in texts[:25]] + ["a\n\n b", "日本語 😀", "x" * 700, "in", "a  b"]:
        whole = codec.v.normalised(text)
        ids = codec.encode([text])[0].tolist()
        assert score_of(codec.v, whole, ids) == pytest.approx(full_viterbi(codec.v, whole), rel=1e-12)
        search, out, held = sentencepiece_codec.StreamingViterbi(codec.v), [], 0
        for k in range(0, len(whole), 7):
            out += search.feed(whole[k : k + 7])
            held = max(held, len(search.chars))
        assert out + search.finish() == ids
        if "x" not in text:
            assert held <= 8 * codec.v.longest  # the window stays short


def test_unigram_library_agrees(texts):
    """The same vocabulary, declared a unigram model, segmented by the library."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(PIECES).read_bytes())
    proto.trainer_spec.model_type = 1
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = sentencepiece_codec.Codec(PIECES)
    gains = []
    for text in [w for t in texts[:40] for w in t.split()[:20]]:
        ours, theirs = codec.encode([text])[0].tolist(), library.encode(text)
        whole = codec.v.normalised(text)
        gains.append(score_of(codec.v, whole, ours) - score_of(codec.v, whole, theirs))
    assert min(gains) >= 0 and np.mean([g == 0 for g in gains]) > 0.95  # the library rounds its sums to single precision


def test_codec_round_trip_and_odd_rows(spark, odd, none):
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECES), PIECES)
    for row in both.collect():
        if row["text"] is None:
            assert row["ids"] is None and row["decoded"] is None
        else:
            assert row["decoded"] == row["text"].replace("▁", " ")
    assert sentencepiece_codec.encode(none, PIECES).count() == 0
    assert all(r["round_trip"] for r in catalog.op1_sentencepiece(spark, SF).collect())


# --- 2 -------------------------------------------------------------------------------------------------------------
def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op2_quality(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    both = got.join(common.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in both)


def test_quality_never_reads_held_labels(spark):
    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    turned = labels.withColumn(
        "quality", F.when(common.crc_mod("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = (rows_of(quality.scored(docs, quality.fit(docs, x), keep=["doc_id"])) for x in (labels, turned))
    assert one == two


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 0), (6, 1, None), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.where("false")):
        got = quality.scored(odd, quality.fit(odd, table)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored(none, quality.fit(none, labels)).count() == 0


def test_quality_of_much_repeated_rows(spark):
    docs = spark.range(400).selectExpr("id % 4 AS doc_id", "if(id % 4 < 2, 'good words here', 'bad text there') AS text")
    many = docs.unionByName(spark.range(200).selectExpr("1L AS doc_id", "concat('good words ', id) AS text"))
    labels = spark.range(300).selectExpr("id % 4 AS doc_id", "CAST(id % 4 < 2 AS INT) AS quality")
    got = quality.scored(many, quality.fit(many, labels, sample=8, held_fold=-1), keep=["doc_id"]).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 for r in got)
    assert rows_of(spark.createDataFrame(got)) == rows_of(quality.scored(many, quality.fit(many, labels, sample=8, held_fold=-1), keep=["doc_id"]))


def test_pool_does_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(0)
    vectors, weights = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype("f4"), np.ones(quality.BUCKETS, "f4")
    texts = ["a b c a", "", "A!! b, 12 x", "w " * 50]
    whole = quality.pool(texts, vectors, weights)
    parts = np.concatenate([quality.pool([t], vectors, weights) for t in texts])
    assert np.allclose(whole, parts, atol=1e-5) and not whole[1].any()


# --- 3 -------------------------------------------------------------------------------------------------------------
def brute_tokens(pairs):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(WORDS), [], 0
    for doc, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_files_against_the_tokenizer(spark, odd, none):
    docs = common.table(spark, SF, "documents").repartition(5)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(token_files.round_trip(docs, WORDS)) == brute_tokens(pairs)
    assert rows_of(token_files.round_trip(odd, WORDS)) == brute_tokens([(r[0], r[1]) for r in ODD])
    assert token_files.round_trip(none, WORDS).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_on_random_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    rng = random.Random(3)
    latin = "abAB 'stdm'relv09.,_-!\n\téÉßÿ×÷Ø"
    wide = latin + "\r\x0b\x0c\x1c\x85\xa0µªº²½İıΣσς\u0301\u0345ﬁŉ漢字あ😀\u200d\u200b…“”<|>"
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(40))) for a in (latin, wide) for _ in range(4_000)]
    texts += ["", "<|endoftext|> a", "A'LL It'S", "x" * 5_000]
    encoded = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert token_files.WordEncoder(path).encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]


def test_reading_in_order_fetches_each_batch_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(300)], DOCS.split(", lang")[0]).coalesce(1)
    file = token_files.write_tokens(docs, str(tmp_path / "files"), WORDS, sequence=16).first()
    sequences, fetched = token_files.SequenceFile(file["file"]), []
    reader = sequences.reader

    class Counting:
        def get_batch(self, i):
            fetched.append(i)
            return reader.get_batch(i)

    sequences.reader = Counting()
    step = file["n_tokens"] // 300
    ids = np.concatenate([p for k in range(0, file["n_tokens"], step) for p in sequences.tokens(k, min(step, file["n_tokens"] - k))])
    assert len(ids) == file["n_tokens"] and fetched == list(range(sequences.batches)) and len(fetched) > 1


def test_token_files_random_access(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the quick brown fox " * (i % 40)) for i in range(400)], "doc_id long, text string")
    files = token_files.write_tokens(docs, str(tmp_path / "out"), WORDS, sequence=16).orderBy("file_no").collect()
    for f in files:
        sequences = token_files.SequenceFile(f["file"])
        every = np.concatenate(list(sequences.tokens(0, f["n_tokens"])))
        for i in (0, (f["n_tokens"] - 1) // 16):
            ids, mask = sequences[i]
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            assert ids[mask == 1].tolist() == every[16 * i : 16 * i + 16].tolist()


# --- 4 -------------------------------------------------------------------------------------------------------------
def brute_bm25(index, words, threshold):
    terms = {index.terms[w] for w in words if w in index.terms}
    scores = {}
    for t in terms:
        for item, x in index.postings[t]:
            scores[item] = scores.get(item, 0.0) + x
    return {i: s for i, s in scores.items() if s >= threshold - 1e-9}


def test_wand_finds_all_above_threshold(spark):
    index = decontaminate.indexes(common.table(spark, SF, "benchmark"))[0]
    docs = [r["text"] for r in common.table(spark, SF, "documents").limit(60).collect()]
    everything = set(range(index.blocks))
    for threshold in (0.2, 0.4, 0.6):
        for text in docs:
            words = decontaminate.words_of(text)[:140]
            terms = sorted({index.terms[w] for w in words if w in index.terms})
            got = dict(index.search(terms, everything, threshold))
            expected = brute_bm25(index, words, threshold)
            assert got.keys() == expected.keys()
            assert all(got[i] == pytest.approx(expected[i]) for i in got)
            step = index.longest
            runs = decontaminate.words_of(text)
            by_passage = {(i, p) for i, p, _ in index.candidates(runs, threshold)}
            brute = set()
            for p in range(-(-len(runs) // step)):
                brute |= {(i, p) for i in brute_bm25(index, runs[p * step : (p + 2) * step], threshold)}
            assert by_passage == brute


def test_planted_items_are_found(spark):
    items = common.table(spark, SF, "benchmark")
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    rng = random.Random(3)
    index = decontaminate.indexes(items)[0]
    clean = [t for _, t in docs if not index.hits(t)][:20]
    planted = []
    for k, (item, text) in enumerate(listed):
        words = clean[k % len(clean)].split()
        at = rng.randrange(len(words) + 1)
        planted.append((k, " ".join(words[:at] + [text.upper() if k % 2 else text] + words[at:])))
    table = spark.createDataFrame(planted + [(1000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, items).collect()}
    assert {(k, item) for k, (item, _) in enumerate(listed)} <= got
    assert all(d < 1000 for d, _ in got)
    assert {r["doc_id"] for r in decontaminate.clean(table, items).collect()} == set(range(1000, 1000 + len(clean)))


def test_indexes_grow_with_the_items(spark, monkeypatch):
    import pickle

    rng = random.Random(4)
    listed = [(i, " ".join(["the", "of"] + [f"w{rng.randrange(30_000)}" for _ in range(18)])) for i in range(4_000)]
    index = decontaminate.Index(listed)
    assert len(pickle.dumps(index)) < 8_000_000  # terms x blocks alone would be 100 MB
    assert all(i in [h[0] for h in index.hits("x y " + t + " z")] for i, t in listed[::400])
    wide = index._reach(np.arange(50), np.arange(50) // 5, 10)
    monkeypatch.setattr(decontaminate, "ENTRIES", 7)
    assert np.allclose(wide, index._reach(np.arange(50), np.arange(50) // 5, 10))
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 20)
    some = listed[:60] + [listed[0]] * 100  # repeated rows fall into one part
    items = spark.createDataFrame(some, "item_id long, text string")
    found = decontaminate.indexes(items)
    assert sorted(i for x in found for i in x.ids) == list(range(60)) and len(found) > 1
    docs = spark.createDataFrame([(k, "a b " + listed[k][1] + " c") for k in (0, 7, 59)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 0), (7, 7), (59, 59)]
    assert decontaminate.clean(docs, items).count() == 0


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    items = common.table(spark, SF, "benchmark")
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    docs = [(k, "some words before " + " ".join(t.split()[: -(k % 3) or None]) + " and after") for k, (_, t) in enumerate(listed)]
    table = spark.createDataFrame(docs + [(900, "nothing of them"), (901, None)], "doc_id long, text string")
    found = {}
    for most in (20_000, -(-len(listed) // 7)):
        monkeypatch.setattr(decontaminate, "INDEX_ITEMS", most)
        made = decontaminate.indexes(items)
        assert len(made) >= (1 if most == 20_000 else 6) and len({x.longest for x in made}) == 1
        found[most] = {tuple(r)[:2]: tuple(r)[2:] for r in decontaminate.contaminated(table, items).collect()}
    one, many = found.values()
    assert one.keys() == many.keys() and len(one) >= len(listed) // 2
    assert all(many[k] == pytest.approx(one[k]) for k in one)
    brute = decontaminate.Index(listed)
    assert {(d, h[0]) for d, t in docs for h in brute.hits(t)} == set(one)


def test_clean_keeps_a_column_of_its_own_name(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta", "a"), (2, "other", "b")], "doc_id long, text string, _clean string")
    assert [tuple(r) for r in decontaminate.clean(docs, items).collect()] == [(2, "other", "b")]


def test_overlap_rule_and_odd_rows(spark, odd, none):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu nu xi"), (2, None), (3, "!!"), (4, "two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.indexes(table)[0]
    assert [h[0] for h in index.hits("x Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi y")] == [1]
    assert not index.hits("alpha beta gamma delta epsilon zeta eta q w e r t z u")
    assert decontaminate.question_and_answer("Who is it? It is me.") == ([b"who", b"is", b"it"], [b"it", b"is", b"me"])
    got = decontaminate.contaminated(odd, table)
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(4, 4), (4, 4)]
    assert decontaminate.clean(odd, table).columns == odd.columns
    assert decontaminate.clean(odd, table).count() == len(ODD) - 2
    assert decontaminate.contaminated(none, table).count() == 0
    assert decontaminate.contaminated(odd, table.where("false")).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------
def brute_links(vectors, threshold=0.95):
    ids = [i for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {i: embed_dedup.unit_rows(np.array([v]))[0] for i, v in vectors if i in set(ids)}
    edges = [
        (a, b) for a, b in combinations(ids, 2) if len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold
    ]
    component = brute_components(edges)
    n = {i: 0 for i, _ in vectors}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], component.get(i, i), component.get(i, i) == i) for i, _ in vectors)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    near = [b + rng.normal(size=24) * s for b in base for s in (0.05, 0.15, 0.22, 0.24)]
    hot = [base[0] + rng.normal(size=24) * 0.02 for _ in range(300)]
    rows = [v.tolist() for v in [*base, *near, *hot]] + [base[1].tolist()] * 30 + [(base[2] * 1e200).tolist()]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 12, [-0.0, 2.0], [0.0, 1.0]]
    vectors = list(enumerate(rows))
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(6)
    assert sorted(tuple(r) for r in embed_dedup.near_duplicates(table).collect()) == brute_links(vectors)
    assert embed_dedup.near_duplicates(table.where("false")).count() == 0


def test_embeddings_recall_on_the_table(spark):
    x = common.table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    got = sorted(tuple(r) for r in catalog.op5_embedding_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == brute_links([(r["vec_id"], r["embedding"]) for r in x])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    a, b = (embed_dedup.unit_rows(rng.normal(size=(50, 64))) for _ in range(2))
    b[:25] = embed_dedup.unit_rows(a[:25] + 0.3 * b[:25])
    errors, outside = [], 0
    for rotation in embed_dedup.rotations(64, 200):
        _, signs, factors = embed_dedup.code(a, rotation)
        got, bound = embed_dedup.estimate(signs, factors, b @ rotation.T)
        errors.append(got - a @ b.T)
        outside += (np.abs(errors[-1]) > bound[:, None]).mean() / 200
    assert np.abs(np.mean(errors, axis=0)).max() < 0.06 and outside < 1e-3


def test_tiles_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rng = np.random.default_rng(9)
    vectors = [(i, (np.r_[5.0, rng.normal(size=7) * 0.3]).tolist()) for i in range(120)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embed_dedup.near_duplicates(table).collect()) == brute_links(vectors)


# --- 6 -------------------------------------------------------------------------------------------------------------
def check_shards(rows, texts):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    for part in shards.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    of_text = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        of_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == expected
    return [sum(r["size"] for r in shards.get(k, ())) for k in range(8)]


def test_sharding(spark, odd, none):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    sums = check_shards(sharding.shard(docs).collect(), [r["text"] for r in docs.collect()])
    assert max(sums) - min(sums) < 0.01 * sum(sums)
    sums = check_shards(sharding.shard(odd).collect(), [r[1] for r in ODD])
    assert sorted(sums)[-2:] == [200_001, 250_001]
    hot = spark.createDataFrame([(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sums = check_shards(sharding.shard(hot).collect(), ["hot text" if i % 3 else f"text {i}" for i in range(3000)])
    rest = sorted(sums)[:-1]
    assert max(rest) - min(rest) < 0.02 * sum(sums)
    assert sharding.shard(none).count() == 0


def test_best_fit_decreasing_is_the_textbook_one():
    rng = random.Random(4)
    for _ in range(50):
        sizes, capacity = [rng.randint(1, 60) for _ in range(40)], 70
        rooms, expected = [], {}
        for i in sorted(range(40), key=lambda k: -sizes[k]):
            fit = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
            b = min(fit)[1] if fit else len(rooms)
            if not fit:
                rooms.append(capacity)
            rooms[b] -= sizes[i]
            expected[i] = b
        assert sharding.best_fit_decreasing(sizes, capacity) == [expected[i] for i in range(40)]
    assert sharding.best_fit_decreasing([5], 4) is None and sharding.pack([], 8) == []


def test_runs_of_equal_sizes_pack_like_single_items():
    rng = random.Random(7)
    for _ in range(30):
        sizes = [rng.randint(1, 9) for _ in range(400)] + [rng.randint(30, 99) for _ in range(5)]
        capacity, rooms = 120, []
        expected = {}
        for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fit = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
            b = min(fit)[1] if fit else len(rooms)
            if not fit:
                rooms.append(capacity)
            rooms[b] -= sizes[i]
            expected[i] = b
        assert sharding.best_fit_decreasing(sizes, capacity) == [expected[i] for i in range(len(sizes))]
        bins = sharding.pack(sizes, 8)
        sums = [sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(8)]
        assert max(sums) - min(sums) <= 9 and sum(sums) == sum(sizes)
    # 10^12 items take a few steps
    placed = sharding.level_runs([(1000, 10**6), (7, 10**12), (1, 3)], 8)
    sums = [sum(s * (e - a) for s, a, e, b in placed if b == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8 * 7 and sum(sums) == 10**9 + 7 * 10**12 + 3


def test_open_bins_against_a_list():
    rng, bins, rooms = random.Random(9), sharding.OpenBins(), []
    for number in range(2000):
        if rng.random() < 0.6:
            rooms.append((rng.randint(0, 50), number))
            bins.add(*rooms[-1])
        else:
            size = rng.randint(0, 60)
            fit = [r for r in rooms if r[0] >= size]
            assert bins.take(size) == (min(fit) if fit else None)
            if fit:
                rooms.remove(min(fit))

    def depth(tree):
        return 0 if tree is None else 1 + max(depth(tree.left), depth(tree.right))

    assert depth(bins.tree) < 40


def test_sharding_by_capacity_and_equal_runs(spark, odd):
    docs = spark.createDataFrame([(i, f"{i:05d}") for i in range(1000)] + [(5000 + i, "hot" * 100) for i in range(40)], "doc_id long, text string")
    rows = sharding.shard(docs, capacity=600).collect()
    of_shard = {}
    for r in rows:
        of_shard.setdefault(r["shard"], []).append(r)
    assert len(rows) == 1040 and sorted(of_shard) == list(range(11))  # the hot group alone, then 100 texts a shard
    assert sorted(sum(r["size"] for r in part) for part in of_shard.values()) == [600] * 10 + [40 * 301]
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in of_shard.values())
    again = sharding.shard(docs.repartition(5), capacity=600).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    two = [rows_of(sharding.shard(odd.repartition(n))) for n in (1, 6)]
    assert two[0] == two[1]


# --- 7 -------------------------------------------------------------------------------------------------------------
def brute_base(text):
    import re

    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), labels)


def test_license_base_columns(spark, odd, none):
    more = spark.createDataFrame(
        [(50, "CC BY cc-by, cc by"), (51, "cc bye General Public  License; all rights RESERVED all rights reserved"), (52, "É cc by cc by")],
        "doc_id long, text string",
    )
    for docs in (common.table(spark, "/root/testdata/sf0.01", "documents"), odd, more):
        texts = [r["text"] for r in docs.collect()]
        got = licenses.scan(docs.select("doc_id", "text")).collect()
        ours = [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got]
        assert sorted(ours, key=repr) == sorted(map(brute_base, texts), key=repr)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
        assert all(0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"]) for r in got)
    assert licenses.scan(none).count() == 0


def test_license_notices_with_errors():
    tool = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    rng = random.Random(6)
    for phrase, label in licenses.NOTICES.items():
        for errors in range(len(phrase) // licenses.CHARS_PER_ERROR + 1):
            for _ in range(5):
                chars = list(phrase)
                for at in rng.sample([i for i in range(1, len(chars) - 1) if chars[i] != " "], errors):
                    chars[at] = "q"
                noisy = "".join(chars)
                found = tool.scan(f"some words before {noisy} and after")[2]
                hits = [f for f in found if f["label"] == label]
                better = [f for f in found if f["errors"] < errors]
                assert hits and hits[0]["first_word"] == 3 or better, (noisy, found)
    assert tool.scan("nothing of the kind stands here at all")[2] == []


def test_license_notices_side_by_side():
    tool = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    clean, edited = "released under the mit license", "relesed under the mt license"
    spans = lambda text: [(f["first_word"], f["last_word"], f["errors"], f["label"]) for f in tool.scan(text)[2]]
    assert spans(f"{edited} and {clean}") == [(0, 4, 2, "mit"), (6, 10, 0, "mit")]
    assert spans(f"{clean} {edited} {clean}") == [(0, 4, 0, "mit"), (5, 9, 2, "mit"), (10, 14, 0, "mit")]
    rng = random.Random(9)
    for phrase in licenses.NOTICES:
        rows, size = [], len(phrase.split())
        for _ in range(12):
            chars = list(phrase)
            for at in rng.sample([i for i in range(1, len(chars) - 1) if chars[i] != " "], rng.randrange(3)):
                chars[at] = "q"
            rows.append("".join(chars))
        found = licenses.Scanner({}, {phrase: "it"}).scan(" and ".join(rows))[2]
        assert [f["first_word"] for f in found] == [k * (size + 1) for k in range(len(rows))], (phrase, rows, found)


# --- 8 -------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a> name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use
the cookies of the site and of others for you, and this is a long text that has stop words.</div><!-- c > d -->
<article><h1>Head &amp; tail</h1><p><b>First   paragraph<br>goes on.<p>Short.</p><p>5 &lt; 6 &#233;&nbsp;x</p>
<aside>Side of the text</aside><form>Send <input name=q></form><div id="comments">A reader wrote that the text is good.</div>
<p>Last one</article><div class=ad>Buy the thing of the year, it is on sale in all of the shops and in the net.</div>
<footer>&copy; foot</footer></body></html>"""


def test_html_main_text(spark):
    assert html_text.main_text(PAGE).split("\n") == ["Head & tail", "First paragraph goes on.", "Short.", "5 < 6 é x", "Last one"]
    body = "The rules say that this block of text is long and that it has many of the stop words in it, so it stays. "
    plain = f"<div><a href=x>Home page of all</a></div><div>{body}</div><div>Short bit</div><div>{body}</div>"
    assert html_text.main_text(plain).split("\n") == [body.strip(), "Short bit", body.strip()]
    cases = [None, "", "<", "<p", "no markup", "<article>x", "<script>never closed", "<!-- open", "<p>" * 3000, "a" * 300_000]
    pages = spark.createDataFrame([(i, None, c) for i, c in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    assert [got[i] for i in (0, 1, 3, 5, 6, 7, 8)] == ["", "", "", "x", "", "", ""]
    assert html_text.extract(pages.where("false")).count() == 0


def test_html_on_the_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in common.table(spark, SF, "pages").collect()}
    for r in catalog.op8_html_text(spark, SF).collect():
        part = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", part))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_keeps_long_blocks_of_an_article():
    parts = "Valve DN40 17.20 EUR 4711-A; Pump P3 220.00 EUR 4712-B; Gasket NBR 0.80 EUR 4713-C; Bolt M8 0.10 EUR"
    code = "def f(x): return [y ** 2 for y in x if y % 2] # 0x7f 0x80 0x81 0x82 0x83 0x84 0x85 0x86 0x87"
    link = "<p><a href=/other>Read also: another page about something else</a></p>"
    page = f"<article><h1>Parts</h1><p>{parts}</p>{link}<pre>{code}</pre>{link}<p>{parts}</p><p>End</p></article>"
    assert html_text.main_text(page).split("\n") == ["Parts", parts, code, parts, "End"]


def test_html_takes_stop_words_from_the_pages(spark):
    rows = [
        "Kot siedział na oknie i patrzył na ulicę, a potem zszedł do kuchni, bo tam było ciepło i pachniało chlebem.",
        "W lesie było cicho i ciemno, a na polanie stał stary dom, do którego nikt już nie chciał wejść w nocy.",
        "猫は窓に座って通りを見ていました。そして台所に行きました。そこは暖かくてパンの匂いがしていたからです。" * 2,
    ]
    menu = "<div><a href='/'>Strona</a> <a href='/o'>O nas</a></div>"
    table = [(i, None, f"<body>{menu}<div>{t}</div><div>Krótko</div><div>{t}</div>{menu}</body>") for i, t in enumerate(rows * 5)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: f"{t}\nKrótko\n{t}" for i, t in enumerate(rows * 5)}
    assert html_text.frequent_words(pages.where("false")) == frozenset()


# --- 9 -------------------------------------------------------------------------------------------------------------
def brute_jaccard(pairs):
    sets = []
    for doc, text in pairs:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - 4)
        sets.append((doc, {tuple(words[i : i + 5]) for i in range(n)} if words else set()))
    edges = [
        (a, b)
        for (a, x), (b, y) in combinations([s for s in sets if s[1] and s[0] is not None], 2)
        if a != b and 100 * len(x & y) >= 75 * len(x | y)
    ]
    component = brute_components(edges)
    return sorted(((d, len(s), component.get(d, d)) for d, s in sets), key=repr)


def planted_copies():
    """Groups around base texts with similarities on both sides of the threshold, a passage that many share, exact copies."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    docs, passage = [], words(60)
    for size in (90, 30, 8):
        base = words(size)
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                copy[rng.randrange(size)] = words(1)[0]
            docs.append(" ".join(copy))
    docs += [" ".join(words(k) + passage + words(k)) for k in range(12) for _ in range(6)]
    docs += [" ".join(passage)] * 15 + ["One two"] * 4 + ["one  TWO", "a", "a b c d", "a b c d e"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("list_pairs", [50, 4096])
def test_jaccard_against_brute_force(spark, monkeypatch, list_pairs):
    monkeypatch.setattr(jaccard_join, "LIST_PAIRS", list_pairs)
    monkeypatch.setattr(jaccard_join, "TILE", 64 if list_pairs == 50 else 1024)
    pairs = planted_copies()
    table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    assert rows_of(jaccard_join.join(table)) == brute_jaccard(pairs)


def test_jaccard_odd_rows(spark, odd, none):
    assert rows_of(jaccard_join.join(odd)) == sorted(
        ((d, n, None if d is None else c) for d, n, c in brute_jaccard([(r[0], r[1]) for r in ODD])), key=repr
    )
    assert jaccard_join.join(none).count() == 0
    assert jaccard_join.join(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).collect()[0][2] == 1


def brute_link_counts(pairs):
    sets = [(d, set(jaccard_join.shingles(t).tolist())) for d, t in pairs]
    linked = lambda x, y: x and 100 * len(x & y) >= 75 * len(x | y)
    return sorted(
        ((d, 0 if d is None else sum(i != k and e is not None and bool(linked(x, y)) for k, (e, y) in enumerate(sets))) for i, (d, x) in enumerate(sets)),
        key=repr,
    )


@pytest.mark.parametrize("tile", [50, 1024])
def test_jaccard_counts_all_links(spark, monkeypatch, odd, none, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "TILE_ITEMS", 3_000 if tile == 50 else 2_000_000)
    pairs = planted_copies()
    pairs += [(None, pairs[0][1]), (None, pairs[1][1]), pairs[2], (5_000, None), (5_001, " ")]
    table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(6)
    got = jaccard_join.with_links(table).collect()
    expected = brute_link_counts(pairs)
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=repr) == expected
    assert sum(n for _, n in expected) > 10 * len(pairs)  # many more links than connect the components
    if tile == 1024:
        assert rows_of(jaccard_join.with_links(odd).select("doc_id", "n_links")) == brute_link_counts([r[:2] for r in ODD])
        assert jaccard_join.with_links(none).count() == 0


def test_overlaps_of_a_list_with_itself():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3_000, size=rng.integers(1, 900)).astype(np.uint64)) for _ in range(70)]
    got = jaccard_join.self_overlaps(sets)
    assert got.tolist() == [[0 if x is y else len(np.intersect1d(x, y)) for y in sets] for x in sets]


def test_overlaps_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, size=rng.integers(1, 200)).astype(np.uint64)) for _ in range(90)]
    got = jaccard_join.overlaps(sets[:50], sets[50:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[50:]] for x in sets[:50]]


# --- 10 ------------------------------------------------------------------------------------------------------------
def brute_distance(text, ranks, most):
    from collections import Counter

    padded = langid.letters_only(text)
    grams = Counter(
        padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)
        if " " not in padded[i : i + n].strip() and padded[i : i + n].strip() and (n < 3 or padded[i + 1] != " ")
    )
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    mine = [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:most]
    return [sum(abs(ranks.index(g) - k) if g in ranks else most for k, g in enumerate(mine))]


def test_language_distance_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    profiles = langid.learn(docs)
    ranks = {}
    for name, (codes, order) in zip(profiles.names, profiles.tables, strict=True):
        ranks[name] = codes[np.argsort(order)].tolist()
    for r in docs.limit(12).collect():
        mine = langid.ranked(langid.letters_only(r["text"]), profiles.most)
        expected = [brute_distance(r["text"], ranks[n], profiles.most)[0] for n in profiles.names]
        assert profiles.distances(mine).tolist() == expected


def test_language_held_out_accuracy_and_odd_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    both = catalog.op10_language_id(spark, sf).join(common.table(spark, sf, "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in both]) > 0.98
    profiles = langid.learn(common.table(spark, sf, "documents"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, profiles).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in profiles.names
    assert langid.identify(odd, langid.learn(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, profiles).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------
def test_pipeline_stages_take_effect(spark):
    sf, docs = "/root/testdata/sf0.01", common.table(spark, "/root/testdata/sf0.01", "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, sf))
        after = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
        gone = before.keys() - after.keys()
        assert after.items() <= before.items()
        if name == "SentencePiece encoding":
            assert set(columns) < set(out.columns) and not gone
            continue
        assert out.columns == columns
        if name == "quality classifier":
            assert sum(labels.get(d) == 0 for d in gone) > 0.9 * sum(q == 0 for q in labels.values())
            assert sum(labels.get(d) == 1 for d in gone) <= 0.01 * len(labels)
        elif name == "language ID":
            assert all(not langid.letters_only(before[d]) for d in gone)
        elif name == "n-gram Jaccard join":
            component = {d: c for d, _, c in brute_jaccard(list(before.items()))}
            assert gone == {d for d, c in component.items() if d != c}
        else:
            index = decontaminate.indexes(common.table(spark, sf, "benchmark"))[0]
            assert gone == {d for d, t in before.items() if index.hits(t)}
        docs, before = out, after


def test_pipeline_on_odd_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        common.table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    for n, rows in enumerate((ODD, [])):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            docs = common.cut(stage(spark, docs, str(tmp_path)))
        assert "ids" in docs.columns and (n == 0 or docs.count() == 0)


def test_pipeline_keeps_every_column_of_the_input(spark):
    names = ["score", "lang_pred", "_row", "_score", "_clean", "_comp", "_rank", "_stays", "row", "packed", "c0", "component_id"]
    docs = common.table(spark, SF, "documents").select(*(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names), "*")
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, common.cut(stage(spark, docs, SF))
        assert docs.columns == columns + (["ids"] if name == "SentencePiece encoding" else [])
        assert all(r[c] == f"{c} {r['doc_id']}" for r in docs.collect() for c in names)
    given = {r["doc_id"]: r for r in common.table(spark, SF, "documents").collect()}
    assert all(r[c] == given[r["doc_id"]][c] for r in docs.collect() for c in ("text", "lang", "source", "n_chars"))


def test_near_duplicates_keep_one_row_of_each_group(spark):
    copy, clean = "this text of eight words stands here often", "quite another text that nobody has copied so far"
    rows = [(7, copy), (7, copy), (3, copy), (3, clean), (None, copy), (None, "a b c d e f"), (None, "a b c d e f"), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    got = rows_of(corpus_pipeline.near_duplicate_stage(spark, docs, SF).select("doc_id", "text"))
    assert got == sorted([(3, copy), (3, clean), (None, "a b c d e f"), (9, ""), (9, "")], key=repr)


def test_no_oracle_is_left_out():
    assert json.dumps(sorted(catalog.ORACLES)) == '["op13_exact_dedup"]' and corpus_pipeline.ORACLE_SQL is None


LONG = "This is the text of the page and it is long enough to be told from a menu or from a notice by the words that it has."


@pytest.mark.parametrize(
    "page",
    [f'<article class="post comments-open"><p>{LONG}</p></article>', f'<article class="post share-enabled"><p>{LONG}</p></article>',
     f'<form id="f"><article><p>{LONG}</p></article><input></form>', f'<main><section class="discussion"><p>{LONG}</p></section></main>'],
)
def test_names_and_forms_do_not_empty_an_article(page):
    assert html_text.main_text(f"<html><body><nav><a>Home</a></nav>{page}<footer>{LONG}</footer></body></html>") == LONG


def test_comments_and_forms_stay_out_of_the_text():
    inner = f'<section class="comments"><article><p>A {LONG}</p></article></section><form><p>B {LONG}</p></form>'
    page = f'<article><p>{LONG}</p>{inner}</article><article class="comment"><p>C {LONG}</p></article><form><p>D {LONG}</p></form>'
    assert html_text.main_text(page) == LONG
    assert html_text.main_text(f'<nav>{LONG}</nav><div class="cookie-notice"><p>{LONG}</p></div>') == ""


def test_numbers_are_no_letters():
    assert [langid.letters_only(t) for t in ("½ ²", "\u2167", "12 _", "½ a")] == ["", "", "", " ½ a "]
