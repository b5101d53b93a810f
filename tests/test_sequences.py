"""Chains, quotas, percentiles and grids on keys without gaps and at any scale, against sequential or brute-force code."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import activity, chains, layout, quotas


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def fold_cooldown(rows, seconds):
    last, out = {}, set()
    for key, t, event in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or t - last[key] > seconds:
            last[key] = t
            out.add(event)
    return out


def fold_quota(rows, calls, period, keep_edge):
    logs, out = {}, {}
    for key, t, event in sorted(rows, key=lambda r: (r[1], r[2])):
        log = logs[key] = [x for x in logs.get(key, []) if t - x < period or (keep_edge and t - x == period)]
        if len(log) < calls:
            log.append(t)
            out[event] = (True, calls - len(log), 0)
        else:
            out[event] = (False, 0, int(period - (t - log[0])))
    return out


def table(spark, rows):
    shuffled = random.Random(1).sample(rows, len(rows))
    cells = [(k, None if t is None else at(t), e) for k, t, e in shuffled]
    return spark.createDataFrame(cells, "k string, ts timestamp, event_id long").repartition(8)


def hot_rows(n, span, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(span), i) for i in range(n)]
    return rows + [(rng.choice(["a", "b", None]), rng.randrange(40 * span), n + i) for i in range(n // 10)]


@pytest.mark.parametrize("seconds", [0, 1, 7, 300])
def test_cooldown_without_gaps(spark, seconds):
    rows = hot_rows(3_000, 2_500, seconds)
    rows += [("edge", seconds * i, 10_000 + i) for i in range(50)] + [("edge", seconds * 20 + 1, 10_100), ("no time", None, 10_101)]
    got = quotas.alert_cooldown(table(spark, rows), ["k"], seconds)
    assert got.columns == ["k", "ts", "event_id", "emit"] and got.count() == len(rows)
    assert {r.event_id for r in got.where("emit").collect()} == fold_cooldown(rows, seconds)


def test_successors_cross_empty_buckets(spark):
    times = [0, 1, 9, 10, 11, 25, 26, 60, 71, 72]
    levels = spark.createDataFrame([(t,) for t in times], "_at long").select(F.struct(F.lit("k").alias("k0")).alias("_key"), "_at")
    got = {r._at: (r._next, r._start) for r in chains.successors(levels, 10).collect()}
    for t in times:
        assert got[t][0] == next((u for u in times if u > t + 10), None)
    assert [t for t in times if got[t][1]] == [0, 60]  # 25 may follow 11, 60 can follow nothing


def test_cooldown_of_one_key_keeps_all_tasks_busy(spark):
    """Rows of a key are dealt out by time: no partition of the successor step holds more than a small part of them."""
    levels = spark.range(0, 200_000).select(F.struct(F.lit("k").alias("k0")).alias("_key"), (F.col("id") * 1_000).alias("_at"))
    placed = chains.successors(levels, 1_000_000).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) < 60_000


def test_equal_rows_are_emitted_once(spark):
    rows = [("k", 5, 1)] * 4 + [("k", 5, 2), ("k", 400, 3), ("k", 400, 3)]
    got = quotas.alert_cooldown(table(spark, rows), ["k"]).collect()
    assert sorted((r.event_id, r.emit) for r in got if r.emit) == [(1, True), (3, True)] and len(got) == 7
    assert quotas.alert_cooldown(table(spark, rows).where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("keep_edge", [False, True])
@pytest.mark.parametrize("guesses", [0, 2, 100])
def test_quota_in_stretches(spark, keep_edge, guesses):
    rows, runs = hot_rows(2_000, 3_000, 4), []
    got = quotas.rate_limit(table(spark, rows), ["k"], 5, 60, keep_edge, stretch_rows=150, guesses=guesses, runs=runs).collect()
    assert {r.event_id: (r.admitted, r.remaining, r.retry_after) for r in got} == fold_quota(rows, 5, 60, keep_edge)
    assert runs[0] >= 10 and (runs[-1] == 0 if guesses == 100 else len(runs) <= guesses + 2)


def test_quota_settles_where_load_is_light(spark):
    """Quiet periods between bursts make the guesses right: only few stretches run again."""
    rows = [("k", 100 * (i // 20) + i % 20, i) for i in range(4_000)]
    runs = []
    got = quotas.rate_limit(table(spark, rows), ["k"], 5, 60, stretch_rows=200, runs=runs).collect()
    assert {r.event_id: (r.admitted, r.remaining, r.retry_after) for r in got} == fold_quota(rows, 5, 60, False)
    assert runs[0] >= 10 and runs[-1] == 0 and len(runs) <= 3


def test_quota_odd_rows(spark):
    rows = [("k", 5, 1)] * 3 + [(None, 5, 2), (None, 6, 3), ("k", None, 4)]
    got = quotas.rate_limit(table(spark, rows), ["k"], 1, 60).collect()
    assert sorted((r.event_id, r.admitted) for r in got) == [(1, False), (1, False), (1, True), (2, True), (3, False), (4, False)]
    assert quotas.rate_limit(table(spark, rows).where("false"), ["k"], 1, 60).count() == 0
    assert {r.admitted for r in quotas.rate_limit(table(spark, rows), ["k"], 0, 60).collect()} == {False}


# --- percentiles ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["below a tenth", "equal", "wide", "signed", "few"])
def test_percentiles_by_radix(spark, kind):
    rng = random.Random(kind)
    make = {
        "below a tenth": lambda: rng.random() / 10,
        "equal": lambda: 3.25,
        "wide": lambda: rng.random() * 10 ** rng.randrange(-12, 10),
        "signed": lambda: rng.choice([-0.0, 0.0, -1.5, 2.0**-1074, -(2.0**-1074), 1e308, -1e308, rng.gauss(0, 1)]),
        "few": lambda: rng.choice([1.0, 2.0]),
    }[kind]
    data = {k: [make() for _ in range(n)] for k, n in (("hot", 4_000), ("a", 37), ("b", 1), (None, 9))}
    rows = [(k, x) for k, xs in data.items() for x in xs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "operation string, duration double").repartition(6)
    got = {r.operation: r for r in activity.index_percentiles(df, "operation", "duration", activity.QUANTILES).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        for name, q in activity.QUANTILES.items():
            assert got[k][name] == sorted(xs)[int(len(xs) * q)]


def test_percentiles_leave_the_order_to_counts(spark):
    df = spark.range(1000).selectExpr("'k' AS operation", "CAST(id AS DOUBLE) AS duration")
    plan = activity.index_percentiles(df, "operation", "duration", {"p50": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("count(1)") == 4
    assert activity.index_percentiles(df.where("false"), "operation", "duration", {"p50": 0.5}).count() == 0


# --- grids ---------------------------------------------------------------------------------------------------------
def brute_rows(ys):
    row, anchor, out = 0, None, {}
    for y in sorted(set(ys)):
        if anchor is None or y - anchor > layout.ROW_TOLERANCE:
            row, anchor = row + 1, y
        out[y] = row
    return out


def test_cell_rows_without_gaps(spark):
    rng = random.Random(5)
    tables = {"dense": [rng.randrange(40_000) / 4 for _ in range(6_000)], "sparse": [rng.randrange(90_000) / 2 for _ in range(300)]}
    tables["steps"] = [10.0 * i for i in range(50)] + [5.0]
    cells = [(t, float(i % 7), y, i) for t, ys in tables.items() for i, y in enumerate(ys)]
    got = layout.cell_grid(spark.createDataFrame(cells, "t string, x1 double, y1 double, cell_id int").repartition(5), ["t"]).collect()
    assert len(got) == len(cells)
    for t, ys in tables.items():
        assert {r.y1: r.row_no for r in got if r.t == t} == brute_rows(ys)
    ranked = sorted((r.t, r.row_no, r.x1, r.y1, r.cell_id, r.col_no) for r in got)
    for a, b in zip(ranked, ranked[1:]):
        assert b[5] == (a[5] + 1 if a[:2] == b[:2] else 1)


def test_a_million_levels_in_one_table(spark):
    cells = spark.range(1_000_000).select(F.lit(1).alias("t"), (F.col("id") / 4).alias("y1"))
    got = layout.row_starts(cells, ["t"]).agg(F.max("row_no").alias("rows"), F.count("*").alias("n")).first()
    assert got["n"] == 1_000_000 and got["rows"] == -(-1_000_000 // 41)  # 41 levels of a quarter lie within 10


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_cells_and_tokens_at_any_scale(spark, scale):
    rng = random.Random(6)
    cells, tokens = [], []
    for i in range(120):
        size = rng.choice([0.001, 0.01, 0.1, 0.5, 1.0, 0.0])
        x, y = rng.random() - 0.3, rng.random() - 0.3
        cells.append((rng.randrange(2), i, x * scale, y * scale, (x + size) * scale, (y + size * rng.random()) * scale))
    cells += [(0, 900, None, None, None, None), (0, 901, 0.0, 0.0, float("inf"), 1.0), (1, 902, 5.0, 5.0, 1.0, 1.0)]
    tokens = [(rng.randrange(3), i, f"t{i}", (rng.random() * 1.4 - 0.3) * scale, (rng.random() * 1.4 - 0.3) * scale) for i in range(400)]
    tokens += [(0, 1000, "corner", cells[0][2], cells[0][3]), (0, 1001, "nowhere", None, None)]
    c = spark.createDataFrame(cells, "d int, c int, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(tokens, "d int, elem_id int, text string, cx double, cy double")
    got = {r.c: r.cell_text for r in layout.token_cell_join(c, t, ["d"], ["d", "c"]).collect()}
    for d, i, x1, y1, x2, y2 in cells:
        inside = [] if x1 is None or x2 == float("inf") else [w for e, _, w, cx, cy in tokens if e == d and cx is not None and x1 <= cx <= x2 and y1 <= cy <= y2]
        assert got[i] == " ".join(inside)
