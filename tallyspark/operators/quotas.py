"""Decisions that depend on earlier decisions of the same key: alert cool-down and sliding-window quotas.

Neither gathers a key. The cool-down follows successor pointers, which doubling turns into the chain of emitted rows
by joins alone (see chains). The quota runs stretches of time in parallel from a guessed state and repeats those whose guess was wrong.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.chains import bucket_of, chain, group_key
from tallyspark.sources.folders import written

# Executors receive the folds themselves and need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MICROS = 1_000_000
STRETCH_ROWS = 100_000  # rows of a stretch of time, unless a single period holds more
GUESSES = 6  # rounds of guessing, after which the open rest of a key is folded in order


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- cool-down -----------------------------------------------------------------------------------------------------
def alert_cooldown(breaches: DataFrame, keys: list[str], seconds: int = 300, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds `emit`: true when more than `seconds` passed since the key's last emitted row. Of rows at one time the one with
    the smallest tie counts, of equal rows one; rows without a time are never emitted."""
    wait = max(1, seconds * MICROS)
    rows = breaches.withColumns({"_key": group_key(keys), "_us": _micros(ts)})
    levels = rows.where("_us is not null").groupBy("_key", "_us").agg(F.min(tie).alias("_tie"))
    levels = written(levels, "levels")
    through = chain(levels.select("_key", F.col("_us").alias("_at")), wait).withColumnRenamed("_at", "_us").join(levels, ["_key", "_us"])
    through = through.select("_key", "_us", F.col("_tie").alias("_first_tie"), F.lit(True).alias("_emitted"))
    tied = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_us", tie).orderBy(F.lit(0))))
    first = tied["_nth"] == 1
    on = (tied["_key"] == through["_key"]) & (tied["_us"] == through["_us"]) & tied[tie].eqNullSafe(through["_first_tie"]) & first
    return tied.join(through, on, "left").select(*[tied[c] for c in breaches.columns], F.coalesce("_emitted", F.lit(False)).alias("emit"))


def cooldown_step(seconds: int) -> Callable:
    """The same decision on times in order, given the last emission: for streams, which see a key bit by bit."""
    wait = seconds * MICROS

    def step(state: list, micros: np.ndarray) -> tuple[np.ndarray]:
        emit = np.zeros(len(micros), dtype=bool)
        i = 0 if not state else int(np.searchsorted(micros, state[0] + wait, side="right"))
        while i < len(micros):
            emit[i] = True
            state[:] = [int(micros[i])]
            i = int(np.searchsorted(micros, state[0] + wait, side="right"))
        return (emit,)

    return step


# --- quotas --------------------------------------------------------------------------------------------------------
def quota_step(calls: int, seconds: int, keep_edge: bool) -> Callable:
    period = seconds * MICROS
    side = "right" if keep_edge else "left"

    def step(log: deque, micros: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(micros)
        admitted = np.zeros(n, dtype=bool)
        remaining = np.zeros(n, dtype=np.int32)
        retry = np.zeros(n, dtype=np.int32)
        i = 0
        while i < n:
            now = int(micros[i])
            while log and (now - log[0] > period or (now - log[0] == period and not keep_edge)):
                log.popleft()
            if len(log) < calls:
                log.append(now)
                admitted[i] = True
                remaining[i] = calls - len(log)
                i += 1
                continue
            free = int(np.searchsorted(micros, log[0] + period, side=side)) if log else n
            free = max(free, i + 1)
            retry[i:free] = (log[0] + period - micros[i:free]) // MICROS if log else 0
            i = free
        return admitted, remaining, retry

    return step


ENDS = (pa.string(), pa.list_(pa.int64()))
DECIDED = T.StructType(
    [
        T.StructField("admitted", T.BooleanType()),
        T.StructField("remaining", T.IntegerType()),
        T.StructField("retry_after", T.IntegerType()),
    ]
)


def stretches(rows: DataFrame, most: int) -> DataFrame:
    """(_key, _bucket, _stretch, _first) for the filled periods of a key: whole periods joined to stretches of about `most`
    rows, and the first time of each period. From the small table of filled periods."""
    filled = rows.groupBy("_key", "_bucket").agg(F.count("*").alias("_n"), F.min("_us").alias("_first"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    return filled.select("_key", "_bucket", F.floor(before / F.lit(most)).alias("_stretch"), "_first")


def _identity(stretch: Column | str) -> Column:
    return F.concat(F.to_json("_key"), F.lit("#"), F.col(stretch) if isinstance(stretch, str) else stretch)


def _decide(rows: DataFrame, entries: DataFrame, calls: int, seconds: int, keep_edge: bool, order: list[str], ends_only: bool) -> DataFrame:
    """Streams each stretch (_id) in order through the quota, from the log that entries (_id, _log) name, else an empty one.
    Gives the rows with their decisions, or with ends_only one row for each stretch: the log that it ends with."""
    step, names = quota_step(calls, seconds, keep_edge), [c for c in rows.columns if c != "_id"]
    marked = rows.withColumn("_log", F.lit(None).cast("array<long>")).unionByName(entries, allowMissingColumns=True)
    sent = marked.repartition("_id").sortWithinPartitions("_id", F.col("_log").isNull(), *order)
    kept = [] if ends_only else names
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_log", T.ArrayType(T.LongType()))])
    if not ends_only:
        schema = T.StructType([*rows.select(*kept).schema.fields, *DECIDED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log = None, deque()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id")).to_numpy(zero_copy_only=False)
            micros = batch.column(batch.schema.get_field_index("_us")).fill_null(0).to_numpy(zero_copy_only=False)
            logs = batch.column(batch.schema.get_field_index("_log"))
            marker = logs.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | marker[1:] | marker[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ids)] if len(ids) else []
            ended: list[tuple] = []
            columns: list[list] = [[], [], []]
            for a, b in zip(bounds, bounds[1:]):
                if ids[a] != now:
                    if now is not None:
                        ended.append((now, list(log)))
                    now, log = ids[a], deque()
                if marker[a]:
                    log = deque(logs[a].as_py())
                    continue
                for values, more in zip(columns, step(log, micros[a:b])):
                    values.append(more)
            if ends_only:
                yield pa.record_batch([pa.array([e[i] for e in ended], t) for i, t in enumerate(ENDS)], names=["_id", "_log"])
            elif columns[0]:
                whole = batch.filter(pa.array(~marker))
                yield pa.record_batch(
                    [*(whole.column(whole.schema.get_field_index(c)) for c in kept), *(pa.array(np.concatenate(v)) for v in columns)],
                    names=[*kept, *DECIDED.names],
                )
        if ends_only and now is not None:
            yield pa.record_batch([pa.array([now], ENDS[0]), pa.array([list(log)], ENDS[1])], names=["_id", "_log"])

    return sent.mapInArrow(run, schema)


def _settled(times: DataFrame, parts: DataFrame, calls: int, seconds: int, keep_edge: bool, guesses: int, runs: list[int]) -> tuple[DataFrame, DataFrame]:
    """(parts, entries): the log that each stretch really starts with, where it is not empty, by a fixed point.

    All stretches run in parallel from an empty log. A stretch whose predecessor ended with another log than it assumed runs
    again, until none does; then every assumption is what the predecessor gave, from the first stretch on. Logs are compared
    by what still counts at the stretch's first row. Where guessing does not settle, the rest of that key, from its first
    open stretch on, becomes one stretch, which is folded in order: nothing is given up.
    """
    period = seconds * MICROS

    def ends(of: DataFrame, entries: DataFrame) -> DataFrame:
        return written(_decide(of, entries.where(F.size("_log") > 0), calls, seconds, keep_edge, ["_us"], ends_only=True), "ends")

    used = parts.select("_id", F.expr("CAST(array() AS array<long>)").alias("_log"))
    ended = ends(times, used)
    runs.append(parts.count())
    while True:
        before = ended.select(F.col("_id").alias("_previous"), F.col("_log").alias("_given"))
        counts = lambda x: (F.col("_from") - x <= period) if keep_edge else (F.col("_from") - x < period)
        given = parts.join(before, "_previous").select("_id", "_key", "_stretch", F.filter("_given", counts).alias("_log"))
        assumed = used.withColumnRenamed("_log", "_assumed")
        changed = written(given.join(assumed, "_id").where("_log <> _assumed").drop("_assumed"), "changed")
        runs.append(changed.count())
        if not runs[-1]:
            return parts, used.where(F.size("_log") > 0)
        if len(runs) > guesses:
            return _rest_in_order(parts, used, changed)
        again = changed.select("_id", "_log")
        newer = ends(times.join(again.select("_id"), "_id", "left_semi"), again)
        ended = written(ended.join(again, "_id", "left_anti").unionByName(newer), "ends")
        used = written(used.join(again, "_id", "left_anti").unionByName(again), "used")


def _rest_in_order(parts: DataFrame, used: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All stretches of a key from its first open one on as one; those before it are settled, and so is its entry."""
    opened = changed.groupBy("_key").agg(F.min(F.struct("_stretch", "_log")).alias("_open"))
    both = written(parts.join(opened, "_key", "left"), "merged")
    late = F.coalesce(F.col("_stretch") >= F.col("_open._stretch"), F.lit(False))
    merged = both.withColumn("_id", F.when(late, _identity(F.col("_open._stretch"))).otherwise(F.col("_id")))
    entries = used.join(both.where(late).select("_id"), "_id", "left_anti").unionByName(
        both.where(F.col("_stretch") == F.col("_open._stretch")).select("_id", F.col("_open._log").alias("_log"))
    )
    return merged.drop("_open"), entries.where(F.size("_log") > 0)


def rate_limit(
    requests: DataFrame,
    keys: list[str],
    calls: int = 100,
    seconds: int = 60,
    keep_edge: bool = False,
    ts: str = "ts",
    tie: str = "event_id",
    stretch_rows: int = STRETCH_ROWS,
    guesses: int = GUESSES,
    runs: list[int] | None = None,
) -> DataFrame:
    """Sliding-log quota: a request is admitted while fewer than `calls` admitted ones of its key lie in the period.

    Rejected requests are not logged. Adds admitted, remaining (of the quota, for admitted ones) and retry_after
    (whole seconds, for rejected ones). keep_edge tells whether a request exactly `seconds` old still counts. Requests
    without a time are not admitted.

    A key with more than stretch_rows rows is cut into stretches of whole periods, which run in parallel (see _settled);
    `runs`, if given, receives how many stretches each round ran, the last number being 0 where guessing settled all.
    """
    runs = [] if runs is None else runs
    period = max(1, seconds * MICROS)
    rows = requests.withColumns({"_key": group_key(keys), "_us": _micros(ts)})
    timed = rows.where("_us is not null").withColumn("_bucket", bucket_of("_us", period))
    cells = stretches(timed, stretch_rows)
    if cells.where("_stretch > 0").isEmpty():  # every key is one stretch
        none = timed.select(F.lit("").alias("_id"), F.array(F.lit(0).cast("long")).alias("_log")).where("false")
        return _with_untimed(_decide(timed.select(F.to_json("_key").alias("_id"), "_us", *requests.columns), none, calls, seconds, keep_edge, ["_us", tie], False), rows)
    cells = written(cells, "stretches")
    of_key = Window.partitionBy("_key").orderBy("_stretch")
    parts = cells.groupBy("_key", "_stretch").agg(F.min("_first").alias("_from"))
    parts = parts.withColumn("_previous", _identity(F.lag("_stretch").over(of_key))).withColumn("_id", _identity("_stretch"))
    parts = written(parts, "parts")
    several = parts.where("_previous is not null").select("_key").distinct()
    long_keys = parts.join(several, "_key", "left_semi")
    times = timed.select("_key", "_bucket", "_us").join(cells, ["_key", "_bucket"]).join(several, "_key", "left_semi")
    times = written(times.select(_identity("_stretch").alias("_id"), "_us"), "times")
    settled, entries = _settled(times, long_keys, calls, seconds, keep_edge, guesses, runs)
    parts = settled.unionByName(parts.join(several, "_key", "left_anti"))
    placed = timed.join(cells.drop("_first"), ["_key", "_bucket"]).join(parts.select("_key", "_stretch", "_id"), ["_key", "_stretch"])
    sent = placed.select("_id", "_us", *requests.columns)
    return _with_untimed(_decide(sent, entries, calls, seconds, keep_edge, ["_us", tie], ends_only=False), rows)


def _with_untimed(decided: DataFrame, rows: DataFrame) -> DataFrame:
    """The decisions, and the rows without a time, which are never admitted."""
    untimed = rows.where("_us is null").drop("_key", "_us")
    never = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((False, 0, 0), DECIDED.fields)]
    return decided.drop("_us").unionByName(untimed.select("*", *never))
