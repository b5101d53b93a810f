"""Streaming forms of the log statistics, alerts and validation.

Event time and watermark are explicit: rows later than the watermark are dropped by Spark. State is bounded by the
watermark for windows, and is one row per key for running totals.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.quotas import cooldown_step
from tallyspark.operators.validation import validate_nested
from tallyspark.sources.folders import work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table of a folder as a stream of its files. The table may be one file or a folder of part files; the
    pattern matches its exact name only, and lets the source take either. Fails where there is no such table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parque[t]")


END_OF_STREAM = "2262-01-01 00:00:00"  # the last year that nanoseconds in 64 bits hold
CLOSING_ID = -(1 << 63)


# --- transformations ------------------------------------------------------------------------------------------------
def performance_windows(log: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts, success rate and durations per operation and event-time window, tumbling or sliding."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    n = F.count("*")
    return (
        log.withWatermark("ts", delay)
        .groupBy(span.alias("w"), "operation")
        .agg(
            n.alias("total_operations"),
            F.count_if(F.col("success")).alias("successful_operations"),
            (F.count_if(F.col("success")) / n).alias("success_rate"),
            F.avg("duration").alias("average_duration"),
            F.min("duration").alias("min_duration"),
            F.max("duration").alias("max_duration"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
    )


def running_totals(log: DataFrame) -> DataFrame:
    """Processed, success and error counts and times since the start of the stream."""
    return log.groupBy(F.lit("all").alias("scope")).agg(
        F.count("*").alias("processed_count"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.sum("duration").alias("total_processing_time"),
        F.avg("duration").alias("avg_processing_time"),
    )


def emitted_alerts(breaches: DataFrame, key: str, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Alerts that pass the cool-down. Breaches wait in state until the watermark has passed them, so they are judged
    in event-time order however they arrive; the state holds the last emission and the breaches still waiting."""
    decide = cooldown_step(seconds)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, ids = state.get if state.exists else ([], [], [])
        parts = [(np.asarray(times, dtype="int64"), np.asarray(ids, dtype="int64"))]
        parts += [(p["us"].to_numpy("int64"), p["event_id"].to_numpy("int64")) for p in batches]
        us, event = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((event, us))
        us, event = us[order], event[order]
        settled = int(np.searchsorted(us, state.getCurrentWatermarkMs() * 1000, side="right"))
        seen = [int(x) for x in last]
        (emit,) = decide(seen, us[:settled])
        state.update((seen, us[settled:].tolist(), event[settled:].tolist()))
        if settled < len(us):
            state.setTimeoutTimestamp(int(us[settled]) // 1000 + 1)
        yield pd.DataFrame({key: group[0], "event_id": event[:settled][emit], "us": us[:settled][emit]})

    shaped = breaches.withWatermark("ts", delay).select(key, "ts", "event_id", F.unix_micros("ts").alias("us"))
    return shaped.groupBy(key).applyInPandasWithState(
        fold,
        f"{key} string, event_id long, us long",
        "last array<long>, times array<long>, ids array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# --- running --------------------------------------------------------------------------------------------------------
def run_to_end(stream: DataFrame, mode: str, folder: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Processes what is there now. Checkpoint and sink lie in the same shared folder."""
    started = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    started.awaitTermination()


def batch_writer(folder: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to its own folder, so a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{folder}/out/batch={batch}")

    return write


def latest_rows(spark: SparkSession, stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Runs an update-mode aggregation and returns the last row of each key."""
    folder = work_folder(spark, purpose)
    run_to_end(stream, "update", folder, batch_writer(folder))
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def appended_rows(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    folder = work_folder(spark, purpose)
    run_to_end(stream, "append", folder, batch_writer(folder))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def all_emitted_alerts(spark: SparkSession, breaches: DataFrame, key: str, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """The emitted alerts of a stream that has ended, none undecided.

    The stream is read beside a second source, which is empty at first. When all is read, one closing row with a time behind
    all others arrives there; the same query, going on from its checkpoint, moves its watermark past every waiting breach.
    A breach later than the watermark, which Spark drops, stays undecided as in emitted_alerts.
    """
    folder = work_folder(spark, "alerts")
    rows = breaches.select(key, "ts", "event_id")
    closing = spark.range(1).select(
        F.lit(None).cast(rows.schema[key].dataType).alias(key),
        F.lit(END_OF_STREAM).cast(rows.schema["ts"].dataType).alias("ts"),
        F.lit(CLOSING_ID).cast("long").alias("event_id"),
    )
    closing.where("false").write.parquet(f"{folder}/closing")
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{folder}/closing"))
    emitted = emitted_alerts(both, key, seconds, delay)
    run_to_end(emitted, "append", folder, batch_writer(folder))
    closing.write.mode("append").parquet(f"{folder}/closing")
    run_to_end(emitted, "append", folder, batch_writer(folder))
    written = spark.read.schema(emitted.schema).parquet(f"{folder}/out").select(*emitted.columns)
    return written.where(F.col("event_id") != CLOSING_ID)


def validate_to_sinks(
    spark: SparkSession, invoices: DataFrame, as_of: str, keep: list[str | Column], folder: str, headers: DataFrame | None = None, key: str = ""
) -> None:
    """Judges arriving nested invoices and writes them below target=valid and target=quarantine. With headers, a table, invoices
    have their key and arrays only."""
    judged = validate_nested(invoices, as_of, headers=headers, key=key)
    target = F.when(F.col("is_valid"), "valid").otherwise("quarantine").alias("target")
    run_to_end(judged.select(*keep, "n_errors", target), "append", folder, batch_writer(folder, "target"))
