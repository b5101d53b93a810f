"""Statistics over the processing log, metric samples and health checks.

Operations and metrics are few, so each holds a large share of all rows. Everything is reduced by partial aggregation
before the shuffle; nothing sorts all rows of one operation in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv

QUANTILES = {"p50_duration": 0.5, "p90_duration": 0.9, "p95_duration": 0.95, "p99_duration": 0.99}


def since(ts: str, now: str, hours: int) -> Column:
    return F.col(ts) > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")


def counts(key: list[str]) -> list[Column]:
    good = F.count_if(F.col("success")).alias("successful_operations")
    return [F.count("*").alias("total_operations"), good, F.count_if(~F.col("success")).alias("failed_operations")]


STEP_BITS = 16  # bits of the order code that one count settles


def order_code(value: Column) -> Column:
    """A 64-bit integer that orders like the double: its bits, turned over below zero. NaN comes last, -0.0 equals 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def value_of(code: Column) -> Column:
    bits = F.when(code >= 0, code).otherwise(code.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def index_percentiles(log: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact value at 0-based position floor(n * q) of each key's sorted values; nulls don't count.

    Selection by radix on an order-preserving 64-bit code, 16 bits a step: each step counts the next digit among the rows
    that share the digits found so far, by partial aggregation, and running counts over the digits tell where each position
    lies. Four steps give the code. At most 65,536 counts a key and prefix are shuffled, however the values lie.
    """
    key_type = log.schema[key].dataType
    coded = log.where(F.col(value).isNotNull()).select(F.struct(key).alias("_key"), order_code(F.col(value)).alias("_code"))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.floor(F.col("_total") * F.lit(q)).cast("long").alias("at")) for n, q in quantiles.items()])
    found = None
    for left in range(64 - STEP_BITS, -1, -STEP_BITS):
        group = ["_key"] if found is None else ["_key", "_prefix", "_wanted"]
        rows = coded.withColumn("_digits", F.shiftright("_code", left))
        if found is not None:
            rows = rows.withColumn("_prefix", F.shiftright("_digits", STEP_BITS)).join(found, ["_key", "_prefix"])
        counted = rows.groupBy(*group, "_digits").agg(F.count("*").alias("_n"))
        of_group = Window.partitionBy(*group)
        upto = F.sum("_n").over(of_group.orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("_upto", upto)
        if found is None:
            counted = counted.withColumn("_total", F.sum("_n").over(of_group)).withColumn("_wanted", wanted)
        before = F.col("_upto") - F.col("_n")
        inside = F.filter("_wanted", lambda x: (x["at"] >= before) & (x["at"] < F.col("_upto")))  # noqa: B023
        rest = F.transform(inside, lambda x: F.struct(x["name"].alias("name"), (x["at"] - before).alias("at")))  # noqa: B023
        found = counted.select("_key", F.col("_digits").alias("_prefix"), rest.alias("_wanted")).where(F.size("_wanted") > 0)
    picks = found.select("_key", value_of(F.col("_prefix")).alias("_value"), F.explode("_wanted.name").alias("_name"))
    marks = picks.groupBy("_key").agg(*[F.max(F.when(F.col("_name") == q, F.col("_value"))).alias(q) for q in quantiles])
    return marks.select(F.col(f"_key.{key}").cast(key_type).alias(key), *quantiles)


def performance_stats(log: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Counts, rates, durations and index percentiles per operation over the last hours."""
    recent = log.where(since("ts", now, hours)).select("operation", "duration", "success")
    stats = recent.groupBy("operation").agg(
        *counts(["operation"]),
        F.avg("duration").alias("average_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
    )
    marks = index_percentiles(recent, "operation", "duration", QUANTILES)
    n = F.col("total_operations")
    return stats.join(marks, "operation").withColumns(
        {
            "period_hours": F.lit(hours),
            "success_rate": F.col("successful_operations") / n,
            "operations_per_hour": n / F.lit(float(hours)),
            "median_duration": F.col("p50_duration"),
        }
    )


def processing_stats(log: DataFrame) -> DataFrame:
    """Running totals over the whole log."""
    return log.agg(
        F.count("*").alias("processed_count"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_processing_time"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_processing_time"),
    )


def operation_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(
        F.count_if(F.col("success")).alias("success_count"), F.count_if(~F.col("success")).alias("error_count")
    )


def batch_summary(results: DataFrame, batch: str) -> DataFrame:
    """Files, failures, success rate and time per batch."""
    total = F.count("*")
    done = F.count_if(F.col("success"))
    return results.groupBy(batch).agg(
        total.alias("total_files"),
        done.alias("processed_files"),
        F.count_if(~F.col("success")).alias("failed_files"),
        F.when(total == 0, 0.0).otherwise(done / total).alias("success_rate"),
        F.sum("duration").alias("processing_time"),
    )


def request_metrics(log: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, total and mean time per model and backend."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        F.sum("duration").alias("total_time"),
        F.avg("duration").alias("avg_time_per_request"),
    )


def error_rate(log: DataFrame, now: str, hours: int = 1) -> DataFrame:
    """One row: share of failed operations over the last hours, null when there were none."""
    return log.where(since("ts", now, hours)).agg(
        F.count("*").alias("total_operations"), (1 - F.count_if(F.col("success")) / F.count("*")).alias("error_rate")
    )


def slow_operations(log: DataFrame, seconds: float = 5.0) -> DataFrame:
    return log.where(F.col("duration") > seconds)


def newest(df: DataFrame, key: str | None, n: int, tie: str = "event_id") -> DataFrame:
    """Newest n rows, of the table or of each key. Spark keeps only n rows per key and task before the shuffle."""
    order = [F.col("ts").desc(), F.col(tie).desc()]
    if key is None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def history(samples: DataFrame, metric: str, now: str, hours: int) -> DataFrame:
    return samples.where((F.col("metric") == metric) & since("ts", now, hours))


def retained(df: DataFrame, now: str, days: int = 7) -> DataFrame:
    return df.where(since("ts", now, days * 24))


def threshold_table(spark: SparkSession, thresholds: dict[str, float] = fv.ALERT_THRESHOLDS) -> DataFrame:
    """Thresholds as literal rows: Spark knows their size and need not shuffle the samples by their few metrics."""
    rows = ", ".join(f"('{metric}', CAST({limit} AS DOUBLE))" for metric, limit in thresholds.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(metric, threshold)")


def breaches(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples above the threshold of their metric; an error rate is critical, the rest warnings."""
    severity = F.when(F.col("metric") == "error_rate", "critical").otherwise("warning")
    return (
        samples.join(thresholds, "metric").where(F.col("value") > F.col("threshold")).withColumn("severity", severity)
    )


def health_rollup(samples: DataFrame, warn_at: float = 90.0) -> DataFrame:
    """Latest status of each check per host, and the worst of them as the host's health. A missing value is an error."""
    latest = samples.groupBy("host", "metric").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    level = F.when(F.col("value").isNull(), 2).when(F.col("value") >= warn_at, 1).otherwise(0)
    worst = latest.groupBy("host").agg(
        F.max(level).alias("level"), F.count_if(level == 1).alias("warnings"), F.count("*").alias("checks")
    )
    status = F.when(F.col("level") == 2, "unhealthy").when(F.col("level") == 1, "degraded").otherwise("healthy")
    return worst.select("host", status.alias("status"), "warnings", "checks")
