"""Whole invoices from a stream of headers and lines."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASSEMBLED = "key string, outcome string, expected long, lines array<string>"
#: The open and closed invoices of a bucket, one entry each in every array but the last; `held` tells how many of `lines` are theirs.
STATE = "keys array<string>, expected array<long>, closed array<boolean>, newest array<long>, due array<long>, held array<int>, lines array<string>"
BUCKETS = 2_048


def assembled(headers: DataFrame, lines: DataFrame, key: str, delay: str = "1 hour", wait_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """One row for each invoice, and one for each batch of lines that came too late for theirs.

    headers: key, ts, n_lines (how many lines the invoice has). lines: key, ts and the line's own columns. Both are streams
    with event time. outcome is `whole` as soon as the header and all its lines are there, in whatever order they came;
    `partial` when the watermark passes the newest row by wait_seconds before that (expected is null without a header), and
    `late` for lines of an invoice that is closed already. Lines are JSON texts, sorted (see parsed_lines). Rows behind the
    watermark are dropped by Spark. State holds the lines of open invoices, and a mark for closed ones until the watermark
    passes them.

    Invoices are dealt out to `buckets` by their key, and Python is called once for a bucket, not once for an invoice. Each
    invoice keeps its own deadline; a bucket wakes at the first of them. Lines are shuffled with the types they have, by the
    partitioning that the state asks for; the texts, which are longer, are made after that.
    """
    named = [c for c in lines.columns if c not in (key, "ts")]
    items = lines.select(F.col(key).cast("string").alias("key"), "ts", F.lit(None).cast("long").alias("expected"), F.struct(*named).alias("line"))
    no_line = F.lit(None).cast(items.schema["line"].dataType).alias("line")
    heads = headers.select(F.col(key).cast("string").alias("key"), "ts", F.col("n_lines").cast("long").alias("expected"), no_line)
    both = heads.unionByName(items).withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select(bucket, "*").repartition(partitions, "bucket")
    stated, expected = F.col("expected").isNotNull().alias("stated"), F.coalesce("expected", F.lit(0)).alias("expected")
    rows = dealt.select("bucket", "key", "ts", stated, expected, F.to_json("line").alias("line"), F.unix_millis("ts").alias("ms"))

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, wait = state.getCurrentWatermarkMs(), 1000 * wait_seconds
        known, out, arrived = {}, [], {}
        if state.exists:
            *columns, texts = state.get
            at = 0
            for name, expected, closed, newest, due, n in zip(*columns):
                known[name] = [expected, closed, newest, due, list(texts[at : at + n])]
                at += n
        if not state.hasTimedOut:
            for part in batches:
                for name, stated, expected, line, ms in zip(*(part[c].tolist() for c in ("key", "stated", "expected", "line", "ms"))):
                    new = arrived.setdefault(name, [None, 0, []])
                    if stated and new[0] is None:
                        new[0] = expected
                    new[1] = max(new[1], ms)
                    if line is not None:
                        new[2].append(line)
        for name, (stated, ms, new_lines) in arrived.items():
            expected, closed, newest, _, held = known.get(name, (None, False, 0, 0, []))
            expected, newest, held = expected if stated is None else stated, max(newest, ms), held + new_lines
            if closed:
                if held:
                    out.append((name, "late", expected, sorted(held)))
                held = []
            elif expected is not None and len(held) >= expected:
                out.append((name, "whole", expected, sorted(held)))
                closed, held = True, []
            known[name] = [expected, closed, newest, max(newest + wait, mark + 1), held]
        for name in [k for k, v in known.items() if v[3] < mark and k not in arrived]:
            expected, closed, newest, _, held = known[name]
            if closed:
                del known[name]
            else:
                out.append((name, "partial", expected, sorted(held)))
                known[name] = [expected, True, newest, mark + wait + 1, []]
        if known:
            expected, closed, newest, due, held = (list(c) for c in zip(*known.values()))
            state.update((list(known), expected, closed, newest, due, [len(h) for h in held], [x for h in held for x in h]))
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "outcome", "expected", "lines"]).astype({"expected": "Int64"})

    return rows.groupBy("bucket").applyInPandasWithState(fold, ASSEMBLED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def parsed_lines(texts: str, schema: str) -> Column:
    """The lines of an assembled invoice as an array of structs."""
    return F.from_json(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), f"array<{schema}>")


def tax_breakdown(lines: str) -> Column:
    """Tax rows of an array of lines: one per rate and category, with taxable amount and tax, each line's tax rounded."""
    groups = F.array_distinct(F.transform(lines, lambda x: F.struct(x["vat_rate"].alias("r"), x["vat_category"].alias("c"))))

    def total(group: Column, amount) -> Column:
        own = F.filter(lines, lambda x: x["vat_rate"].eqNullSafe(group["r"]) & x["vat_category"].eqNullSafe(group["c"]))
        zero = F.lit(0).cast("decimal(18,4)")
        return F.aggregate(own, zero, lambda acc, x: (acc + F.coalesce(amount(x), zero)).cast("decimal(18,4)"))

    return F.transform(
        groups,
        lambda g: F.struct(
            total(g, lambda x: x["line_total"]).alias("taxable_amount"),
            total(g, lambda x: F.round(x["line_total"] * x["vat_rate"], 2)).alias("tax_amount"),
            g["r"].alias("tax_rate"),
            g["c"].alias("tax_category"),
        ),
    )
