"""Chains of places on a line: each is the first one more than a given way behind the one before.

Emitted alerts of a cool-down are such chains in time, the first lines of table rows such chains down a page. Places are
whole numbers, so distances are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.folders import written


def group_key(keys: list[str]) -> Column:
    """The keys as one column that is never null, so that rows without a key meet in joins as they do in groups."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def bucket_of(place: str, width: int) -> Column:
    """floor(place / width) of whole numbers, without the rounding of a division."""
    return F.expr(f"({place} - pmod({place}, {width}L)) div {width}L")


def _filled_buckets(levels: DataFrame, wait: int) -> DataFrame:
    """For each filled bucket of a key, as long as the wait: its first level, the first level two buckets on or later, and
    whether it opens an island, i.e. follows an empty bucket."""
    of_key = Window.partitionBy("_key").orderBy("_bucket")
    near, far = ((F.lead("_bucket", n).over(of_key), F.lead("_first", n).over(of_key)) for n in (1, 2))
    buckets = levels.groupBy("_key", "_bucket").agg(F.min("_at").alias("_first"))
    behind = F.lag("_bucket").over(of_key)
    return buckets.select(
        "_key",
        "_bucket",
        "_first",
        F.when(near[0] > F.col("_bucket") + 1, near[1]).otherwise(far[1]).alias("_beyond"),
        (behind.isNull() | (F.col("_bucket") > behind + 1)).alias("_opens"),
    )


def successors(levels: DataFrame, wait: int) -> DataFrame:
    """(_key, _at, _next, _start) for distinct places of a key: the first place more than `wait` behind it, and whether it is
    in the chain whatever came before. Places are dealt out by key and bucket, so a key is spread over its buckets.

    The successor of a place lies in the next bucket or beyond. Within the next bucket, places and probes (place plus wait)
    are read downwards, and a probe takes the last place seen above it; where there is none, the bucket table knows what follows.
    """
    placed = levels.withColumn("_bucket", bucket_of("_at", wait))
    with_bucket = placed.join(_filled_buckets(placed, wait), ["_key", "_bucket"])
    probes = with_bucket.select(
        "_key",
        (F.col("_bucket") + 1).alias("_bucket"),
        (F.col("_at") + F.lit(wait)).alias("_where"),
        F.struct("_at", "_beyond", (F.col("_opens") & (F.col("_at") == F.col("_first"))).alias("_start")).alias("_probe"),
    )
    none = F.lit(None).cast(probes.schema["_probe"].dataType)
    both = probes.unionByName(placed.select("_key", "_bucket", F.col("_at").alias("_where"), none.alias("_probe")))
    downwards = Window.partitionBy("_key", "_bucket").orderBy(F.col("_where").desc(), F.col("_probe").isNull())
    level = F.when(F.col("_probe").isNull(), F.col("_where"))
    above = F.last(level, ignorenulls=True).over(downwards.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_above", above).where(F.col("_probe").isNotNull())
    return found.select(
        "_key", F.col("_probe._at").alias("_at"), F.coalesce("_above", F.col("_probe._beyond")).alias("_next"), F.col("_probe._start").alias("_start")
    )


def chain(levels: DataFrame, wait: int) -> DataFrame:
    """(_key, _at) of the places in the chain of each key: from the first of each island along the successors. An island
    begins behind a gap of more than `wait`, which always lets its first place in.

    Pointer doubling: after round r the first 2^r places of every island's chain are known, and pointers lead 2^r places on,
    so the rounds are the logarithm of the longest chain. Each round is two joins by key and place, written
    to the shared folder.
    """
    pointers = written(successors(levels, wait), "pointers")
    starts = pointers.where("_start").select("_key", "_at")
    inner = pointers.select("_key", F.col("_at").alias("_from"), F.col("_next").alias("_at")).where("_at is not null")
    jumps = written(inner.join(starts, ["_key", "_at"], "left_anti").select("_key", F.col("_from").alias("_at"), F.col("_at").alias("_next")), "jumps")
    known, newest = [written(starts, "chain")], starts
    while True:
        reached = known[0]
        for more in known[1:]:
            reached = reached.unionByName(more)
        newest = written(reached.join(jumps, ["_key", "_at"]).select("_key", F.col("_next").alias("_at")), "chain")
        if newest.isEmpty():
            return reached
        known.append(newest)
        onward = jumps.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
        jumps = written(jumps.join(onward, ["_key", "_next"]).select("_key", "_at", F.col("_then").alias("_next")), "jumps")
