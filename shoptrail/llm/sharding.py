"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrail.llm.text import free_names


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) that draws the lowest -ln(u) / weight for ``key``.

    u in (0, 1) comes from a hash of key and shard, so a record moves only if a shard that it
    prefers appears or its own goes or changes weight. Ties go to the smaller shard; shards of
    weight 0 get nothing; a NULL key is a key of its own.
    """
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 53 bits of the hash, and a half so that u is never 0.
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
            u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"),
                                  F.lit(shard).alias("shard")))
    if not draws:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*draws))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id",
          tie: Sequence[str] = (), part_rows: int = 50_000) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    Slots follow a hash of key and ``tie`` columns: shards are cut into parts of about
    ``part_rows`` rows, the rows are numbered within their part, and the counts of the parts before
    are added. So no task holds a shard, and a key of very many rows is spread by ``tie``. Rows
    equal in key and tie are interchangeable. NULL keys are one key; an empty table gives no rows;
    columns named shard or slot are replaced.
    """
    rows = docs.drop("shard", "slot").withColumn("shard", rendezvous(F.col(key), weights))
    parts = max(1, docs.count() // (part_rows * max(1, len(weights))))
    part, size, earlier, place = free_names(rows, "_part", "_rows", "_before", "_own")
    mixed = F.xxhash64(key, *tie, F.lit("slot"))
    rows = rows.withColumn(part, F.pmod(mixed, F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", part).agg(F.count("*").alias(size))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "shard", part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(earlier)
    )
    own = Window.partitionBy("shard", part).orderBy(key, *tie)
    numbered = rows.withColumn(place, F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", part]).withColumn(
        "slot", (F.col(earlier) + F.col(place)).cast("long")
    ).drop(part, place, earlier)
