"""Salting of heavy keys only, found by a frequent-items sketch."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a sketch returns, and those it tracks at a time: fixed sizes, whatever the data.
MOST_HEAVY = 1000
_TRACKED = 8192


def heavy_keys(rows: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """(key, salts) of keys that may have more than ``rows_per_task`` rows, about MOST_HEAVY.

    ``salts`` is the number of tasks that their rows need. The sketch of Spark's ``approx_top_k``
    has a fixed size per task and is merged like any partial aggregate. It may miss keys with less
    than a thousandth of all rows, and its counts may be too high by as much, not too low; a light
    key that is salted costs nothing but a few more partial rows. NULL is a key too, counted apart.
    """
    top = F.expr(f"approx_top_k(`{key}`, {MOST_HEAVY}, {_TRACKED})")
    found = rows.agg(top.alias("top"), F.count_if(F.col(key).isNull()).alias("nulls"))
    kind = rows.schema[key].dataType.simpleString()
    null = F.expr(f"named_struct('item', CAST(NULL AS {kind}), 'count', nulls)")
    listed = F.filter(F.coalesce("top", F.array()), lambda x: x["item"].isNotNull())
    every = found.select(F.explode(F.concat(listed, F.array(null))).alias("found"))
    salts = F.ceil(F.col("found.count") / F.lit(rows_per_task)).cast("int")
    return every.select(F.col("found.item").alias(key), salts.alias("salts")).where("salts > 1")


def salt_heavy(
    rows: DataFrame, key: str, by: Sequence[str], rows_per_task: int,
    heavy: DataFrame | None = None, name: str = "salt",
) -> DataFrame:
    """Rows with a salt: 0 for light keys, 0 to salts - 1 by a hash of ``by`` for heavy ones.

    A repeated task draws the same salts again. The list of heavy keys is bounded, so it is
    broadcast.
    """
    heavy = heavy_keys(rows, key, rows_per_task) if heavy is None else heavy
    listed = heavy.select(F.col(key).alias("_heavy"), F.col("salts").alias("_salts"))
    joined = rows.join(F.broadcast(listed), F.col(key).eqNullSafe(F.col("_heavy")), "left")
    salts = F.coalesce("_salts", F.lit(1))
    return joined.withColumn(
        name, F.pmod(F.xxhash64(*by), salts.cast("long")).cast("int")
    ).drop("_heavy", "_salts")


def salted_aggregate(
    rows: DataFrame, key: str, by: Sequence[str], partial: Sequence[Column],
    total: Sequence[Column], rows_per_task: int,
) -> DataFrame:
    """Aggregate per key and salt, then per key.

    ``partial`` are the aggregates of a salt, ``total`` those that combine them. Rows that agree
    in ``by`` have one salt, so distinct counts of ``by`` add up exactly.
    """
    salted = salt_heavy(rows, key, by, rows_per_task)
    return salted.groupBy(key, "salt").agg(*partial).groupBy(key).agg(*total)


def salted_count_skewed(
    rows: DataFrame, key: str, distinct: str, rows_per_task: int = 1_000_000
) -> DataFrame:
    """Rows and distinct values of another column per key, with the rows of heavy keys dealt to
    several tasks. NULL is no value, but a key of its own."""
    return salted_aggregate(
        rows, key, [distinct],
        [F.count("*").alias("rows"), F.count_distinct(distinct).alias("values")],
        [F.sum("rows").alias("row_count"), F.sum("values").alias("distinct_count")],
        rows_per_task,
    )


def fair_share(rows: int, tasks: int) -> int:
    """Rows of a task if all are dealt evenly."""
    return math.ceil(rows / max(1, tasks))
