"""Mixing sources to target weights by repeating and sampling whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrail.llm.text import free_names, word_count
from shoptrail.session import materialize

# The draw of a document: the first 48 bits of a digest, as a share of 2**48.
_DRAW = "CAST(conv(substr(md5(concat('{seed}:', coalesce(CAST(doc_id AS STRING), ''))), 1, 12), 16, 10) AS BIGINT) / 281474976710656D"


def weights_in_turn(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the weights of ``cycle`` in turn, sources by code point, NULL last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*(F.lit(float(w)) for w in cycle))
    turn = (F.row_number().over(order) - 1) % len(cycle)
    return sizes.select("source", F.element_at(values, (turn + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, most: float = 3.0) -> DataFrame:
    """Share the total of ``sizes`` (source, source_size) by ``weights`` (source, weight).

    No target exceeds ``most`` times its source; the excess is shared among the others by weight
    until none is above. That is the level L with sum(min(most * size, L * weight)) = total: with
    sources in order of most * size / weight, those before some place are full and the rest get
    L * weight. Returns (source, source_size, target). The window runs over one row per source.
    """
    given = weights.select(F.col("source").alias("_source"), "weight")
    known = sizes.join(given, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "source_size", "weight", (F.col("source_size") * most).alias("full")
    )
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(
        after
    )
    # The first source that the level of its place and all later ones does not fill.
    open_level = F.when(level * F.col("weight") <= F.col("full"), level)
    found = known.withColumn("open_level", open_level).withColumn(
        "level", F.first("open_level", ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    share = F.least(F.col("full"), F.col("level") * F.col("weight"))
    return found.select("source", "source_size", F.coalesce(share, "full").alias("target"))


def mix_plan(docs: DataFrame, weights: DataFrame | None = None, most: float = 3.0, seed: int = 42
             ) -> DataFrame:
    """How often the mix takes each document.

    Returns all columns of ``docs`` and size (words), source_size, target, copies and taken (words,
    repeats counted). A source repeats at target / source_size; each document is taken floor(rate)
    times, and once more if the draw of its id lies below the fraction. ``weights`` (source,
    weight) default to 1, 2, 3 in turn. NULL texts have size 0, a NULL source is a source of its
    own, a NULL id draws as ''; repeated rows draw alike; a source of size 0 has target 0 and its
    documents are not taken; an empty table gives no rows. Columns of ``docs`` with the names of
    the result's are replaced.

    Only (source, size) is aggregated, before the shuffle. The targets, one row per source, are
    written first, so Spark knows their size when it plans the join: below its threshold it
    broadcasts them and the texts stay where they are; beyond it shuffles both and splits a source
    that holds much of all rows.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    sized = docs.drop(*added).withColumn("size", word_count(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weights = weights_in_turn(sizes)
    (source,) = free_names(sized, "_source")
    goal = materialize(
        targets(sizes, weights, most).withColumnRenamed("source", source), "mix-targets"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.expr(_DRAW.format(seed=seed))
    whole = F.floor(rate)
    extra = (draw < rate - whole).cast("long")
    return (
        sized.join(goal, F.col("source").eqNullSafe(F.col(source)))
        .drop(source)
        .withColumn("copies", whole + extra)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, most: float = 3.0, seed: int = 42
        ) -> DataFrame:
    """The mixed documents themselves: every row as often as ``mix_plan`` takes it."""
    plan = mix_plan(docs, weights, most, seed).where("copies > 0")
    (copy,) = free_names(plan, "_copy")
    return plan.withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select(*docs.columns)
