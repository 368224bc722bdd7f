"""Connected components of a graph too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.session import materialize

_EDGE = "v long, p long"


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a[i]-b[i] reduced to one link (node, smallest node reachable) per linked node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        small, large = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        apart = small != large
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(root, large[apart], small[apart])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links in pieces of bounded size."""

    def star(held):
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        v, p = spanning(a, b)
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(p)], names=["v", "p"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 500_000:
            yield star(held)
            held, rows = [], 0
    if held:
        yield star(held)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "p"))).first())


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """The component of every node that has a link, from ``links`` (a long, b long).

    Returns (node, component) with the smallest node reachable as component. NULL ends and links
    of a node with itself are ignored; no links give no rows; repeated links change nothing.

    Tasks first reduce what they hold to stars. Then large-star and small-star steps alternate:
    every node is joined with the smallest parent of its parent, until each component is one star.
    Long chains halve in every round. A node of very many links is only ever counted by a
    pre-aggregated minimum and a join whose skewed side adaptive execution can split. Each round
    is a written table, so a lost executor costs one round at most.
    """
    ends = links.select(F.col(links.columns[0]).alias("v"), F.col(links.columns[1]).alias("p"))
    ends = ends.where("v IS NOT NULL AND p IS NOT NULL AND v <> p")
    edges = materialize(ends.mapInArrow(_stars, _EDGE), name)
    before = _state(edges)
    while True:
        least = edges.groupBy("v").agg(F.min("p").alias("least"))
        small = (
            edges.join(least, "v")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("v"), F.col("least").alias("p")),
                        F.struct(F.col("p").alias("v"), F.col("least").alias("p")),
                    )
                ).alias("edge")
            )
            .select("edge.*")
            .where("v <> p")
            .distinct()
        )
        small = materialize(small, name)
        above = small.groupBy("v").agg(F.min("p").alias("least")).withColumnRenamed("v", "p")
        large = small.join(above, "p", "left").select("v", F.coalesce("least", "p").alias("p"))
        edges = materialize(large.distinct(), name)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("node"), F.col("p").alias("component"))
