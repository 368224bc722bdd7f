"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.components import connected_components, spanning
from shoptrail.llm.vectors import dimensions, matrix, usable
from shoptrail.session import materialize

_BITS = 62


# The normal distribution function on a grid.
_GRID = np.linspace(-9, 9, 9001)
_NORMAL = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in _GRID])


def _planes(dim: int, pass_no: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, pass_no]).standard_normal((dim, _BITS))


def _agreement(heights: np.ndarray, cosine: float) -> np.ndarray:
    """Per row and number of leading bits, the log of the chance that a partner at ``cosine``, in
    any direction from the row, agrees in them.

    A row's height z over a plane makes the partner's cosine * z + sine * (a normal number). That
    many rows of a dense region agree in a bit shows in their heights, and costs no credit.
    """
    steep = cosine / max(math.sqrt(max(0.0, 1 - cosine * cosine)), 1e-12)
    return np.log(np.interp(steep * np.abs(heights), _GRID, _NORMAL)).cumsum(axis=1)


def _missed(keys: np.ndarray, agree: np.ndarray, window: int, whole: bool) -> np.ndarray:
    """Per row of sorted keys, the log of the chance at most that a pass missed a partner;
    ``agree`` is the rows' ``_agreement``.

    Rows that share more leading bits with a row than its ``window``-th neighbours do lie between
    these. Beyond the ends are no rows if the keys are the ``whole`` table, else unknown ones, and
    a row that lacks a neighbour is not credited.
    """
    below = np.full(len(keys), 0 if whole else _BITS + 1)
    above = below.copy()
    if len(keys) > window:
        differ = keys[:-window] ^ keys[window:]
        for shift in (1, 2, 4, 8, 16, 32):
            differ |= differ >> shift
        bits = _BITS - np.bitwise_count(differ).astype(np.int64) + 1
        above[:-window] = below[window:] = bits
    bits = np.maximum(below, above)
    met = np.exp(agree[np.arange(len(keys)), np.clip(bits, 1, _BITS) - 1].astype(np.float64))
    met = np.where(bits > _BITS, 0.0, np.where(bits == 0, 1.0, met))
    with np.errstate(divide="ignore"):
        return np.log1p(-met)


def _sorted_keys(dim: int, pass_no: int, seed: int):
    """Sign bits of random projections, the first one highest."""
    planes = _planes(dim, pass_no, seed)
    powers = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = (matrix(batch.column("unit")) @ planes > 0) @ powers
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("vector"), batch.column("unit")],
                names=["key", "vector", "unit"],
            )

    return run


def _pairs(ids: np.ndarray, units: np.ndarray, window: int, cosine: float, first: int = 0):
    """Verified pairs of rows at most ``window`` places apart, of which the later one has at least
    the index ``first``."""
    a, b = [], []
    for step in range(1, min(window, len(ids) - 1) + 1):
        low = max(0, first - step)
        near = np.einsum("ij,ij->i", units[low:-step], units[low + step :]) >= cosine
        at = np.flatnonzero(near) + low
        a.append(ids[at]), b.append(ids[at + step])
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


_EDGE = "v long, p long, part int, key long, vector long, unit array<double>, missed double"


def _windows(window: int, cosine: float, planes: np.ndarray, whole: bool):
    """Compare neighbours in one sorted partition; its first and last rows go on as seams, and what
    each row may have missed is told."""

    def table(v, p, part=None, key=None, ids=None, units=None, missed=None):
        n = len(v) if ids is None else len(ids)
        none = pa.nulls(n, pa.int64())
        no_part, no_unit = pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64()))
        no_miss = pa.nulls(n, pa.float64())
        if ids is None:
            columns = [pa.array(v), pa.array(p), no_part, none, none, no_unit, no_miss]
        elif part is None:
            columns = [none, none, no_part, none, pa.array(ids), no_unit, pa.array(missed)]
        else:
            columns = [none, none, pa.array(np.full(n, part, np.int32)), pa.array(key),
                       pa.array(ids), pa.array(list(units), pa.list_(pa.float64())), no_miss]
        return pa.RecordBatch.from_arrays(
            columns, names=["v", "p", "part", "key", "vector", "unit", "missed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys = ids = units = head = None
        all_keys, all_ids, agree = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            own = batch.column("vector").to_numpy()
            unit = matrix(batch.column("unit"))
            all_keys.append(key), all_ids.append(own)
            agree.append(_agreement(unit @ planes, cosine).astype(np.float32))
            kept = 0
            if ids is not None:
                kept = len(ids)
                key, own, unit = (np.concatenate(x) for x in (
                    (keys, key), (ids, own), (units, unit)))
            if head is None or len(head[0]) < window:
                head = tuple(x[:window].copy() for x in (key, own, unit))
            a, b = _pairs(own, unit, window, cosine, kept)
            yield table(*spanning(a, b))
            keys, ids, units = (x[-window:] for x in (key, own, unit))
        if ids is not None:
            # The start of a partition meets the end of the one before.
            yield table((), (), 2 * part, *head)
            yield table((), (), 2 * part + 1, keys, ids, units)
            missed = _missed(*map(np.concatenate, (all_keys, agree)), window, whole)
            yield table((), (), ids=np.concatenate(all_ids), missed=missed)

    return run


def _seam(window: int, cosine: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("vector").to_numpy(), rows.column("key").to_numpy(),
                            rows.column("part").to_numpy()))
        rows = rows.take(pa.array(order))
        a, b = _pairs(rows.column("vector").to_numpy(), matrix(rows.column("unit")), window, cosine)
        v, p = spanning(a, b)
        return pa.table({"v": v, "p": p})

    return run


def _counts(cosine: float, block: int):
    """Exact link counts of one pair of blocks of a component, and the links' forest."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        side = rows.column("block").to_numpy()
        ids, copies = rows.column("vector").to_numpy(), rows.column("copies").to_numpy()
        units = matrix(rows.column("unit"))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for start in range(0, len(left), 1024):
            rows_a = left[start : start + 1024]
            near = units[rows_a] @ units[right].T >= cosine
            near &= ids[rows_a][:, None] != ids[right][None, :]
            a[start : start + 1024] = near @ copies[right]
            b += copies[rows_a] @ near
        if i == j:
            return pa.table({"vector": ids[left], "links": a})
        return pa.table({"vector": np.concatenate([ids[left], ids[right]]),
                         "links": np.concatenate([a, b])})

    return run


def _forest(cosine: float):
    """A forest of the links in one pair of blocks."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        side, ids = rows.column("block").to_numpy(), rows.column("vector").to_numpy()
        units = matrix(rows.column("unit"))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        v = p = np.zeros(0, np.int64)
        for start in range(0, len(left), 1024):
            rows_a = left[start : start + 1024]
            a, b = np.nonzero(units[rows_a] @ units[right].T >= cosine)
            v, p = spanning(np.concatenate([v, ids[rows_a][a]]),
                            np.concatenate([p, ids[right][b]]))
        return pa.table({"v": v, "p": p})

    return run


def _classes(embeddings: DataFrame) -> DataFrame:
    """Distinct usable vectors: (vector, copies, least, unit), named by a number of their own."""
    values = embeddings.where(usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    # 0.0 and -0.0 are one value, as for grouping.
    classes = values.groupBy("embedding").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return classes.withColumn("norm", norm).where("norm > 0").select(
        F.xxhash64("embedding").alias("vector"), "copies", "least", "embedding",
        F.transform("embedding", lambda x: x / F.col("norm")).alias("unit"),
    )


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, window: int = 64,
                 recall: float = 0.97, block: int = 2048, seed: int = 42) -> DataFrame:
    """Link vectors of ``embeddings`` (vec_id, embedding) whose cosine is at least ``cosine``.

    Returns one row per row: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable) and kept (vec_id = component_id). Vectors that are NULL, empty,
    zero or hold NULL or non-finite components link with nothing and are components of their own;
    vectors of different lengths never link; equal vectors are one class that always links; a NULL
    id names no component unless all its ids are NULL; an empty table gives no rows.

    Each pass sorts the distinct vectors by concatenated signs of random projections and compares
    each with its ``window`` neighbours, across partition borders too. Passes go on until every
    vector has met a partner at the very threshold with probability ``recall``, counted from the
    leading bits it shares with the ends of its own window and its distances from their planes; so a vector in a dense region stays for
    more passes than others, and where that would cost more, the vectors left are all compared with
    each other. What is met is verified in double precision and united across passes. No window
    limits the links: inside each component, in pairs of blocks of ``block`` vectors, all links are
    counted.
    """
    classes = materialize(_classes(embeddings), "vector-classes")
    spark = embeddings.sparkSession
    edges = spark.createDataFrame([], "v long, p long")
    for dim in dimensions(classes, "unit"):
        part = classes.where(F.size("unit") == dim).select("vector", "unit")
        edges = edges.unionByName(_met(part, dim, cosine, window, recall, block, seed))
    roots = connected_components(edges, "vector-links").withColumnRenamed("node", "vector")
    linked = classes.join(roots, "vector", "left").select(
        "vector", "copies", "least", "unit", "component"
    )
    # The smallest of a component has no row of its own among the roots.
    hubs = roots.select(F.col("component").alias("vector")).distinct().withColumn(
        "hub", F.col("vector")
    )
    linked = linked.join(hubs, "vector", "left").select(
        "vector", "copies", "least", "unit", F.coalesce("component", "hub").alias("component")
    )
    linked = materialize(linked, "linked-vectors")
    links = _component_links(linked.where("component IS NOT NULL"), cosine, block)
    named = linked.withColumn("component", F.coalesce("component", "vector"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = named.join(ids, "component").join(links, "vector", "left").select(
        "vector", "component_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
    good = F.when(usable(F.col("embedding")), F.xxhash64(F.col("embedding").cast("array<double>")))
    rows = embeddings.select("vec_id", good.alias("_vector"))
    found = rows.join(out, F.col("_vector") == F.col("vector"), "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _met(vectors: DataFrame, dim: int, cosine: float, window: int, recall: float, block: int,
         seed: int) -> DataFrame:
    """Links (v, p) of vectors of one length that the passes meet."""
    edges = vectors.sparkSession.createDataFrame([], "v long, p long")
    # A pair is parted as soon as either of its vectors has enough: each may take half of the misses.
    enough = math.log((1 - recall) / 2) if recall < 1 else -math.inf
    part, state, count, passes = vectors, None, vectors.count(), 0
    while count:
        tasks = max(1, count // 4096)
        keyed = part.mapInArrow(
            _sorted_keys(dim, passes, seed), "key long, vector long, unit array<double>"
        )
        ordered = keyed.repartitionByRange(tasks, "key", "vector").sortWithinPartitions(
            "key", "vector"
        )
        found = materialize(
            ordered.mapInArrow(
                _windows(window, cosine, _planes(dim, passes, seed), tasks == 1), _EDGE
            ),
            "pass",
        )
        seams = (
            found.where("part IS NOT NULL")
            .withColumn("seam", F.expr("(part + 1) div 2"))
            .groupBy("seam")
            .applyInArrow(_seam(window, cosine), "v long, p long")
        )
        edges = edges.unionByName(found.where("v IS NOT NULL").select("v", "p")).unionByName(seams)
        passes += 1
        # A vector that has met its partners need not stay: its pairs have been met.
        now = found.where("missed IS NOT NULL").select("vector", "missed")
        if state is not None:
            now = now.withColumnRenamed("missed", "more").join(state, "vector").selectExpr(
                "vector", "missed + more AS missed"
            )
        state = materialize(now.where(F.col("missed") > enough), "vectors-left")
        count, mean = state.agg(F.count("*"), F.avg("missed")).first()
        if not count:
            break
        part = vectors.join(state.select("vector"), "vector", "left_semi")
        more = passes * (enough / mean - 1) if mean < 0 else math.inf
        if count <= 2 * window * max(1, more):
            pairs = _block_pairs(
                part.withColumns({"component": F.lit(0), "copies": F.lit(1)}), block
            )
            rest = pairs.groupBy("component", "i", "j").applyInArrow(
                _forest(cosine), "v long, p long"
            )
            return edges.unionByName(rest)
    return edges


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """The members of each component, cut into blocks, at each pair of blocks they are part of."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    cut = sizes.withColumn("blocks", F.expr(f"CAST(1 + (size - 1) div {block} AS INT)"))
    placed = members.join(cut, "component").withColumn(
        "block", F.expr("CAST(pmod(xxhash64(vector, 1), blocks) AS INT)")
    )
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "component",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block", "vector", "copies", "unit",
    )
    # Dealt out by pair of blocks; the join before leaves a component in one task.
    return pairs.repartition("component", "i", "j")


def _component_links(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(vector, links): how many vectors of its component each vector links with, copies counted.

    A component is cut into blocks, each block is sent to the pairs it is part of, and only counts
    come back.
    """
    pairs = _block_pairs(members, block)
    found = pairs.groupBy("component", "i", "j").applyInArrow(
        _counts(cosine, block), "vector long, links long"
    )
    return found.groupBy("vector").agg(F.sum("links").alias("links"))
