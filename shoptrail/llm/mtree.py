"""Exact search for the highest inner products by M-trees over stored pages."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrail.llm.vectors import dimensions, matrix, usable
from shoptrail.session import materialize

_FAN, _LEAF = 32, 128
_SLACK = 1e-7

# Roots of pages that one row of the top level holds.
_ROOTS = 2048


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)))


class MTree:
    """A metric tree over integer vectors for inner products.

    With one more component sqrt(top - |x|^2), ``top`` being the largest square of a norm, the
    highest inner product becomes the smallest Euclidean distance: d(q, x)^2 = |q|^2 + top - 2 q x.
    A node has a routing vector, a covering radius and the distance to its parent's vector; its
    children or its entries stand next to each other. Entries keep the distance to their node's
    vector.
    """

    def __init__(self, ids, rows, top, nodes, near):
        self.ids, self.rows, self.top = ids, rows, float(top)
        self.nodes, self.near = nodes, near
        self.real = rows.astype(np.float64)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, top: float) -> MTree:
        real = rows.astype(np.float64)
        more = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", real, real)))

        def distance(at, pivot):
            square = ((real[at] - real[pivot]) ** 2).sum(axis=1) + (more[at] - more[pivot]) ** 2
            return np.sqrt(square)

        order, near = np.empty(len(ids), np.int64), np.empty(len(ids))
        everyone = np.arange(len(ids))
        # pivot, radius, distance to parent, first, last (entries if leaf, else nodes), leaf
        nodes = [None]
        todo, filled = [(0, everyone, 0, 0.0)], 0
        while todo:
            number, at, pivot, up = todo.pop(0)
            far = distance(at, pivot)
            radius = float(far.max())
            if len(at) <= _LEAF or radius == 0.0:
                order[filled : filled + len(at)], near[filled : filled + len(at)] = at, far
                nodes[number] = (pivot, radius, up, filled, filled + len(at), 1)
                filled += len(at)
                continue
            # Routing vectors spread out: each the farthest from those taken before.
            chosen, least, whose = [], far.copy(), np.zeros(len(at), np.int64)
            fan = min(_FAN, -(-len(at) // _LEAF) + 1)
            for k in range(fan):
                pick = int(np.argmax(least)) if k else 0
                if k and least[pick] == 0.0:
                    break
                chosen.append(int(at[pick]))
                away = distance(at, chosen[-1])
                closer = away < least if k else np.ones(len(at), bool)
                whose[closer], least[closer] = k, away[closer]
            first = len(nodes)
            up_to = distance(np.array(chosen), pivot)
            for k, own in enumerate(chosen):
                nodes.append(None)
                todo.append((first + k, at[whose == k], own, float(up_to[k])))
            nodes[number] = (pivot, radius, up, first, len(nodes), 0)
        place = np.empty(len(ids), np.int64)
        place[order] = everyone
        table = np.array(nodes, np.float64)
        table[:, 0] = place[table[:, 0].astype(np.int64)]
        return cls(ids[order], rows[order], top, table, near)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (self.ids.tobytes(), self.rows.tobytes(), self.nodes.tobytes(), self.near.tobytes())

    @classmethod
    def unpack(cls, ids: bytes, rows: bytes, nodes: bytes, near: bytes, top: float) -> MTree:
        ids = np.frombuffer(ids, np.int64)
        return cls(ids, np.frombuffer(rows, np.int64).reshape(len(ids), -1), top,
                   np.frombuffer(nodes, np.float64).reshape(-1, 6), np.frombuffer(near, np.float64))

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None = None
               ) -> list[tuple[int, int]]:
        """The ``k`` best (score, vec_id) of others than ``own``, ties to the smaller id; with
        ``floor`` those of at least that score only."""
        pivot, radius, up, first, last, leaf = self.nodes.T
        pivot, first, last = (x.astype(np.int64) for x in (pivot, first, last))
        real = query.astype(np.float64)
        base = float(real @ real) + self.top
        slack = _SLACK * (1.0 + np.sqrt(base))

        def away(at):
            return np.sqrt(np.maximum(0.0, base - 2.0 * (self.real[at] @ real)))

        def limit(score):
            return np.sqrt(max(0.0, base - 2.0 * score)) + slack

        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
        reach = np.inf if floor is None else limit(floor)
        root = float(away(pivot[:1])[0])
        heap = [(max(0.0, root - radius[0]), 0, root)]
        while heap:
            bound, node, far = heapq.heappop(heap)
            if bound > reach:
                break
            a, b = first[node], last[node]
            if not leaf[node]:
                # The distance to the parent's vector alone rules out some children.
                at = a + np.flatnonzero(np.abs(far - up[a:b]) - radius[a:b] <= reach)
                if len(at):
                    distances = away(pivot[at])
                    bounds = np.maximum(0.0, distances - radius[at])
                    for n in np.flatnonzero(bounds <= reach).tolist():
                        heapq.heappush(heap, (float(bounds[n]), int(at[n]), float(distances[n])))
                continue
            at = a + np.flatnonzero(np.abs(far - self.near[a:b]) <= reach)
            at = at[self.ids[at] != own]
            if not len(at):
                continue
            scores = self.rows[at] @ query
            if len(at) > k:
                # Ties with the k-th stay: the smaller id decides below.
                worst = np.partition(scores, len(at) - k)[len(at) - k]
                at, scores = at[scores >= worst], scores[scores >= worst]
            for score, vec in zip(scores.tolist(), self.ids[at].tolist(), strict=True):
                if floor is not None and score < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
            if len(best) == k:
                reach = min(reach, limit(best[0][0]))
        return [(score, -vec) for score, vec in sorted(best, reverse=True)]


def _spread(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows, each the farthest from those before."""
    real = rows.astype(np.float64)
    least = ((real - real[0]) ** 2).sum(axis=1)
    chosen = [0]
    while len(chosen) < count and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((real - real[chosen[-1]]) ** 2).sum(axis=1))
    return real[chosen]


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            rows = matrix(batch.column("q"))
            cell = np.argmin(squares - 2.0 * (rows @ pivots.T), axis=1) if len(rows) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(cell, np.int32))],
                names=[*batch.schema.names, "cell"],
            )

    return run


_PAGE = (
    "page int, ids binary, rows binary, nodes binary, near binary, queries binary,"
    " pivot array<long>, radius double"
)


def _page(top: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        tree = MTree.build(ids, matrix(rows.column("q"), np.int64), top)
        asked = ids[rows.column("asked").to_numpy(zero_copy_only=False).astype(bool)]
        packed = [pa.array([x], pa.binary()) for x in (*tree.pack(), np.unique(asked).tobytes())]
        pivot = tree.rows[int(tree.nodes[0, 0])].tolist()
        return pa.table(
            [pa.array([key[0].as_py()], pa.int32()), *packed,
             pa.array([pivot], pa.list_(pa.int64())), pa.array([float(tree.nodes[0, 1])])],
            names=["page", "ids", "rows", "nodes", "near", "queries", "pivot", "radius"],
        )

    return run


def _tree(batch, i: int, top: float) -> MTree:
    return MTree.unpack(*(batch.column(c)[i].as_py() for c in ("ids", "rows", "nodes", "near")),
                        top)


_FOUND = "query_id long, page int, q array<long>, floor long, vec_id array<long>, score array<long>"


def _home(k: int, top: float):
    """Search every query in the page it lies in; its k-th score bounds all other pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _tree(batch, i, top)
                out = []
                place = {int(v): n for n, v in enumerate(tree.ids)}
                for own in np.frombuffer(batch.column("queries")[i].as_py(), np.int64).tolist():
                    q = tree.rows[place[own]]
                    best = tree.search(own, q, k)
                    out.append((own, batch.column("page")[i].as_py(), q.tolist(),
                                best[-1][0] if len(best) == k else None,
                                [v for _, v in best], [s for s, _ in best]))
                if out:
                    yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    types = (pa.int64(), pa.int32(), longs, pa.int64(), longs, longs)
    names = ("query_id", "page", "q", "floor", "vec_id", "score")
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
        names=list(names),
    )


_NO_FLOOR = -(1 << 63)
_ASKED = "page int, query_id binary, floor binary, q binary"


def _survivors(top: float):
    """The top level of the search: which queries of a block the roots of pages cannot rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, roots = (batch.column(c)[i].as_py() for c in ("block", "roots"))
                ids, home = (np.array([x[c] for x in block]) for c in ("query_id", "home"))
                q = np.array([x["q"] for x in block], np.int64)
                floor = np.array([_NO_FLOOR if x["floor"] is None else x["floor"] for x in block],
                                 np.int64)
                base = (q.astype(np.float64) ** 2).sum(axis=1) + top
                reach = np.where(floor == _NO_FLOOR, np.inf, np.sqrt(np.maximum(
                    0.0, base - 2.0 * floor)) + _SLACK * (1.0 + np.sqrt(base)))
                pivots = np.array([x["pivot"] for x in roots], np.float64)
                far = np.sqrt(np.maximum(0.0, base[:, None] - 2.0 * (q @ pivots.T)))
                near = far - np.array([x["radius"] for x in roots]) <= reach[:, None]
                pages = np.array([x["page"] for x in roots], np.int32)
                near &= home[:, None] != pages[None, :]
                kept = [(int(pages[j]), *(x[near[:, j]].tobytes() for x in (ids, floor, q)))
                        for j in np.flatnonzero(near.any(axis=0))]
                if kept:
                    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types,
                                                        strict=True)],
                        names=["page", "query_id", "floor", "q"],
                    )

    return run


def _away(k: int, top: float):
    """Search the remaining queries of blocks in pages other than their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _tree(batch, i, top)
                ids, floors, rows = (
                    np.frombuffer(batch.column(c)[i].as_py(), np.int64)
                    for c in ("query_id", "floor", "q")
                )
                query, vec, score = [], [], []
                for own, floor, q in zip(ids.tolist(), floors.tolist(),
                                         rows.reshape(len(ids), -1), strict=True):
                    best = tree.search(own, q, k, None if floor == _NO_FLOOR else floor)
                    query += [own] * len(best)
                    score += [s for s, _ in best]
                    vec += [v for _, v in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (query, vec, score)],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_products(vectors: DataFrame, asked: Column, k: int = 5, page_rows: int = 4096,
                 sample: int = 2000, cells: int = 64, block: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all other rows, exactly.

    ``vectors`` has vec_id and q (array of long); ``asked`` marks the queries among them. Returns
    (query_id, rank from 1, vec_id, score), ties to the smaller vec_id; fewer if there are fewer
    rows. Rows without id take no part; all rows of a query's id are its own; a query id that
    stands in several rows is searched for once; vectors of different lengths are never compared;
    an empty table gives no rows.

    At most ``cells`` routing vectors from a bounded sample of ``sample`` rows deal the rows out,
    and each cell is cut into pages of about ``page_rows`` rows by a hash, so equal vectors cannot
    fill a page. Every page is an M-tree, written as one row of an index table. A query first
    searches the page it lies in; the k-th score found there is its bound for all others. Blocks of
    ``block`` queries first meet the roots of the pages; only queries that a root's radius cannot
    rule out go to its page, where radii and parent distances rule out more. Only rows that reach
    the bound come back.
    """
    spark = vectors.sparkSession
    known = vectors.where("vec_id IS NOT NULL").select(
        "vec_id", "q", F.coalesce(asked, F.lit(False)).alias("asked")
    )
    known = materialize(known, "search-rows")
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for dim in dimensions(known, "q"):
        found = found.unionByName(
            _search(known.where(F.size("q") == dim), k, page_rows, sample, cells, block)
        )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, k, page_rows, sample, cells, block) -> DataFrame:
    square = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    count, top = rows.agg(F.count("*"), F.max(square)).first()
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("q").collect()
    pivots = _spread(np.array([r["q"] for r in picked]), max(1, min(cells, count // page_rows)))
    placed = materialize(
        rows.mapInArrow(_nearest(pivots), "vec_id long, q array<long>, asked boolean, cell int"),
        "search-cells",
    )
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = [-(-sizes.get(c, 0) // page_rows) for c in range(len(pivots))]
    before = np.cumsum([0, *parts]).tolist()
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.element_at(
        F.array(*(F.lit(max(1, p)) for p in parts)), F.col("cell") + 1))
    page = F.element_at(F.array(*map(F.lit, before)), F.col("cell") + 1) + part
    index = materialize(
        placed.groupBy(page.cast("int").alias("page")).applyInArrow(_page(float(top)), _PAGE),
        "search-index",
    )
    spread = index.repartition(max(1, min(before[-1], 10_000)), "page")
    home = materialize(spread.mapInArrow(_home(k, float(top)), _FOUND), "search-home")
    # A query id in several rows: the first page's search counts.
    first = home.withColumn("n", F.row_number().over(
        Window.partitionBy("query_id").orderBy("page"))).where("n = 1").drop("n")
    asked = F.struct("query_id", F.col("page").alias("home"), "q", "floor")
    blocks = first.groupBy(
        F.pmod(F.xxhash64("query_id"), F.lit(max(1, count // (50 * block)))).alias("b")
    ).agg(F.collect_list(asked).alias("block"))
    root = F.struct("page", "pivot", "radius")
    part = F.floor(F.col("page") / _ROOTS).cast("int")
    roots = index.groupBy(part.alias("r")).agg(F.collect_list(root).alias("roots"))
    every = F.sequence(F.lit(0), F.lit((before[-1] - 1) // _ROOTS))
    # The size of exploded rows is unknown to the planner, so no side may be broadcast here.
    pairs = blocks.withColumn("r", F.explode(every)).hint("merge").join(roots, "r")
    remaining = pairs.select("block", "roots").mapInArrow(_survivors(float(top)), _ASKED)
    away = remaining.hint("merge").join(index.drop("queries", "pivot", "radius"), "page")
    away = away.mapInArrow(_away(k, float(top)), "query_id long, vec_id long, score long")
    own = first.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select(
        "query_id", "x.vec_id", "x.score"
    )
    return own.unionByName(away)


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5, **options) -> DataFrame:
    """``top_products`` of ``embeddings`` (vec_id, embedding), quantised to floor(256 * x).

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are NULL or empty or
    hold NULL or non-finite components take no part.
    """
    good = embeddings.where(usable(F.col("embedding")))
    rows = good.select("vec_id", quantised(F.col("embedding")).alias("q"))
    return top_products(rows, F.col("vec_id") % every == 0, k, **options)
