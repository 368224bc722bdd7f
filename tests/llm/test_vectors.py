"""Vector operators against all pairs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoptrail.llm import mtree, near_vectors, queries
from tests.llm.helpers import SF_DIR, components, load

VEC = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 0)
         for i, v in rows], VEC)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain_links(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) with unique ids."""
    unit = {}
    for i, v in rows:
        if good(v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            unit[i] = x / np.sqrt((x * x).sum())
    ids = sorted(unit)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
             if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    root = components([i for i, _ in rows], links)
    return sorted((i, sum(i in p for p in links), root[i], root[i] == i) for i, _ in rows)


def clusters(seed, sizes, dim=16, spread=0.08):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        out += [(centre + spread * rng.standard_normal(dim)).tolist() for _ in range(size)]
    return [(i * 3, v) for i, v in enumerate(out)]


def test_links_of_groups_wider_than_the_window(spark):
    rows = clusters(1, [120, 40, 7] + [2] * 30 + [1] * 200)
    rows += [(10_000 + i, rows[0][1]) for i in range(5)]
    want = plain_links(rows)
    got = near_vectors.near_vectors(frame(spark, rows), window=8, block=32)
    got = sorted(tuple(r) for r in got.collect())
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found >= 0.97 * all_links
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_edge_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1, 0]), (2, [1, 0]), (3, [2, 0.1]), (4, None), (5, []), (6, [0, 0]), (7, [nan, 1]),
            (8, [inf, 1]), (9, [None, 1]), (10, [1, 0, 0]), (11, [0, 1]), (12, [-0.0, 1]),
            (13, [1e-30, 1e30])]
    df = frame(spark, rows).withColumn("copies", F.lit("x"))
    got = sorted(tuple(r) for r in near_vectors.near_vectors(df).collect())
    assert got == plain_links(rows)
    odd = near_vectors.near_vectors(frame(spark, [(None, [1, 0]), (5, [1, 0]), (5, [1, 0]),
                                                  (None, None)]))
    assert sorted(map(tuple, odd.collect()), key=repr) == [
        (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False), (None, 2, 5, False)]
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_queries_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in load(spark, "embeddings").collect()]
    got = sorted(tuple(r) for r in queries.op7_near_vectors(spark, SF_DIR).collect())
    assert got == plain_links(rows)
    top = sorted(tuple(r) for r in queries.op2_mtree(spark, SF_DIR).collect())
    assert top == plain_top(rows)


def plain_top(rows, every=50, k=5):
    q = {}
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if good(v) and i is not None]
    for i, v in kept:
        if i % every == 0:
            q.setdefault(i, v)
    out = []
    for i, v in q.items():
        scored = sorted((-int(w @ v), j) for j, w in kept if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.01])
def test_search_over_many_pages(spark, scale):
    rows = clusters(2, [300, 300] + [3] * 100, dim=8)
    rng = np.random.default_rng(3)
    rows = [(i, (np.array(v) * scale * rng.choice([0.1, 1, 3])).tolist()) for i, v in rows]
    rows += [(100_000 + i, rows[7][1]) for i in range(150)]
    exact = [(i, np.array(v, np.float32).astype(np.float64).tolist()) for i, v in rows]
    got = mtree.search_embeddings(frame(spark, rows), every=30, page_rows=90, cells=6, block=7)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(exact, 30)


def test_tree_alone():
    rng = np.random.default_rng(4)
    rows = rng.integers(-50, 50, (3000, 6))
    rows[:500] = rows[0]
    ids = rng.permutation(3000)
    top = float((rows**2).sum(axis=1).max())
    tree = mtree.MTree.unpack(*mtree.MTree.build(ids, rows, top).pack(), top)
    place = {v: n for n, v in enumerate(ids.tolist())}
    for own in range(0, 3000, 100):
        query = rows[place[own]]
        want = sorted((-int(r @ query), int(i)) for i, r in zip(ids, rows, strict=True) if i != own)
        assert tree.search(own, query, 5) == [(-s, i) for s, i in want[:5]]


def test_edge_searches(spark):
    rows = [(0, [1, 0]), (50, [0.5, 0.5]), (1, [1, 0]), (2, [1, 0]), (3, None), (4, []), (5, [None]),
            (6, [float("nan"), 1]), (100, [1, 2, 3]), (7, [0, 0]), (150, None)]
    df = frame(spark, rows).withColumn("q", F.lit(1)).withColumn("page", F.lit(1))
    got = sorted(tuple(r) for r in mtree.search_embeddings(df).collect())
    assert got == plain_top([r for r in rows if r[0] != 100])
    twice = mtree.search_embeddings(df.unionByName(df)).where("query_id = 0").count()
    assert twice == 5
    assert mtree.search_embeddings(df.where("false")).count() == 0


def test_blocks_of_one_component_go_to_several_tasks(spark):
    unit = [1.0, 0.0]
    members = spark.range(4000).selectExpr(
        "id AS vector", "1L AS copies", "id AS least", f"array({unit[0]}D, {unit[1]}D) AS unit",
        "7L AS component")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = near_vectors._component_links(members, 0.9, 256)
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(\S+, i#\d+, j#\d+", plan)
        assert links.where("links = 3999").count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
