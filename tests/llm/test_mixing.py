"""Targets by water filling, and what the mix takes."""

import random

from pyspark.sql import functions as F

from shoptrail.llm import mixing, queries
from tests.llm.helpers import SF_DIR, documents, load, words


def plain_targets(sizes, weights, most=3.0):
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        share = {s: left * weights[s] / weight if s not in full else most * sizes[s] for s in sizes}
        over = {s for s in sizes if s not in full and share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share
        full |= over


def by_source(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] * (None in sizes)
    return sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}


def test_query_meets_targets(spark):
    docs = load(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes, weights = by_source(rows)
    want = plain_targets(sizes, weights)
    source = {d: s for d, _, s in rows}
    got = queries.op3_mixing(spark, SF_DIR).collect()
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        rate = want[s] / sizes[s]
        if r["size"]:
            assert r.taken // r["size"] in (int(rate), int(rate) + 1)
        taken[s] += r.taken
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1) < 0.05
    again = queries.op3_mixing(spark, SF_DIR)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))


def test_levels_equal_repeated_sharing(spark):
    rng = random.Random(5)
    for case in range(6):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 50, 5000, 10**6]) for i in range(1 + 4 * case)}
        weights = {s: rng.choice([0.5, 1.0, 2.0, 30.0]) for s in sizes}
        a = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        b = spark.createDataFrame(list(weights.items()), "source string, weight double")
        got = {r.source: r.target for r in mixing.targets(a, b).collect()}
        want = plain_targets(sizes, weights) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_edge_rows(spark):
    texts = [(1, "a b c", "x"), (2, None, "x"), (None, "d e", None), (3, "", "empty"),
             (4, "f " * 1000, None), (4, "f " * 1000, None), (5, "g", "y")]
    docs = documents(spark, texts, size=F.lit(7), target=F.lit("t"), _source=F.lit(1))
    plan = mixing.mix_plan(docs.drop("_source"))
    sizes, weights = by_source(texts)
    assert weights == {"empty": 1, "x": 2, "y": 3, None: 1}
    want = plain_targets(sizes, weights)
    got = plan.collect()
    assert len(got) == len(texts)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)
    mixed = mixing.mix(docs.drop("_source"))
    assert mixed.columns == docs.drop("_source").columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(docs.drop("_source").where("false")).count() == 0


def test_clashing_names_stay(spark):
    docs = documents(spark, [(i, "a b c", "s") for i in range(9)], _source=F.lit("x"),
                     _COPY=F.lit("y"))
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert got.where("_source = 'x' AND _copy = 'y'").count() == got.count() > 0
