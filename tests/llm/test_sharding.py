"""Rendezvous shards: balance, small moves, slots."""

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from shoptrail.llm import queries, sharding
from tests.llm.helpers import SF_DIR, documents, load


def test_query(spark):
    docs = {r.doc_id: r.text for r in load(spark).collect()}
    got = queries.op4_sharding(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.law == "key" and 0 <= r.shard < 40
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 40 for r in got)
    assert 5 < moved < 60


def plain_shard(key, weights):
    """The shard with the lowest -ln(u) / weight, from hashes of key and shard."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=seed) >> 11
            draws.append((-math.log((bits + 0.5) / 2**53) / weight, shard))
    return min(draws)[1]


def test_query_equals_plain_rendezvous(spark):
    for r in queries.op4_sharding(spark, SF_DIR).collect():
        assert r.shard == plain_shard(r.doc_id, [1.0] * 40)
        assert r.grown_shard == plain_shard(r.doc_id, [1.0] * 41)


@pytest.mark.parametrize("weights", [[1.0], [0.0, 3.0], [1.0, 2.5, 0.0, 0.25, 7.0]])
def test_weighted_shards_equal_plain_rendezvous(spark, weights):
    keys = [None, 0, -1, 1, 2**63 - 1, -(2**63), *range(1000, 1300)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = rows.withColumn("s", sharding.rendezvous(F.col("k"), weights)).collect()
    assert [r.s for r in got] == [plain_shard(k, weights) for k in keys]


def test_clashing_names_stay(spark):
    clash = dict.fromkeys(["_part", "_OWN", "_before", "_rows"], F.lit("x"))
    docs = documents(spark, [(i, "t") for i in range(50)], **clash)
    got = sharding.shard(docs, [1.0] * 3, part_rows=5)
    assert sorted(got.columns) == sorted([*docs.columns, "shard", "slot"]) and got.count() == 50
    assert got.where("_part = 'x' AND _own = 'x' AND _before = 'x' AND _rows = 'x'").count() == 50


def test_weights_and_moves(spark):
    rows = spark.range(40_000).withColumnRenamed("id", "k")
    heavy = rows.withColumn("s", sharding.rendezvous(F.col("k"), [1.0, 2.0, 0.0, 5.0]))
    counts = Counter(r.s for r in heavy.collect())
    assert counts.keys() == {0, 1, 3}
    assert all(abs(counts[s] / 40_000 - w / 8) < 0.01 for s, w in ((0, 1), (1, 2), (3, 5)))
    fewer = rows.select(
        sharding.rendezvous(F.col("k"), [1.0, 1.0, 1.0]).alias("a"),
        sharding.rendezvous(F.col("k"), [1.0, 0.0, 1.0]).alias("b"),
    )
    assert fewer.where("a <> 1 AND a <> b").count() == 0


def test_edge_rows(spark):
    texts = [(None, "a"), (None, "b"), (1, None), (1, None), (2, "")]
    docs = documents(spark, texts, shard=F.lit("x"), slot=F.lit(9))
    got = sharding.shard(docs, [1.0] * 3, tie=("text",), part_rows=1).collect()
    assert len(got) == 5
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard(docs.where("false"), [1.0]).count() == 0


def test_main_path_is_native(spark):
    plan = queries.op4_sharding(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
