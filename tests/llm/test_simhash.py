"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shoptrail.llm import queries, simhash
from shoptrail.llm.components import connected_components
from tests.llm.helpers import SF_DIR, ascii_lower, components, documents, load, words


def plain_print(text):
    found = words(ascii_lower(text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(rows, budget=2):
    prints = sorted({p for _, p in rows})
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= budget]
    root = components(prints, links)
    least = {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    return sorted(((d, f"{p:016x}", least.get(root[p])) for d, p in rows), key=repr)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, plain_print(r.text)) for r in load(spark).collect()]
    got = queries.op1_simhash(spark, SF_DIR).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(rows)


def test_edge_texts(spark):
    long = "word " * 120_000
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (9, "one TWO"), (9, "one TWO"),
             (None, "a b c d"), (5, "É b c"), (6, long), (7, "a b c d"), (4, "other words here")]
    docs = documents(spark, texts, print=F.lit(1), component=F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    rows = [(i, plain_print(t)) for i, t in texts]
    want = plain_groups(rows)
    assert sorted(((r.doc_id, f"{r.print % 2**64:016x}", r.component_id) for r in got),
                  key=repr) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    # Both texts of id 4 stay: their groups differ, though 4 is the smallest id of each.
    assert kept.count() == len({c for _, _, c in want}) + 1
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.representatives(docs.where("false")).count() == 0


def dense(n, bits, seed=3):
    """Fingerprints that differ from one centre in a few of some bits: all in one trie corner."""
    rng = np.random.default_rng(seed)
    centre = int(rng.integers(0, 2**63))
    out = {centre}
    while len(out) < n:
        value = centre
        for b in rng.choice(bits, rng.integers(1, 5), replace=False):
            value ^= 1 << int(b)
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("bits", [range(64), range(10), range(54, 64)])
def test_trie_finds_all_pairs(bits):
    values = np.array(dense(250, list(bits)) + dense(400, list(range(64)), 4), np.uint64)
    values = np.unique(values)
    for budget in (0, 1, 2, 3):
        got = [tuple(sorted(p)) for a, b in simhash.trie_pairs(values, None, 0, budget)
               for p in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :]
                if (int(a) ^ int(b)).bit_count() <= budget}
        assert len(got) == len(set(got)) and set(got) == want


def test_large_node_pairs_go_deeper(spark):
    values = dense(1500, list(range(40, 64))) + dense(500, list(range(64)), 5)
    signed = [int(np.uint64(v).astype(np.int64)) for v in set(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    found = simhash.links(prints, 2, node_rows=100, block_rows=50, stride=4)
    got = {r.node: r.component for r in connected_components(found).collect()}
    unsigned = {v: v % 2**64 for v in signed}
    links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :]
             if (unsigned[a] ^ unsigned[b]).bit_count() <= 2]
    want = components(signed, links)
    ends = {x for pair in links for x in pair}
    assert got == {n: c for n, c in want.items() if n in ends and c != n}


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(3000)]
    star = [(10_000, 10_001 + i) for i in range(3000)]
    loose = [(None, 1), (5, 5), (20_000, 20_001), (20_001, 20_000)]
    links = spark.createDataFrame(chain + star + loose, "a long, b long").repartition(40)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = {i: 0 for i in range(1, 3001)} | {10_001 + i: 10_000 for i in range(3000)}
    assert got == want | {20_001: 20_000}
    assert connected_components(links.where("false")).count() == 0
