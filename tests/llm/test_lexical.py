"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoptrail.llm import lexical, queries
from tests.llm.helpers import SF_DIR, ascii_lower, documents, load

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(ascii_lower(text or ""))


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score) by brute force."""
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    own = {}
    for i, text in items:
        own.setdefault(i, set()).update(split(text))
    out = []
    for item, terms in own.items():
        scores = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=str_free)[:top])]
    return out


def str_free(x):
    return x[0], x[1], x[2] or 0


def as_rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_equals_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in load(spark).collect()]
    items = [(r.item_id, r.text) for r in load(spark, "benchmark").collect()]
    got = as_rows(queries.op13_lexical(spark, SF_DIR))
    assert got == sorted(plain(docs, items), key=repr)
    assert len(got) == 10 * len(items)


EDGE_DOCS = [
    (1, None), (2, ""), (3, "., ;\n"), (4, "alpha beta alpha"), (5, "Alpha-beta"),
    (5, "Alpha-beta"), (None, "alpha"), (6, "ALPHA é 漢字"), (7, "alphabet betas"),
    (8, "beta " * 100_000), (9, "x\x00alpha\x7fbeta"), (10, "gamma"), (11, "gamma"), (12, "gamma"),
]
EDGE_ITEMS = [
    (1, "alpha"), (2, "Beta beta, alpha!"), (3, None), (4, ""), (5, "nowhere"), (6, "漢字 É é"),
    (None, "gamma"), (7, "gamma"), (7, "alpha"), (8, "alpha"), (8, "alpha"),
]


@pytest.mark.parametrize("block", [200_000, 3])
@pytest.mark.parametrize("top", [1, 2, 10])
def test_edge_rows(spark, block, top):
    docs = documents(spark, EDGE_DOCS, item_id=F.lit(0), n=F.lit("n"), terms=F.lit(1))
    items = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string").withColumns(
        {"doc_id": F.lit(7), "block": F.lit(1)})
    assert as_rows(lexical.search(docs, items, top, block)) == sorted(
        plain(EDGE_DOCS, EDGE_ITEMS, top), key=repr)


def test_empty_tables(spark):
    docs = documents(spark, EDGE_DOCS)
    items = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs.where("doc_id <= 3"), items).count() == 0


def test_best_rows_are_kept_over_many_batches(spark):
    docs = [(i, "word " * (1 + i % 7) + "filler " * (i % 11)) for i in range(3000)]
    items = [(1, "word"), (2, "filler word")]
    got = lexical.search(documents(spark, docs).repartition(3),
                         spark.createDataFrame(items, "item_id long, text string"))
    assert as_rows(got) == sorted(plain(docs, items), key=repr)
