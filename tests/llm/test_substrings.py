"""Removal of repeated windows against a plain version."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoptrail.llm import queries, substrings
from tests.llm.helpers import SF_DIR, documents, load, words


def plain(rows, width=35):
    counts = Counter()
    split = [(d, words(t)) for d, t in rows]
    for _, w in split:
        counts.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, width=35):
    found = substrings.remove_repeated(df, width)
    return sorted((tuple(r) for r in found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)


def test_query_equals_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in load(spark).collect()]
    got = sorted((tuple(r) for r in queries.op10_substrings(spark, SF_DIR).collect()), key=repr)
    assert got == plain(rows)


def test_edge_texts(spark):
    line = " ".join(f"w{i}" for i in range(12))
    texts = [(1, None), (2, ""), (3, "a b"), (4, line), (5, f"x {line}\ty"), (6, f"{line} {line}"),
             (7, "z " * 50), (None, line + " q"), (None, "other " + line), (9, "A b c d e"),
             (9, "A b c d e"), (9, "a b c d e"), (10, "e f g h i j"), (11, "word%d " * 30_000)]
    docs = documents(spark, texts, starts=F.lit(1), print=F.lit("x"), ranges=F.lit(2))
    assert run(docs, 5) == plain(texts, 5)
    assert run(docs.where("false"), 5) == []


def test_texts_over_many_chunks_and_buckets(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 3, rng.integers(0, 400)))) for _ in range(60)]
    docs = documents(spark, texts).repartition(5)
    ranges = substrings.repeated_ranges(docs, 8, chunk_rows=300, bucket_bytes=500)
    got = {}
    for r in ranges.collect():
        for s, e in zip(np.frombuffer(r.starts, np.int64), np.frombuffer(r.ends, np.int64),
                        strict=True):
            got.setdefault(r.doc_id, set()).update(range(s, e))
    removed = {d: n for d, _, n, _ in plain(list(enumerate(texts)), 8) if n}
    assert {d: len(x) for d, x in got.items()} == removed


def test_window_hashes_are_of_words_alone():
    windows = substrings.WindowHashes(3)
    a, b = windows(b"x a b c d"), windows(b"a\tb  c\nd e")
    assert a[1:].tolist() == b[:2].tolist()
    assert len(set(a.tolist() + b.tolist())) == 4
