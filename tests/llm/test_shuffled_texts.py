"""Texts that a join cannot concern are not shuffled."""

import random

import pytest

from shoptrail.llm import near_copies, simhash, substrings
from shoptrail.session import materialize
from tests.llm.helpers import documents

N = 400


@pytest.fixture
def no_broadcasts(spark):
    """As on tables too large for a broadcast; one by hint stays."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(df, column):
    """Rows that the shuffles of a query with ``column`` in them write, and its result."""
    rows = df.collect()
    found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and f"{column}#" in node.output().mkString(","):
                found += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            nodes.extend(children.apply(i) for i in range(children.size()))
    return found, rows


def texts():
    """Unlike texts of 60 words; two near copies, two with a passage in common, a copy."""
    rng = random.Random(3)
    out = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(N)]
    out[1] = [*out[0][:-1], "changed"]
    out[3][:40] = out[2][:40]
    out[5] = out[4]
    return [" ".join(x) for x in out]


def test_one_of_each_shuffles_rows_that_go(spark, no_broadcasts):
    docs = documents(spark, texts())
    docs = docs.unionByName(docs.where("doc_id = 7"))  # twice under one id
    kept, rows = shuffled(near_copies.representatives(docs), "text")
    assert sorted(r.doc_id for r in rows) == [i for i in range(N) if i not in (1, 5)]
    assert kept < N / 2


def test_near_copies_shuffle_texts_of_candidates(spark, no_broadcasts, monkeypatch):
    seen = []

    def watched(df, name, folder=None):
        if name in ("copies-texts", "copies-rest-texts"):
            seen.append(shuffled(df, "body")[0])
        return materialize(df, name, folder)

    monkeypatch.setattr(near_copies, "materialize", watched)
    found = near_copies.near_copies(documents(spark, texts()))
    parts = {r.doc_id: r.component for r in found.collect()}
    assert parts[0] == parts[1] and parts[4] == parts[5]
    assert len(set(parts.values())) == N - 2
    assert len(seen) == 3 and max(seen) < N / 2


def test_texts_without_repeated_windows_are_not_shuffled(spark, no_broadcasts):
    found = substrings.remove_repeated(documents(spark, texts()), keep=("doc_id",))
    moved, rows = shuffled(found, "body")
    assert moved < N / 2
    removed = {r.doc_id: r.n_removed for r in rows}
    assert len(rows) == N and removed.pop(2) == removed.pop(3) == 40
    assert [removed.pop(i) for i in (0, 1, 4, 5)] == [59, 59, 60, 60]
    assert not any(removed.values())


def test_one_of_each_of_null_and_repeated_rows(spark):
    docs = documents(spark, [(None, "a b"), (None, "a b"), (None, None), (2, None), (2, None),
                             (1, "A  b"), (3, "c d"), (3, "e f"), (3, "c d")])
    rows = simhash.one_of_each(docs, lambda keyed, keys: near_copies.near_copies(keyed, keep=keys))
    got = sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)
    assert got == [
        (1, "A  b"), (2, None), (3, "c d"), (3, "e f")]
