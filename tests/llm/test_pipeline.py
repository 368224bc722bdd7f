"""Every stage of the pipeline on its own input, against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shoptrail.llm import mixing, queries, toxicity
from tests.llm.helpers import SF_DIR, documents, load, words
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_packing import check_places, plain_pieces
from tests.llm.test_substrings import plain as plain_removal

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The written output of every stage, by name, with the documents as ``start``."""
    folder = tmp_path_factory.mktemp("stages")
    out = {"start": load(spark)}
    docs = out["start"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows(df):
    return {(r.doc_id, r.text) for r in df.collect()}


def test_order_and_columns(steps):
    assert list(steps) == ["start", "toxicity", "simhash", "substrings", "mixing", "packing"]
    for name in list(steps)[:-1]:
        assert steps[name].dtypes == steps["start"].dtypes


def test_toxic_documents_go(spark, steps):
    scores = toxicity.toxicity(steps["start"], load(spark, "labels")).collect()
    kept = {r.doc_id for r in scores if not r.predicted}
    assert {r.doc_id for r in steps["toxicity"].collect()} == kept
    labels = {r.doc_id: r.toxic for r in load(spark, "labels").collect()}
    gone = {r.doc_id for r in scores} - kept
    assert sum(labels.get(d) == 1 for d in gone) > 0.5 * sum(labels.values())
    assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(labels)


def test_one_document_of_each_group_stays(steps):
    """Of each group linked by a similarity of 0.8 over 5-word shingles the smallest id."""
    before = rows(steps["toxicity"])
    keep = plain_kept(sorted(before))
    assert rows(steps["simhash"]) == {(d, t) for d, t in before if d in keep}


def test_repeated_windows_are_cut(steps):
    before = {r.doc_id: r for r in steps["simhash"].collect()}
    removed = {d: (n, gone) for d, n, gone, _ in plain_removal(
        [(d, r.text) for d, r in before.items()])}
    after = {r.doc_id: r for r in steps["substrings"].collect()}
    assert set(after) == {d for d, (n, gone) in removed.items() if not 0 < gone == n}
    for d, r in after.items():
        n, gone = removed[d]
        if gone:
            assert len(words(r.text)) == n - gone and r.n_chars == len(r.text)
        else:
            assert r == before[d]


def test_documents_are_taken_as_planned(steps):
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(steps["substrings"]).collect()}
    assert Counter(r.doc_id for r in steps["mixing"].collect()) == {
        d: n for d, n in plan.items() if n}


def test_all_tokens_are_packed(steps):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = [(r.doc_id, r.text) for r in steps["mixing"].collect()]
    got = steps["packing"].collect()
    parts = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    assert sorted(parts, key=repr) == plain_pieces(tokenizer, docs)
    check_places(got)


def test_run_applies_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF_DIR)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(*columns).collect()) == sorted(
        steps["packing"].select(*columns).collect())


def test_edge_rows_pass_every_stage(spark):
    texts = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "x " * 50_000),
             (5, "some text of its own", None)]
    extra = {"size": F.lit(1), "body": F.lit("b"), "score": F.lit(0.5), "_copy": F.lit(1),
             "features": F.lit("f")}
    docs = documents(spark, texts, **extra)
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF_DIR)
            found = out.count()
            assert (found > 0) == (table.count() > 0), name
            if name != "packing":
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
