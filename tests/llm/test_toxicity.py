"""Toxicity on held-out labels, and edge rows."""

import re
import zlib

from pyspark.sql import functions as F

from shoptrail.llm import queries, toxicity
from tests.llm.helpers import SF_DIR, documents, load


def auc(scored):
    ranked = sorted(scored)
    pos = [i for i, (_, y) in enumerate(ranked) if y]
    n1, n0 = len(pos), len(ranked) - len(pos)
    return (sum(pos) - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_held_out_labels_are_told_apart(spark):
    sf = SF_DIR.replace("0.01", "0.1")
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    docs = load(spark).count() * 10
    assert len(got) == docs
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    tested = [(got[x.doc_id].score, x.toxic) for x in labels if got[x.doc_id].held_out]
    assert auc(tested) > 0.9
    hits = sum((s >= 0.5) == bool(y) for s, y in tested)
    assert hits / len(tested) > 0.95


def test_edge_rows(spark):
    labels = load(spark, "labels")
    texts = [(1, None), (2, ""), (None, "you idiot"), (3, "x " * 200_000), (4, "same"), (4, "same")]
    docs = load(spark).unionByName(documents(spark, texts)).withColumn("body", F.lit(1))
    docs = docs.withColumn("score", F.lit("x"))
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    none = toxicity.toxicity(docs, labels.where("false"))
    assert none.select("score").distinct().collect() == [(0.0,)]


def test_word_kinds():
    kinds = toxicity._Kinds(toxicity.Lexicon(frozenset({"blork"}), frozenset({"zorp"})))
    names = dict(zip(toxicity.FEATURES, toxicity.text_features(
        b"You are an IDIOT, id1ot blork zorping $$$ fine!", kinds), strict=True))
    assert names["insult_density"] == 1 / 9 and names["decoded_density"] == 1 / 9
    assert names["learned_density"] == 1 / 9 and names["stem_density"] == 1 / 9
    assert names["shouted_share"] == 1 / 9 and names["symbol_run_share"] == 1 / 9
    assert names["hits_near_second_person"] == 1 / 9 and names["hits_in_a_window"] == 4


def test_features_equal_a_plain_version(spark):
    """Shares that a regular expression can count, over whole documents."""
    docs = load(spark).orderBy("doc_id").limit(150)
    kinds = toxicity._Kinds(toxicity.Lexicon())
    for r in docs.collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bare = [toxicity._EDGES.sub("", w) for w in words]
        n, size = max(1, len(words)), max(1, len(text.encode()))
        got = dict(zip(toxicity.FEATURES, toxicity.text_features(text.encode(), kinds),
                       strict=True))
        you = [i for i, w in enumerate(bare) if w.lower() in toxicity.SECOND_PERSON]
        hits = [i for i, w in enumerate(bare) if w.lower() in toxicity.INSULTS]
        assert got["insult_density"] == len(hits) / n
        assert got["second_person_density"] == len(you) / n
        assert got["shouted_share"] == sum(len(w) > 1 and w.isupper() for w in bare) / n
        assert got["exclamation_rate"] == text.count("!") / n
        assert got["capital_share"] == len(re.findall("[A-Z]", text)) / size


def test_calibrated_scores_rise_with_raw_ones(spark):
    docs, labels = load(spark), load(spark, "labels")
    model = toxicity.train(docs, labels)
    featured = toxicity.with_features(docs, model.lexicon, ["doc_id"])
    scored = model.annotate(docs).select("doc_id", "score")
    rows = toxicity._raw(model.trees, featured).select("doc_id", "raw").join(scored, "doc_id")
    pairs = sorted((r.raw, r.score) for r in rows.collect())
    assert len({s for _, s in pairs}) > 1
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:], strict=False))
