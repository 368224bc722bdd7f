"""The rule ledger against a plain version, and its policies."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoptrail.llm import quality, queries
from shoptrail.llm.text import WordHashes
from tests.llm.helpers import SF_DIR, documents, load, words


def plain(text):
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = Counter(windows)
    covered = set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(i, i + 5))
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


def test_query_equals_plain_version(spark):
    texts = {r.doc_id: r.text for r in load(spark).collect()}
    got = queries.op11_quality(spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, _, dups, repeats = expected = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            n, chars, symbols, dups, repeats), expected
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_kept_follows_the_labels(spark):
    labels = {r.doc_id: r.quality for r in load(spark, "labels").collect()}
    got = {r.doc_id: r.kept for r in queries.op11_quality(spark, SF_DIR).collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(got[d] for d in good) > 0.95 * len(good)
    assert sum(not got[d] for d in bad) > 0.95 * len(bad)


EDGES = [
    None, "", " \n\t ", "a b c d e a b c d e", "a b c d e", "a a a a a a", "x # $$ <b> |&%*",
    "line one\nline one\n \nline one \nother", "ééé ü ü 漢字", "w" * 100, "a\x0bb\x0cc\rd",
    "one two three four five six seven eight nine ten",
]


def test_edge_texts(spark):
    texts = [*EDGES, "long " * 200_000, (None, "a b"), (7, "same row"), (7, "same row")]
    clash = dict.fromkeys(["_body", "failed", "n_words", "kept"], F.lit("x"))
    got = quality.ledger(documents(spark, texts, **clash)).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for i, text in enumerate(EDGES):
        if i != 7:
            assert tuple(by[i][m] for m in quality.MEASURES) == plain(text), text
    assert by[len(EDGES)].n_repeat_words == 200_000
    assert by[0].failed == 1 and by[9].failed == 1 | 1 << 4
    assert quality.ledger(documents(spark, texts).where("false")).count() == 0


def test_equal_hashes_do_not_make_equal_windows():
    class Same(WordHashes):
        def __missing__(self, word):
            return b"\x01" * 8

    text = b"a b c d e f g h i j".split()
    assert quality.repeated_words(text, Same()) == 0
    assert quality.repeated_words(text + text[:5], Same()) == 10
    assert quality.repeated_words(text[:5] * 3, Same()) == 15


def test_policies_and_ablation(spark):
    docs = load(spark)
    entries = quality.ledger(docs).cache()
    rows = entries.collect()
    for policy in quality.POLICIES:
        kept = [r for r in rows if not r.failed & policy.mask()]
        assert entries.where(quality.passes(policy)).count() == len(kept)
    for r in quality.ablation(entries).collect():
        policy = next(p for p in quality.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        hits = [(x.failed & policy.mask(), x) for x in rows]
        only = [x for hit, x in hits if hit == bit]
        assert (r.n_docs, r.n_kept, r.n_failed, r.n_only, r.words_only) == (
            len(rows), sum(not hit for hit, _ in hits), sum(bool(x.failed & bit) for x in rows),
            len(only), sum(x.n_words for x in only))
    empty = quality.ablation(entries.where("false")).collect()
    assert len(empty) == sum(len(p.rules) for p in quality.POLICIES)
    assert all(r.n_docs == 0 == r.n_only for r in empty)


@pytest.mark.parametrize("keep", [("n_words",), ("doc_id", "failed")])
def test_clashing_columns_to_keep_are_refused(spark, keep):
    docs = documents(spark, ["a"], n_words=F.lit(1), failed=F.lit(1))
    with pytest.raises(ValueError):
        quality.ledger(docs, keep)
