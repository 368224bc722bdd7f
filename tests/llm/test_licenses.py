"""Licence scan against a plain version, and the expression parser."""

import re

import pytest
from pyspark.sql import functions as F

from shoptrail.llm import licenses, queries
from tests.llm.helpers import SF_DIR, ascii_lower, documents, load

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    words = WORD.findall(ascii_lower(text or ""))
    places = []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in places})))


def test_query_equals_plain_version(spark):
    texts = {r.doc_id: r.text for r in load(spark).collect()}
    got = queries.op5_licenses(spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(
            texts[r.doc_id])
        base, every = (set(x.split(",")) - {""} for x in (r.base_labels, r.labels))
        assert base <= every and r.labels == ",".join(sorted(every)) and 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in got) > 5


@pytest.mark.parametrize(
    "line, names, score",
    [
        ("MIT", {"mit"}, 1.0),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only"}, 0.5),
        ("MIT AND GPL-3.0 OR Apache-2.0", {"mit", "gpl-3.0", "apache-2.0"}, 1.0),
        ("MIT AND (GPL-3.0 OR AGPL-3.0)", {"mit", "gpl-3.0", "agpl-3.0"}, 0.4),
        ("(MIT) trailing words", {"mit"}, 1.0),
        ("MIT OR", {"mit"}, 1.0),
        ("LGPL-2.1 OR Strange-1.0 */", {"lgpl-2.1", "strange-1.0"}, 0.6),
    ],
)
def test_expressions(line, names, score):
    value, found = licenses.evaluate(licenses.postfix(licenses.tokens(line)))
    assert found == names and abs(value - score) < 1e-9


@pytest.mark.parametrize("line", ["", "AND MIT", "( MIT", ")", "OR", "((", "*"])
def test_broken_expressions_give_nothing(line):
    assert licenses.tokens(line) == []


def test_edge_texts(spark):
    texts = [(1, None), (2, ""), (3, "CC-BY CC BY cc by"), (None, "All Rights  Reserved."),
             (4, "x\n# SPDX-License-Identifier: MIT OR GPL-2.0-only\nMIT License"),
             (5, "spdx-license-identifier"), (6, "É all rights reservedé"), (7, "w " * 300_000),
             (8, "GNU Lesser General Public License"), (8, "GNU Lesser General Public License"),
             (9, "SPDX-License-Identifier: (((")]
    docs = documents(spark, texts, body=F.lit(1), labels=F.lit("x"))
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert [p.word for p in by[3].places] == [0, 2, 4]
    assert by[4].labels == ["gpl-2.0-only", "mit"] and by[4].expressions == ["mit or gpl-2.0-only"]
    assert by[8].labels == ["gpl", "lgpl"] and by[5].labels == [] == by[9].labels
    assert by[1].n_words == 0 == by[2].n_words and by[1].score == 0.0
    for doc_id, text in texts:
        n, count, *_ = plain(text)
        assert by[doc_id].n_words == n and sum(p.base for p in by[doc_id].places) == count
    assert licenses.scan_licenses(docs.where("false")).count() == 0
