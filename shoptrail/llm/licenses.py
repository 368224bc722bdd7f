"""Licence scan: notice phrases and identifier tags by Aho-Corasick, expressions by shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.text import lean, slices

# Phrases of the base scan and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# More notices of this method.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}

TAG = "spdx license identifier"

# How freely a text under a licence may be used, by the beginning of its name; longest wins.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 1.0, "cc0": 1.0, "unlicense": 1.0,
    "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6,
    "gpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "agpl": 0.2, "reserved": 0.0,
    "proprietary": 0.0,
}
UNKNOWN = 0.5
EXCEPTION = 0.1

# Bytes between words become spaces and A-Z becomes a-z; letters beyond ASCII are words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b
    if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_SPAN = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"[ \t]*([A-Za-z0-9.:+-]+|[()])")
_RANK = {"or": 1, "and": 2, "with": 3}


def freedom(name: str) -> float:
    """The value of a licence name; an unknown one has UNKNOWN."""
    known = [p for p in FREEDOM if name.startswith(p)]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def tokens(line: str) -> list[str]:
    """The longest beginning of ``line`` that alternates as an expression does."""
    out, at, depth, want = [], 0, 0, True
    complete = 0
    while found := _TOKEN.match(line, at):
        token = found[1]
        low = token.lower()
        if want and token == "(":
            depth += 1
        elif want and token != ")" and low not in _RANK:
            want = False
        elif not want and token == ")" and depth:
            depth -= 1
        elif not want and low in _RANK:
            want = True
        else:
            break
        out.append(low)
        at = found.end()
        if not want and not depth:
            complete = len(out)
    return out[:complete]


def postfix(infix: list[str]) -> list[str]:
    """Shunting yard: ``with`` binds before ``and``, and that before ``or``; all to the left."""
    out, held = [], []
    for token in infix:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[float, set[str]]:
    """Freedom and licence names: the freer side of ``or``, the stricter of ``and``; an exception
    after ``with`` frees a little and names no licence."""
    stack: list[tuple[float, set[str]]] = []
    for token in rpn:
        if token not in _RANK:
            stack.append((freedom(token), {token}))
            continue
        (b, names_b), (a, names_a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(1.0, a + EXCEPTION), names_a))
        else:
            stack.append(((max if token == "or" else min)(a, b), names_a | names_b))
    return stack[0]


def automaton(phrases: Mapping[str, tuple]) -> ahocorasick.Automaton:
    """Finds whole words only: every phrase stands between spaces."""
    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, *value))
    found.make_automaton()
    return found


def _expressions(raw: bytes, after: list[int]) -> list[list[str]]:
    """The expressions that follow the words at the places ``after``."""
    lower = raw.translate(_WORDS)
    ends = {}
    last = max(after)
    wanted = set(after)
    for i, span in enumerate(_SPAN.finditer(lower)):
        if i in wanted:
            ends[i] = span.end()
        if i == last:
            break
    out = []
    for place in after:
        rest = raw[ends[place] :]
        colon = rest.lstrip(b" \t")
        if colon.startswith(b":"):
            line = re.split(rb"[\r\n]", colon[1:], maxsplit=1)[0]
            out.append(tokens(line.decode("utf-8", "replace")))
    return [x for x in out if x]


def scan_text(raw: bytes, machine: ahocorasick.Automaton) -> tuple:
    """(words, places as (word, label, base), expressions, labels, score) of one text."""
    split = raw.translate(_WORDS).split()
    text = f" {b' '.join(split).decode('latin-1')} "
    places, tags = [], []
    seen = at = 0
    hits = sorted((end - width + 1, width, label, base)
                  for end, (width, label, base) in machine.iter(text))
    for start, width, label, base in hits:
        seen += text.count(" ", at, start)
        at = start
        if label is None:
            tags.append(seen + text.count(" ", start + 1, start + width - 1))
        else:
            places.append((seen, label, base))
    labels = {label for _, label, _ in places}
    scores = [freedom(label) for label in labels]
    expressions = _expressions(raw, tags) if tags else []
    for infix in expressions:
        score, names = evaluate(postfix(infix))
        scores.append(score)
        labels |= names
    return len(split), places, [" ".join(x) for x in expressions], sorted(labels), min(
        scores, default=0.0
    )


_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = {p: (label, False) for p, label in NOTICE_PHRASES.items()}
    phrases |= {p: (label, True) for p, label in BASE_PHRASES.items()}
    machine = automaton(phrases | {TAG: (None, False)})
    for batch in slices(batches, "body"):
        rows = [scan_text(x or b"", machine) for x in batch.column("body").to_pylist()]
        count, places, expressions, labels, score = zip(*rows, strict=True)
        places = [[dict(zip(("word", "label", "base"), p, strict=True)) for p in x]
                  for x in places]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(count, pa.int64()),
                pa.array(places, pa.list_(_PLACE)),
                pa.array(expressions, pa.list_(pa.string())),
                pa.array(labels, pa.list_(pa.string())),
                pa.array(score, pa.float64()),
            ],
            names=["doc_id", "n_words", "places", "expressions", "labels", "score"],
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence notices and identifier tags of every whole text.

    Returns one row per row of ``docs``: doc_id, n_words, places (array of word, label, base: where
    a notice begins), expressions (of the tags), labels (sorted) and score: how freely the text may
    be used, 0 to 1, the strictest of all notices and expressions, 0 without any. Words are runs of
    letters and digits, A-Z lower-cased, letters beyond ASCII included. A tag whose rest of line is
    no expression gives none. NULL and empty texts have no words; repeated rows give equal rows; an
    empty table gives none; other columns are ignored.
    """
    body = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    return body.mapInArrow(
        lean(_scan),
        "doc_id long, n_words long, places array<struct<word: long, label: string, base: boolean>>,"
        " expressions array<string>, labels array<string>, score double",
    )
