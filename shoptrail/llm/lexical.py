"""Ranked lexical search by a scan of all texts with one automaton of the items' terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrail.llm.text import ascii_lower, lean, slices
from shoptrail.session import materialize

# Terms are runs of letters, digits and everything beyond ASCII.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b
    if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

# Scores of one matrix of documents by items that a task holds.
_CELLS = 4_000_000


def terms(text: Column) -> Column:
    """The distinct terms of a text; NULL has none."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(_TERM), F.lit(0))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def automaton(words: list[bytes]) -> ahocorasick.Automaton:
    """Finds whole terms only: every one stands between spaces. Values are places in ``words``."""
    machine = ahocorasick.Automaton()
    for place, word in enumerate(words):
        machine.add_word(f" {word.decode('latin-1')} ", place)
    if words:
        machine.make_automaton()
    return machine


def count_terms(text: bytes, machine: ahocorasick.Automaton) -> tuple[int, Counter]:
    """(number of terms of the text, occurrences of each term of the automaton)."""
    split = text.translate(_TERM_BYTES).split()
    if not split or not len(machine):
        return len(split), Counter()
    line = f" {b' '.join(split).decode('latin-1')} "
    return len(split), Counter(map(itemgetter(1), machine.iter(line)))


def _scan(shared: Broadcast):
    """Per text its length in terms, and the automaton's terms in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        ints = pa.list_(pa.int32())
        for batch in slices(batches, 1):
            lengths, found, counts = [], [], []
            for text in batch.column(1).to_pylist():
                n, hits = count_terms(text or b"", machine)
                lengths.append(n)
                found.append(np.fromiter(hits.keys(), np.int32, len(hits)))
                counts.append(np.fromiter(hits.values(), np.int32, len(hits)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(found, ints),
                 pa.array(counts, ints)],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def _holders(count: int):
    """How many rows of a task hold each of ``count`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(count, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch, 0), minlength=count)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])],
                                         names=["term_no", "df"])

    return run


def _flat(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class _Best:
    """The best documents of every item that a task has met."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(items, np.int64)  # 0 is no score

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """Offer ``scores`` of documents by items."""
        row, item = np.nonzero(scores >= self.least)
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item) :]]])
        doc = np.concatenate([self.doc, docs[row]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.top
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        last = place == self.top - 1
        self.least[item[last]] = score[last]


# Stands for a NULL id, after all others.
_NO_ID = np.iinfo(np.int64).max


def _rank(shared: Broadcast, n_docs: int, n_terms: int, top: int):
    """The ``top`` documents of each item among those of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items_of, n_items = shared.value
        best = _Best(n_items, top)
        step = max(1, _CELLS // n_items)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                docs = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                # Whole numbers of any size: the product may pass 64 bits.
                m = np.array([100 - 90 + 90 * n * n_docs // n_terms
                              for n in batch.column(1).to_pylist()], np.int64)
                row = np.repeat(np.arange(len(docs)), pc.list_value_length(
                    batch.column(2)).to_numpy(zero_copy_only=False))
                term, tf = _flat(batch, 2), _flat(batch, 3)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                order = np.argsort(term, kind="stable")
                row, term, part = row[order], term[order], part[order]
                first = np.flatnonzero(np.diff(term, prepend=-1))
                scores = np.zeros((len(docs), n_items), np.int64)
                for i, j in zip(first, np.append(first[1:], len(term)), strict=True):
                    # A term stands once in each row, and each of its items once.
                    scores[row[i:j, None], items_of[term[i]]] += part[i:j, None]
                best.add(scores, docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.doc, mask=best.doc == _NO_ID),
             pa.array(best.score)],
            names=["item_no", "doc_id", "score"],
        )

    return run


def _blocks(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(item_id, term, block, item_no) of all items, dealt to blocks of about ``most`` rows."""
    pairs = materialize(
        items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct(),
        "lexical-items",
    )
    count = -(-pairs.count() // most)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, count)))
    order = Window.partitionBy("block").orderBy(F.asc_nulls_first("item_id"))
    number = (F.dense_rank().over(order) - 1).cast("long")
    return materialize(pairs.withColumn("block", block).withColumn("item_no", number),
                       "lexical-blocks"), count


def _search_block(body: DataFrame, rows: list, top: int) -> DataFrame:
    """(item_no, doc_id, score) of one block of items, from its (term, item_no) rows."""
    spark = body.sparkSession
    items_of = {}
    for r in rows:
        items_of.setdefault(r.term, []).append(r.item_no)
    words = sorted(items_of)
    shared = spark.sparkContext.broadcast([word.encode() for word in words])
    matches = materialize(
        body.mapInArrow(lean(_scan(shared)),
                        "doc_id long, n long, terms array<int>, tfs array<int>"),
        "lexical-matches",
    )
    n_docs, n_terms = matches.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], _FOUND)
    matches = matches.where("size(terms) > 0")
    held = matches.select("terms").mapInArrow(_holders(len(words)), "term_no long, df long")
    df = held.groupBy("term_no").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(words), np.int64)
    for r in df.select("term_no", weight.alias("weight")).collect():
        weights[r.term_no] = r.weight
    lists = [np.array(items_of[word], np.int64) for word in words]
    n_items = 1 + max(r.item_no for r in rows)
    scoring = spark.sparkContext.broadcast((weights, lists, n_items))
    return matches.mapInArrow(lean(_rank(scoring, n_docs, n_terms, top)), _FOUND)


_FOUND = "item_no long, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, top: int = 10, block: int = 200_000) -> DataFrame:
    """The ``top`` documents of every item by a score in whole numbers, in the manner of BM25.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Returns
    item_id, rank (int from 1), doc_id and score (long) for scores above 0, equal scores by
    ascending doc_id, NULL ids last. Terms are runs of letters, digits and characters beyond
    ASCII, A-Z lower-cased. A document scores w * ((10**9 * tf) div (1000 * tf + 8 * m)) for each
    distinct term of the item, where w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    m = 10 + (90 * n * N) div L.

    Rows of equal item_id are one item with the terms of all; a NULL item_id is an item too. Each
    row of ``docs`` is a document, repeated ones included. NULL, empty and termless texts hold no
    term; empty tables give no rows.

    There is no index of the documents: tasks count the items' terms in whole texts by a broadcast
    Aho-Corasick automaton and keep (document, term, count) for these terms only. Items are dealt
    to blocks of about ``block`` (item, term) pairs, a few MB, so what the driver reads and
    broadcasts at once is bounded however many items there are; each block is one scan of the
    texts. A task passes on at most ``top`` documents per item.
    """
    spark = docs.sparkSession
    body = docs.select("doc_id", F.col("text").cast("binary").alias("_body"))
    pairs, blocks = _blocks(items, block)
    best = spark.createDataFrame([], f"block long, {_FOUND}")
    for number in range(blocks):
        rows = pairs.where(F.col("block") == number).select("term", "item_no").collect()
        if rows:
            found = _search_block(body, rows, top)
            best = best.unionByName(found.withColumn("block", F.lit(number).cast("long")))
    order = Window.partitionBy("block", "item_no").orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id")
    )
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = pairs.select("block", "item_no", "item_id").distinct()
    return ranked.join(names, ["block", "item_no"]).select("item_id", "rank", "doc_id", "score")
