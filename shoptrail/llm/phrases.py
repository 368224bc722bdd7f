"""Phrase collocations: FM-indexes over word ids count phrases per shard, Spark sums the shards."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrail.llm.text import give_back, lean, lean_group, slices
from shoptrail.session import materialize

# Characters that end a piece of a text, and those between words.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_GAPS = b"\x20\x09"

# Ends of pieces become a byte that no UTF-8 text holds.
_END = b"\xff"
_BYTES = bytes(
    _END[0] if b in _ENDS else 0x20 if b in _GAPS else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)

UNKNOWN_LANG = "und"

# A bitmap of this many bits (16 MB) is the most that is broadcast.
_MOST_BITS = 1 << 27
_PART_BITS = 1 << 15


def tokens(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words and ends of pieces of a text, in runs of whole pieces of about ``most`` bytes."""
    text = text.translate(_BYTES)
    start = 0
    while start < len(text):
        end = text.find(_END, start + most)
        end = len(text) if end < 0 else end + 1
        yield text[start:end].replace(_END, b" \xff ").split()
        start = end


class _Order:
    """The suffixes of a text of word ids (0 ends a piece), sorted by their first ``depth`` ids,
    with the ids before them (the Burrows-Wheeler transform) and their ranks."""

    def __init__(self, text: np.ndarray, depth: int, ids: int):
        n = len(text)
        rank, span = text, 1
        order = np.argsort(rank, kind="stable") if depth < 2 else None
        while span < depth:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:]
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
            span *= 2
        self.before = text[order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=ids)))
        # Occurrences of each id in ``before`` by place.
        spots = np.argsort(self.before, kind="stable")
        self.width = n + 1
        self.spots = self.before[spots] * self.width + spots

    def rank(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each id stands in ``before`` ahead of a place."""
        return np.searchsorted(self.spots, ids * self.width + place) - self.first[ids]


@dataclass
class Phrases:
    """Phrases of one length: their word ids (one row each), how often they occur, and where
    their suffixes begin in the forward and in the backward order."""

    words: np.ndarray
    count: np.ndarray
    forward: np.ndarray
    backward: np.ndarray


class PhraseIndex:
    """An FM-index in both directions over word ids; ids count from 1, and 0 ends a piece.

    Answers for phrases of up to ``depth`` words.
    """

    def __init__(self, text: np.ndarray, depth: int):
        text = np.concatenate([[0], text, [0]])
        self.ids = int(text.max()) + 1
        self.ahead = _Order(text, depth, self.ids)
        self.back = _Order(text[::-1].copy(), depth, self.ids)

    def words(self) -> Phrases:
        """All phrases of one word."""
        count = np.diff(self.ahead.first)[: self.ids]
        ids = np.flatnonzero(count[1:]) + 1
        return Phrases(ids[:, None], count[ids], self.ahead.first[ids], self.back.first[ids])

    def extend(self, phrases: Phrases, left: bool) -> Phrases:
        """All phrases with one more word on the left or on the right.

        The words before the suffixes of a phrase in one order are its extensions to that side. A
        backward step finds an extension's interval in this order; in the other one it is the part
        of the phrase's interval behind those of smaller ids.
        """
        side = self.ahead if left else self.back
        own, other = (phrases.forward, phrases.backward)[:: 1 if left else -1]
        total = int(phrases.count.sum())
        whose = np.repeat(np.arange(len(own)), phrases.count)
        offset = np.cumsum(phrases.count) - phrases.count
        place = np.arange(total) + (own - offset)[whose]
        key, count = np.unique(whose * self.ids + side.before[place], return_counts=True)
        parent, word = np.divmod(key, self.ids)
        ahead = np.cumsum(count) - count
        ahead -= ahead[np.searchsorted(parent, parent)]
        real = word > 0
        parent, word, count, ahead = parent[real], word[real], count[real], ahead[real]
        near = side.first[word] + side.rank(word, own[parent])
        far = other[parent] + ahead
        both = [word[:, None], phrases.words[parent]]
        return Phrases(
            np.concatenate(both if left else both[::-1], axis=1), count,
            near if left else far, far if left else near,
        )

    def phrases(self, depth: int) -> Iterator[Phrases]:
        """All phrases of 2 to ``depth`` words, grown to the right and to the left by turns."""
        found, left = self.words(), False
        for _ in range(depth - 1):
            found = self.extend(found, left)
            left = not left
            yield found


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed=42)


# Counts that a task holds before it passes them on, and those it passes on at once.
_HELD_COUNTS = 100_000
_OUT_COUNTS = 20_000

# A batch of buckets has about so many bytes.
_OUT_BYTES = 2 << 20


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each language, and of all its words under NULL.

    They leave in small batches and column by column, so that a worker holds little more than the
    counts.
    """

    def out():
        while counts:
            lang, found = counts.popitem()
            total = sum(found.values())
            words, numbers = iter(found), iter(found.values())
            for start in range(0, len(found), _OUT_COUNTS):
                n = min(_OUT_COUNTS, len(found) - start)
                yield batch_of(lang, list(islice(words, n)), list(islice(numbers, n)))
            yield batch_of(lang, [None], [total])

    def batch_of(lang, words, numbers):
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()),
             pa.array(numbers, pa.int64())],
            names=["lang", "word", "f"],
        )

    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches, 1, 1 << 20):
        for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            for run in tokens(text or b"", 1 << 18):
                counts[lang].update(run)
            counts[lang].pop(_END, None)
        if sum(map(len, counts.values())) > _HELD_COUNTS:
            yield from out()
            give_back()
    yield from out()


class _WordIds(dict):
    """Word -> its number from 1, or 0 if its bit is clear: it cannot be in a phrase."""

    def __init__(self, lang: str, bits: np.ndarray):
        super().__init__({_END: 0})
        self.bits, self.seed, self.last = bits, _seed(lang), 8 * len(bits) - 1
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        spot = xxhash.xxh64_intdigest(word, seed=self.seed) & self.last
        found = 0
        if self.bits[spot >> 3] >> (spot & 7) & 1:
            found = len(self.words)
            self.words.append(word)
        self[word] = found
        return found


class _Shard:
    """Word ids of the pieces of one language, without words that cannot be in a phrase."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.lang, self.ids = lang, _WordIds(lang, bits)
        self.parts, self.size = [], 0

    def add(self, text: bytes) -> None:
        for run in tokens(text):
            ids = np.fromiter(map(self.ids.__getitem__, run), np.int64, len(run))
            real = np.concatenate([[False], ids > 0, [False]])
            # A word alone is no phrase; one 0 stands for all between two runs of words.
            inner = real[1:-1] & (real[:-2] | real[2:])
            kept = inner | np.append(False, inner[:-1])
            ids = np.where(inner, ids, 0)[kept]
            self.parts += [ids, np.zeros(1, np.int64)]
            self.size += len(ids) + 1

    def buckets(self, depth: int, bits: int) -> pa.RecordBatch | None:
        """The phrases of the shard with their counts, one row per bucket that has any."""
        if not self.size:
            return None
        names = pa.array(self.ids.words, pa.large_binary())
        marks = np.array([xxhash.xxh64_intdigest(x) for x in self.ids.words], np.uint64)
        texts, counts, spots = [], [], []
        for found in PhraseIndex(np.concatenate(self.parts), depth).phrases(depth):
            columns = [names.take(pa.array(ids)) for ids in found.words.T]
            texts.append(pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())))
            counts.append(found.count)
            mixed = marks[found.words[:, 0]]
            with np.errstate(over="ignore"):
                for ids in found.words.T[1:]:
                    mixed = (mixed ^ mixed >> np.uint64(29)) * _ODD + marks[ids]
                mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD
            spots.append(mixed >> np.uint64(64 - bits))
        spot = np.concatenate(spots)
        if not len(spot):
            return None
        order = np.argsort(spot, kind="stable")
        spot, count = spot[order], np.concatenate(counts)[order]
        text = pa.concat_arrays(texts).take(pa.array(order))
        edges = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
        data = memoryview(text.buffers()[2] or b"")
        length = np.diff(edges).astype(np.uint32)
        first = np.flatnonzero(np.diff(spot, prepend=spot[0] + np.uint64(1)))
        cuts = list(zip(first, np.append(first[1:], len(spot)), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.lang] * len(cuts), pa.string()),
                pa.array(spot[first].astype(np.int32)),
                pa.array([bytes(data[edges[i] : edges[j]]) for i, j in cuts], pa.binary()),
                pa.array([length[i:j].tobytes() for i, j in cuts], pa.binary()),
                pa.array([count[i:j].tobytes() for i, j in cuts], pa.binary()),
            ],
            names=["lang", "bucket", "phrases", "lengths", "counts"],
        )


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BUCKETS = "lang string, bucket int, phrases binary, lengths binary, counts binary"


def _shards(shared: Broadcast, depth: int, most: int, bits: int):
    """Counts of the phrases of every shard of about ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        shards: dict[str, _Shard] = {}

        def rows(shard):
            found = shard.buckets(depth, bits)
            if found is not None:
                step = max(1, _OUT_BYTES * found.num_rows // found.nbytes)
                for start in range(0, found.num_rows, step):
                    yield found.slice(start, step)

        for batch in slices(batches, 1, 1 << 20):
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if lang not in shards:
                    shards[lang] = _Shard(lang, bitmap)
                shards[lang].add(text or b"")
                if shards[lang].size >= most:
                    yield from rows(shards.pop(lang))
            # Many languages hold little each: they go before they are too much together.
            if sum(s.size + len(s.ids) for s in shards.values()) >= 2 * most:
                for lang in list(shards):
                    yield from rows(shards.pop(lang))
        for lang in list(shards):
            yield from rows(shards.pop(lang))

    return run


def _sums(least: int):
    """The phrases of a bucket of one language with at least ``least`` occurrences in all shards."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lengths = np.frombuffer(b"".join(rows.column("lengths").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int64)
        edges = np.append(0, np.cumsum(lengths, dtype=np.int64))
        data = pa.py_buffer(b"".join(rows.column("phrases").to_pylist()))
        phrases = pa.Array.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), data]
        )
        table = pa.table({"phrase": phrases, "a": counts}).group_by("phrase", use_threads=False)
        table = table.aggregate([("a", "sum")])
        table = table.filter(pc.greater_equal(table.column("a_sum"), least))
        return pa.table({
            "lang": pa.array([key[0].as_py()] * table.num_rows, pa.string()),
            "phrase": table.column("phrase").cast(pa.large_string()).cast(pa.string()),
            "a": table.column("a_sum"),
        })

    return run


def _frequent_bits(words: DataFrame) -> bytes:
    """A bitmap with the bits of all given words of languages set.

    16 bits a word, but 2**27 bits at most (16 MB): beyond 8 million words more other words pass,
    which costs time but no result.
    """
    count = words.count()
    bits = max(_PART_BITS, min(_MOST_BITS, 1 << (16 * count).bit_length()))
    spot = F.xxhash64("lang", "word").bitwiseAND(F.lit(bits - 1).cast("long"))
    parts = (
        words.select((spot / _PART_BITS).cast("long").alias("part"),
                     F.pmod(spot, F.lit(_PART_BITS)).alias("bit"))
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    out = bytearray(bits // 8)
    for r in parts:
        at = r.part * _PART_BITS // 8
        out[at : at + _PART_BITS // 8] = r.bits
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = 10, depth: int = 3, shard_words: int = 500_000,
                  bucket_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """Two written tables: words (lang, word, f), where the row without a word counts all words of
    the language, and phrases (lang, phrase, a) of 2 to ``depth`` words; both of those with at
    least ``least`` occurrences.

    Tasks gather texts into shards of one language, build an FM-index of each and extend the
    intervals of its words in both directions. A word with fewer than ``least`` occurrences in all
    texts can be in no phrase, so shards end pieces at such words. They are told by a broadcast
    bitmap of bounded size, which may let others through but misses none.

    The counts of a shard, mostly of phrases that stand in no other one, are dealt to buckets by a
    hash of the phrase and summed there by the phrases themselves. The number of buckets follows
    the size of the texts; a phrase is one entry per shard at most, so no bucket is hot.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, (size // bucket_bytes).bit_length())
    body = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"),
        F.col("text").cast("binary").alias("_body"),
    )
    counted = body.mapInArrow(lean(_words), "lang string, word string, f long")
    words = materialize(
        counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))
        .where((F.col("f") >= least) | F.col("word").isNull()),
        "phrases-words",
    )
    shared = spark.sparkContext.broadcast(_frequent_bits(words.where("word IS NOT NULL")))
    found = body.mapInArrow(lean(_shards(shared, depth, shard_words, bits)), _BUCKETS)
    phrases = materialize(
        found.groupBy("lang", "bucket").applyInArrow(
            lean_group(_sums(least)), "lang string, phrase string, a long"
        ),
        "phrases-counts",
    )
    return words, phrases


def _part(words: Column, start: Column | int, size: Column) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.array_join(F.slice(words, start, size), " ")


def _extensions(phrases: DataFrame) -> DataFrame:
    """The highest count of a listed phrase that has one more word on the left or on the right."""
    words = F.split("phrase", " ")
    size = F.size(words)
    inner = F.array(
        F.struct(_part(words, 2, size - 1).alias("phrase"), F.col("a").alias("left"),
                 F.lit(0).cast("long").alias("right")),
        F.struct(_part(words, 1, size - 1).alias("phrase"), F.lit(0).cast("long").alias("left"),
                 F.col("a").alias("right")),
    )
    longer = phrases.where(size > 2).select("lang", F.explode(inner).alias("x"))
    return longer.groupBy("lang", F.col("x.phrase").alias("phrase")).agg(
        F.max("x.left").alias("best_left"), F.max("x.right").alias("best_right")
    )


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, score, k, l, r) of the lowest-scoring cut of every phrase."""
    parts = F.split("phrase", " ")
    size = F.size(parts)
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), _part(parts, 1, k).alias("first"),
        _part(parts, k + 1, size - k).alias("rest")))
    cut = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select(
        "lang", "phrase", "a", "cut.*"
    )
    known = words.where("word IS NOT NULL").select("lang", F.col("word").alias("part"), "f")
    known = known.unionByName(
        phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    )
    # Parts of a phrase are as frequent as it is, so each is known.
    for side, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(known.select("lang", F.col("part").alias(side), F.col("f").alias(name)),
                       ["lang", side])
    # Counts below 10**15: all products stay within 38 digits, and the quotient below 10**6 + 1.
    score = F.expr(
        "CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))"
        " div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"
    )
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cut.groupBy("lang", "phrase", "a").agg(best).select(
        "lang", "phrase", "a", "best.*"
    )


def collocations(docs: DataFrame, least: int = 10, depth: int = 3, limit: int = 2000,
                 share: int = 50, shard_words: int = 500_000) -> DataFrame:
    """The first ``limit`` phrases of 2 to ``depth`` words of every language by how much more often
    their words stand together than apart.

    Returns lang, rank (int from 1), phrase (words joined by one space), a (its occurrences), l, r
    (those of the two parts of its lowest-scoring cut), n (words of the language), score
    (floor(10**6 * a * a / (l * r))), best_left and best_right (occurrences of the most frequent
    phrase with one more word on that side, 0 if it has fewer than ``least``). Order: score and a
    descending, phrase ascending. Phrases have at least ``least`` occurrences; one is left out if
    an extension has at least ``share`` percent of its occurrences.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs,
    A-Z lower-cased. A NULL lang is ``und``; NULL and empty texts have no words; every row counts,
    repeated ones too; an empty table gives no rows; other columns are ignored. A piece is held
    whole by its task.
    """
    words, phrases = phrase_counts(docs, least, depth, shard_words)
    scored = _scored(phrases, words).join(_extensions(phrases), ["lang", "phrase"], "left")
    scored = scored.withColumns({
        side: F.coalesce(side, F.lit(0).cast("long")) for side in ("best_left", "best_right")
    })
    longest = F.greatest("best_left", "best_right")
    whole = (longest == 0) | (100 * longest < share * F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.where(whole).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= limit
    )
    totals = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "best_left", "best_right"
    )
