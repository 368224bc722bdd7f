"""Exact removal of repeated word windows, found by Rabin-Karp hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.text import WordHashes, free_names, lean, lean_group, slices
from shoptrail.operators.membership import split_by_keys
from shoptrail.session import materialize

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of a number modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.values = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = self.values[-1] * self.base
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


class WindowHashes:
    """Rabin-Karp hashes of all windows of ``width`` words of a text."""

    def __init__(self, width: int):
        self.width = width
        self.words = WordHashes()
        self.up, self.down = _Powers(_BASE), _Powers(_INVERSE)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(words) < self.width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            values = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint64)
            sums = np.cumsum(values * self.up(len(values)), dtype=np.uint64)
            sums[self.width :] = sums[self.width :] - sums[: -self.width]
            found = sums[self.width - 1 :] * self.down(len(values) - self.width + 1)
            # Spread over all bits: buckets are taken from the highest.
            found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return found ^ (found >> np.uint64(32))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of sorted numbers by place, highest first: those vary slowly and compress."""
    return values.view(np.uint8).reshape(len(values), -1).T[::-1].tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes[::-1].T).view(kind).ravel()


class _Chunk:
    """Window hashes of a run of documents, and whose they are."""

    def __init__(self):
        self.hashes, self.owners, self.rows = [], [], 0

    def add(self, owner: tuple, found: np.ndarray, first: int) -> None:
        self.owners.append((*owner, first, self.rows))
        self.hashes.append(found)
        self.rows += len(found)

    def buckets(self, bits: int) -> pa.RecordBatch:
        """One row per bucket of hashes. Each distinct hash stands once, with the place of one of
        its windows; windows that repeat within the chunk are listed by place as repeated."""
        hashes = np.concatenate(self.hashes)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.ones(len(hashes), bool)
        first[1:] = hashes[1:] != hashes[:-1]
        starts = np.flatnonzero(first)
        known = np.diff(np.append(starts, len(hashes))) > 1
        owners = np.array(
            [(i or 0, i is not None, h, f, s) for i, h, f, s in self.owners], np.int64
        ).tobytes()
        chunk = xxhash.xxh64_intdigest(owners) - (1 << 63)
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cuts = np.append(np.searchsorted(hashes[starts], edges), len(starts))
        spots = np.append(np.searchsorted(hashes, edges), len(hashes))
        again = ~first
        out = []
        for k in range(1 << bits):
            i, j, x, y = cuts[k], cuts[k + 1], spots[k], spots[k + 1]
            if i == j:
                continue
            out.append((
                k, chunk, _planes(hashes[starts[i:j]]),
                _planes(order[starts[i:j]].astype(np.uint32)), np.packbits(known[i:j]).tobytes(),
                order[x:y][again[x:y]].astype(np.uint32).tobytes(), None,
            ))
        out[0] = (*out[0][:-1], owners)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _BUCKET_TYPES, strict=True)],
            names=_BUCKET_NAMES,
        )


_BUCKET_NAMES = ["bucket", "chunk", "hashes", "places", "known", "again", "owners"]
_BUCKET_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
_BUCKETS = ("bucket int, chunk long, hashes binary, places binary, known binary, again binary,"
            " owners binary")


def _chunks(width: int, bits: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowHashes(width)
        chunk = _Chunk()
        for batch in slices(batches, "body"):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "print", "body"))
            for doc_id, mark, body in zip(*columns, strict=True):
                found = windows(body or b"")
                # A very long document spans several chunks.
                for start in range(0, len(found), rows):
                    chunk.add((doc_id, mark), found[start : start + rows], start)
                    if chunk.rows >= rows:
                        yield chunk.buckets(bits)
                        chunk = _Chunk()
        if chunk.rows:
            yield chunk.buckets(bits)

    return run


def _repeated(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The places of all windows of one bucket whose hash stands anywhere else."""
    hashes = [_from_planes(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    known = [
        np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool)
        for x, h in zip(rows.column("known").to_pylist(), hashes, strict=True)
    ]
    every = np.sort(np.concatenate(hashes))
    twice = every[1:][every[1:] == every[:-1]]  # a hash stands once in each chunk
    del every
    chunk, places = [], []
    columns = (rows.column(c).to_pylist() for c in ("chunk", "places", "again"))
    for own, at, again, mine, before in zip(*columns, hashes, known, strict=True):
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, mine), len(twice) - 1)
            before |= twice[spot] == mine
        found = _from_planes(at, np.uint32)[before].tobytes() + again
        chunk.append(own), places.append(found)
    kept = [i for i, p in enumerate(places) if p or rows.column("owners")[i].is_valid]
    return pa.table(
        [
            pa.array([chunk[i] for i in kept], pa.int64()),
            pa.array([places[i] for i in kept], pa.binary()),
            pa.array([rows.column("owners")[i].as_py() for i in kept], pa.binary()),
        ],
        names=["chunk", "places", "owners"],
    )


def _intervals(width: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Repeated windows of one chunk merged into the word ranges they cover."""
        owners = next(x for x in rows.column("owners").to_pylist() if x is not None)
        owners = np.frombuffer(owners, np.int64).reshape(-1, 5)
        places = np.unique(np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint32))
        places = places.astype(np.int64)
        out = []
        if len(places):
            owner = np.searchsorted(owners[:, 4], places, side="right") - 1
            start = places - owners[owner, 4] + owners[owner, 3]
            new = np.ones(len(places), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + width)
            begins = np.flatnonzero(new)
            ends = start[np.append(begins[1:], len(places)) - 1] + width
            whose = owner[begins]
            splits = np.flatnonzero(np.diff(whose)) + 1
            for s, e, w in zip(np.split(start[begins], splits), np.split(ends, splits),
                               whose[np.append(0, splits)], strict=True):
                doc_id, known, mark = (int(v) for v in owners[w, :3])
                out.append((doc_id if known else None, mark, s.tobytes(), e.tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                        names=["doc_id", "print", "starts", "ends"])

    return run


def _print(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal id and text are one text to the operator."""
    body = F.col("text").cast("binary")
    named = dict.fromkeys(["doc_id", *keep])
    return docs.select(*named, F.xxhash64("doc_id", body).alias("print"), body.alias("body"))


def repeated_ranges(docs: DataFrame, width: int = 35, chunk_rows: int = 1_000_000,
                    bucket_bytes: int = 16 << 20) -> DataFrame:
    """The word ranges of every text that are covered by repeated windows of ``width`` words.

    Returns (doc_id, print, starts, ends), several rows for a text where it was split; starts and
    ends are packed longs, words from 0, ends exclusive. A window is repeated if a window of equal
    words starts anywhere else, same text included; windows are equal if their 64-bit hashes are
    (for n windows about n*n / 2**65 pairs of unequal ones meet by chance).

    Tasks hash all windows of a run of texts and sort them into buckets, each distinct hash once,
    so a passage in every text adds one row per run. Spark deals the buckets out (their number
    follows the size of the texts), repeated hashes are found per bucket, and their places go back
    to the runs, where they merge into maximal ranges.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // bucket_bytes).bit_length())
    hashed = _print(docs).select("doc_id", "print", "body").mapInArrow(
        lean(_chunks(width, bits, chunk_rows)), _BUCKETS
    )
    places = hashed.groupBy("bucket").applyInArrow(
        lean_group(_repeated), "chunk long, places binary, owners binary"
    )
    return places.groupBy("chunk").applyInArrow(
        lean_group(_intervals(width)), "doc_id long, print long, starts binary, ends binary"
    )


def _covered(n: int, starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """Which of ``n`` words lie in a range."""
    steps = np.zeros(n + 1, np.int64)
    for s, e in zip(starts, ends, strict=True):
        np.add.at(steps, np.frombuffer(s, np.int64), 1)
        np.add.at(steps, np.frombuffer(e, np.int64), -1)
    return np.cumsum(steps[:n]) > 0


def _cut(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            counts, removed, kept = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("body", "starts", "ends"))
            for body, starts, ends in zip(*columns, strict=True):
                words = (body or b"").split()
                counts.append(len(words))
                if starts:
                    gone = _covered(len(words), starts, ends)
                    removed.append(int(gone.sum()))
                    words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=[*keep, "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated(docs: DataFrame, width: int = 35, keep: tuple[str, ...] = ("doc_id",)
                    ) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts elsewhere.

    Returns the columns ``keep``, n_words, n_removed and ``kept`` (the words left, joined by one
    space, UTF-8 bytes), one row per row of ``docs``. Words stand between ASCII white space and are
    compared unchanged. NULL and empty texts have no words; shorter texts than a window stay whole;
    repeated rows lose all their windows, as each stands elsewhere; NULL and repeated ids are told
    apart by their texts; an empty table gives no rows; other columns are ignored.

    The ranges are written once; texts that certainly have none, told by bitmaps of the prints of
    those that do, stay where they are, the others are joined with their ranges.
    """
    ranges = materialize(
        repeated_ranges(docs, width)
        .groupBy("doc_id", "print")
        .agg(F.collect_set(F.struct("starts", "ends")).alias("ranges")),
        "repeated-ranges",
    )
    texts = _print(docs, keep)
    whole, rest = split_by_keys(texts, ranges, "print", *free_names(texts, "_hit"))
    ranges = ranges.withColumnsRenamed({"doc_id": "_doc_id", "print": "_print"})
    same = rest["doc_id"].eqNullSafe(ranges["_doc_id"]) & (rest["print"] == ranges["_print"])
    joined = rest.join(ranges, same, "left").select(
        *(rest[c] for c in keep), "body", "ranges.starts", "ranges.ends"
    )
    none = F.lit(None).cast("array<binary>")
    whole = whole.select(*keep, "body", none.alias("starts"), none.alias("ends"))
    joined = whole.unionByName(joined)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "n_words long", "n_removed long", "kept binary"])
    return joined.mapInArrow(lean(_cut(list(keep))), schema)


