"""Small helpers that several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, which separates words.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has: those wanted, lengthened if taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; NULL has none."""
    # Everything but the first byte of each word is cut away, which needs no array of words.
    return F.coalesce(
        F.regexp_count(text, F.lit(WORD)).cast("long"),
        F.lit(0).cast("long"),
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20):
    """The batches in slices whose ``column`` (binary or string) holds about ``most`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        start, held = 0, 0
        for row, size in enumerate(sizes.to_pylist()):
            held += size
            if held >= most:
                yield batch.slice(start, row + 1 - start)
                start, held = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A ``mapInArrow`` function after which its Python worker, which lives on, is small again."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def lean_group(run):
    """The same for an ``applyInArrow`` function of few large groups."""

    @wraps(run)
    def task(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = run(key, rows)
        give_back()
        return out

    return task


class WordHashes(dict):
    """Word -> its 64-bit hash as 8 bytes; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        digest = self[word] = xxhash.xxh64_digest(word)
        return digest
