"""Near-duplicate documents by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.components import connected_components, spanning
from shoptrail.llm.text import free_names, lean, slices
from shoptrail.operators.membership import split_by_keys
from shoptrail.session import materialize

BITS = 64

# Below so many leaves on either side together, a node pair is compared leaf by leaf.
_LEAVES = 24

# Node pairs that one step of the traversal holds.
_STEP = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The majority of the hash bits of all ``words``-word shingles, repeats included.

    Shorter texts are one shingle; a text without words has fingerprint 0.
    """
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    shingles = [b" ".join(found)] if n == 1 else map(
        b" ".join, zip(*(found[i:] for i in range(words)), strict=False)
    )
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, count=n
    ).view(np.uint8)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255 * 8 * 64):
        bits = np.unpackbits(hashes[start : start + 255 * 8 * 64], bitorder="little")
        bits = bits.reshape(-1, BITS)
        whole = len(bits) // 255 * 255
        if whole:
            # Sums of 255 bits fit a byte.
            parts = np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8)
            ones += parts.sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body = batch.column("body").to_pylist()
            prints = np.array([fingerprint(x or b"", words, seed) for x in body], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(prints.view(np.int64))],
                names=[*keep, "print"],
            )

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``print``, the 64 bits as a long; one row per document."""
    body = docs.select(*keep, F.col("text").cast("binary").alias("body"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return body.mapInArrow(
        lean(_fingerprints(words, seed, list(keep))), ", ".join([*fields, "print long"])
    )


def _masks(bits: int, budget: int) -> list[int]:
    """All values of ``bits`` bits with at most ``budget`` ones."""
    masks = [0]
    for _ in range(budget):
        masks = sorted({m | 1 << i for m in masks for i in range(bits)} | set(masks))
    return masks


class _Trie:
    """A binary trie over sorted distinct fingerprints; a node is a range [lo, hi) and a depth."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def split(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the child with a 1 at ``depth`` begins."""
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        first = (self.values[lo] & ~(bit | (bit - np.uint64(1)))) | bit
        return np.clip(np.searchsorted(self.values, first), lo, hi)


def trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int):
    """Pairs of fingerprints that differ in at most ``budget`` bits, in pieces (a, b).

    ``right`` None pairs ``left`` with itself. The arrays are sorted, distinct, and equal within
    each in their first ``depth`` bits. Pairs of nodes go down together; a pair whose differing
    bits exceed the budget is dropped with all below it.
    """
    own = right is None
    a, b = _Trie(left), _Trie(left if own else right)
    if not len(a.values) or not len(b.values):
        return
    above = int(np.bitwise_count((a.values[0] ^ b.values[0]) >> np.uint64(BITS - depth))
                if depth else 0)
    if above > budget:
        return
    one = np.ones(1, np.int64)
    stack = [(depth, 0 * one, len(a.values) * one, 0 * one, len(b.values) * one, above * one)]
    while stack:
        level, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > _STEP:
            half = len(alo) // 2
            stack.append((level, *(x[half:] for x in (alo, ahi, blo, bhi, diff))))
            stack.append((level, *(x[:half] for x in (alo, ahi, blo, bhi, diff))))
            continue
        small = (ahi - alo) * (bhi - blo) <= _LEAVES
        if level == BITS:
            small[:] = True
        if small.any():
            yield from _leaves(a.values, b.values, alo[small], ahi[small], blo[small],
                               bhi[small], own, budget)
            rest = ~small
            alo, ahi, blo, bhi, diff = (x[rest] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        amid, bmid = a.split(alo, ahi, level), b.split(blo, bhi, level)
        nodes = []
        for a0, a1, b0, b1, more in (
            (alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0),
            (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1),
        ):
            keep = (a1 > a0) & (b1 > b0) & (diff + more <= budget)
            if own:
                keep &= a0 <= b0  # a pair of one trie's nodes is met once
            nodes.append((a0[keep], a1[keep], b0[keep], b1[keep], diff[keep] + more))
        merged = [np.concatenate(x) for x in zip(*nodes, strict=True)]
        if len(merged[0]):
            stack.append((level + 1, *merged))


def _leaves(left, right, alo, ahi, blo, bhi, own, budget):
    """All leaf pairs of small node pairs, those within the budget only."""
    width = bhi - blo
    size = (ahi - alo) * width
    pair = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i, j = alo[pair] + at // width[pair], blo[pair] + at % width[pair]
    near = np.bitwise_count(left[i] ^ right[j]) <= budget
    if own:
        near &= i < j
    if near.any():
        yield left[i[near]], right[j[near]]


def _join(budget: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        """One pair of trie nodes with all fingerprints below them."""
        a, b, depth = (x.as_py() for x in key)
        prints = np.unique(block.column("print").to_numpy().view(np.uint64))
        if a == b:
            pieces = trie_pairs(prints, None, depth, budget)
        else:
            at = np.searchsorted(prints >> np.uint64(BITS - depth), max(a, b))
            pieces = trie_pairs(prints[:at], prints[at:], depth, budget)
        v, p, held = [], [], 0
        stars = []
        for x, y in pieces:
            v.append(x.view(np.int64)), p.append(y.view(np.int64))
            held += len(x)
            if held > 1 << 20:  # links are reduced to a forest as they are found
                stars = [spanning(np.concatenate(v), np.concatenate(p))]
                v, p = [x for x, _ in stars], [y for _, y in stars]
                held = len(v[0])
        if v:
            x, y = spanning(np.concatenate(v), np.concatenate(p))
        else:
            x = y = np.zeros(0, np.int64)
        return pa.table({"v": x, "p": y})

    return run


def links(prints: DataFrame, budget: int = 2, node_rows: int = 4096,
          block_rows: int = 60_000, stride: int = 6) -> DataFrame:
    """Links (v, p) that connect the distinct fingerprints (column ``print``) within ``budget``
    differing bits: not all pairs, but a forest with the same components.

    The top of the trie is walked by Spark: every fingerprint is dealt to the node pairs of its
    first bits that are within the budget. A node pair with more than ``block_rows`` fingerprints
    goes ``stride`` bits deeper and sheds what exceeds the budget, as often as it takes; the rest
    is walked inside tasks.
    """
    count = prints.count()
    depth = min(20, max(2, (max(1, count) // node_rows).bit_length() + 1))
    value = "shiftrightunsigned(print, {})"
    masks = ", ".join(map(str, _masks(depth, budget)))
    rows = prints.selectExpr("print", value.format(BITS - depth) + " AS node",
                             f"explode(array({masks})) AS mask")
    rows = rows.selectExpr(
        "print", "least(node, node ^ mask) AS a", "greatest(node, node ^ mask) AS b"
    )
    found = None
    while True:
        sizes = rows.groupBy("a", "b").agg(F.count("*").alias("rows"))
        heavy = materialize(sizes.where(F.col("rows") > block_rows).select("a", "b"), "trie")
        last = depth + stride >= BITS or heavy.isEmpty()
        light = rows if last else rows.hint("merge").join(heavy, ["a", "b"], "left_anti")
        part = (
            light.withColumn("depth", F.lit(depth))
            .groupBy("a", "b", "depth")
            .applyInArrow(_join(budget), "v long, p long")
        )
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        masks = ", ".join(map(str, _masks(stride, budget)))
        below = BITS - depth - stride
        rows = (
            # The size of exploded rows is unknown to the planner: they are never broadcast.
            rows.hint("merge").join(heavy, ["a", "b"])
            .selectExpr("*", value.format(below) + " AS node", f"explode(array({masks})) AS mask")
            # The partner's node: the other side's bits so far, then the changed next bits.
            .selectExpr(
                "print",
                "node",
                f"shiftleft(IF(shiftrightunsigned(node, {stride}) = a, b, a), {stride})"
                f" | ((node & {(1 << stride) - 1}) ^ mask) AS other",
            )
            .where(f"bit_count(node ^ other) <= {budget}")
            .selectExpr("print", "least(node, other) AS a", "greatest(node, other) AS b")
        )
        rows = materialize(rows, "trie")
        depth += stride


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, seed: int = 42,
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Group documents whose fingerprints are linked by at most ``budget`` differing bits.

    Returns the columns ``keep`` (doc_id and more), print, component (a fingerprint that stands for
    the group) and component_id, the smallest doc_id reachable by links, itself included, for every
    row of ``docs``. Copies share a fingerprint, so they meet once and
    are never paired with each other. A NULL or wordless text has fingerprint 0 and links like any
    other; a NULL doc_id takes part but names no component unless all ids of it are NULL; repeated
    rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words, seed, keep), "fingerprints")
    classes = materialize(
        prints.groupBy("print").agg(F.min("doc_id").alias("least")), "fingerprint-classes"
    )
    roots = connected_components(links(classes.select("print"), budget), "fingerprint-links")
    roots = roots.withColumnRenamed("node", "print")
    linked = classes.join(roots, "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(named, "component").select("print", "component", "component_id")
    return prints.join(named, "print").select(*keep, "print", "component", "component_id")


def one_of_each(docs: DataFrame, group) -> DataFrame:
    """One row of each component that ``group`` (keyed docs, key columns) finds.

    It is the row with the smallest doc_id (NULL last); of several such rows with other texts, one
    chosen by a hash; of rows equal in id and text any one.

    Rows that are alone under their id and text and are chosen pass as they are, told by bitmaps
    of the keys of all others; only the others and a few more are shuffled with their texts.
    """
    body = F.col("text").cast("binary")
    key, key2, rows, kept, hit = free_names(docs, "_key", "_key2", "_rows", "_kept", "_hit")
    keyed = docs.withColumns(
        {key: F.xxhash64("doc_id", body), key2: F.xxhash64(body, F.lit(1), "doc_id")}
    )
    groups = group(keyed, ("doc_id", key, key2))
    groups = materialize(
        groups.groupBy("component", "doc_id", key, key2).agg(F.count("*").alias(rows)), "groups"
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key, key2)
    chosen = groups.groupBy("component").agg(F.min(order).alias("row"))
    chosen = chosen.select(f"row.{key}", f"row.{key2}", F.lit(True).alias(kept))
    others = groups.join(chosen, [key, key2], "left").where(F.col(kept).isNull() | (F.col(rows) > 1))
    others = materialize(
        others.select(key, key2, F.coalesce(kept, F.lit(False)).alias(kept)), "groups-others"
    )
    alone, rest = split_by_keys(keyed, others, key, hit)
    rest = rest.join(others, [key, key2], "left").where(F.coalesce(kept, F.lit(True)))
    rest = rest.dropDuplicates([key, key2])
    return alone.select(*docs.columns).unionByName(rest.select(*docs.columns))


def representatives(docs: DataFrame, words: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """One row of each group of near duplicates, in the columns of ``docs``, as ``one_of_each``."""
    return one_of_each(docs, lambda keyed, keys: near_duplicates(keyed, words, budget, seed, keys))
