"""Near copies of documents by the similarity of their whole sets of shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm import simhash
from shoptrail.llm.components import connected_components
from shoptrail.llm.text import lean, slices
from shoptrail.operators.membership import split_by_keys
from shoptrail.session import materialize

# Shingles whose minima are taken in one step, or pairs compared in one.
_STEP = 2048

# Shingles of the sets of a block, about.
_SHINGLES = 1 << 21


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all ``words``-word shingles.

    Shorter texts are one shingle; a text without words has none.
    """
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    shingles = [b" ".join(found)] if n == 1 else map(
        b" ".join, zip(*(found[i:] for i in range(words)), strict=False)
    )
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    return np.unique(np.fromiter(hashes, np.uint64, count=n))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def fingerprint_of(shingles: np.ndarray) -> np.uint64:
    """The SimHash of a set: bits that more than half of its hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _STEP):
        bits = np.unpackbits(shingles[i : i + _STEP].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]


def _sketches(words: int, bands: int, width: int, seed: int, keep: list[str]):
    """Each document's set: its name, size and fingerprint, its minima and their bands' hashes."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, bands * width, np.uint64)
    odd = (odd << np.uint64(1) | np.uint64(1))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            sets, sizes, prints, minima, found = [], [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                shingles = shingle_set(text or b"", words, seed)
                sets.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                sizes.append(len(shingles))
                prints.append(fingerprint_of(shingles))
                if not len(shingles):
                    minima.append(b"")
                    found.append([])
                    continue
                least = np.min([(odd * shingles[i : i + _STEP]).min(axis=1)
                                for i in range(0, len(shingles), _STEP)], axis=0)
                least = (least >> np.uint64(32)).astype(np.uint32)
                minima.append(least.tobytes())
                found.append([
                    np.uint64(xxhash.xxh64_intdigest(band.tobytes(), seed=no)).astype(np.int64)
                    for no, band in enumerate(least.reshape(bands, width))
                ])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(keep))),
                    pa.array(np.array(sets, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(minima, pa.binary()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=[*keep, *_SKETCH],
            )

    return run


_SKETCH = ("set", "size", "print", "minima", "bands")
_SKETCH_TYPES = "set long, size long, print long, minima binary, bands array<long>"


def likely_pairs(left: np.ndarray, right: np.ndarray, sizes: tuple, parts: tuple, own: bool,
                 similarity: float, agree: float, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks of minima (one row each) in different parts that may be similar
    enough: their sizes allow it and a share of at least ``agree`` of their minima is equal.

    With ``own`` both blocks are the same one, and j < i. With ``best`` each i has only its pair
    with the most equal minima.
    """
    none = np.zeros(0, np.int64)
    found_i, found_j = [none], [none]  # a block may be empty
    step = max(1, (1 << 24) // max(1, right.size))
    for at in range(0, len(left) if len(right) else 0, step):
        rows = slice(at, at + step)
        equal = (left[rows, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int64)
        a, b = sizes[0][rows, None], sizes[1][None, :]
        near = (equal >= agree * left.shape[1]) & (
            parts[0][rows, None] != parts[1][None, :]
        ) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
        if own:
            near &= np.arange(len(right))[None, :] < (at + np.arange(near.shape[0]))[:, None]
        if best:
            j = np.where(near, equal, -1).argmax(axis=1)
            i = np.flatnonzero(near[np.arange(len(j)), j])
            j = j[i]
        else:
            i, j = np.nonzero(near)
        found_i.append(i + at), found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def first_met(left: np.ndarray, right: np.ndarray, width: int, no: np.ndarray) -> np.ndarray:
    """Whether band ``no`` is the first one in which minima, paired row by row, agree."""
    out = np.empty(len(no), bool)
    for at in range(0, len(no), _STEP):
        rows = slice(at, at + _STEP)
        agree = (left[rows] == right[rows]).reshape(len(no[rows]), -1, width).all(axis=2)
        out[rows] = agree.any(axis=1) & (agree.argmax(axis=1) == no[rows])
    return out


class _Block:
    """Two blocks of a band, or one: their sets and the likely pairs (places) among them."""

    def __init__(self, rows: pa.Table, i: int, j: int, width: int, similarity: float,
                 agree: float):
        self.rows, self.width, self.own = rows, width, i == j
        self.names, self.parts, self.no, block, self.sizes = (
            rows.column(c).to_numpy() for c in ("set", "part", "no", "block", "size"))
        minima = np.frombuffer(b"".join(rows.column("minima").to_pylist()), np.uint32)
        self.minima = minima.reshape(len(self.names), -1)
        self.x, self.y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        self.similarity, self.agree = similarity, agree

    def pairs(self, best: bool) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.x, self.y
        a, b = likely_pairs(self.minima[x], self.minima[y], (self.sizes[x], self.sizes[y]),
                            (self.parts[x], self.parts[y]), self.own, self.similarity,
                            self.agree, best)
        return x[a], y[b]

    def first_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Those likely pairs that meet in no earlier band."""
        a, b = self.pairs(False)
        new = first_met(self.minima[a], self.minima[b], self.width, self.no[a])
        return a[new], b[new]

    def links(self, a: np.ndarray, b: np.ndarray) -> pa.Table:
        a, b = self.names[a], self.names[b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _partners(block: _Block) -> pa.Table:
    """Each set with its likeliest partner, and the hub of the block, the set with the most likely
    partners, with all of them."""
    a, b = block.pairs(True)
    if len(a) > 1:
        c, d = block.first_pairs()
        if len(c):
            hub = np.bincount(np.concatenate([c, d])).argmax()
            near = (c == hub) | (d == hub)
            a, b = np.concatenate([a, c[near]]), np.concatenate([b, d[near]])
    return block.links(a, b)


def _ends(block: _Block) -> pa.Table:
    """The rows of all sets in likely pairs that meet in no earlier band."""
    return block.rows.take(pa.array(np.unique(np.concatenate(block.first_pairs()))))


def _similar(words: int, seed: int):
    def run(block: _Block) -> pa.Table:
        """Links between parts: likely pairs whose whole sets are similar enough, the likeliest
        first. What links have joined is not compared again."""
        a, b = block.first_pairs()
        equal = np.empty(len(a), np.int64)
        for at in range(0, len(a), _STEP):
            rows = slice(at, at + _STEP)
            equal[rows] = (block.minima[a[rows]] == block.minima[b[rows]]).sum(axis=1)
        bodies = block.rows.column("body")
        sets, root, found = {}, {}, []

        def part(x):
            x = parts[x]
            while x in root:
                x = root[x]
            return x

        def shingles(x):
            if x not in sets:
                sets[x] = shingle_set(bodies[x].as_py(), words, seed)
            return sets[x]

        parts = block.parts.tolist()
        for k in np.argsort(-equal, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            u, v = part(x), part(y)
            if u != v and similarity_of(shingles(x), shingles(y)) >= block.similarity:
                root[u] = v
                found.append(k)
        return block.links(a[found], b[found])

    return run


def _by_blocks(of, width: int, similarity: float, agree: float):
    """``of`` every pair of blocks, from rows that come sorted by band and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, found = [], None, []

        def close():
            if key is not None:
                rows = pa.Table.from_batches(held)
                found.append(of(_Block(rows, *key[1:], width, similarity, agree)))

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("band", "i", "j")]
            new = np.any([np.diff(c) != 0 for c in columns], axis=0) if batch.num_rows else []
            cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                own = tuple(int(c[start]) for c in columns)
                if own != key:
                    close()
                    held, key = [], own
                held.append(batch.slice(start, end - start))
            if sum(x.num_rows for x in found) > 20_000:
                yield from pa.concat_tables(found).combine_chunks().to_batches()
                found.clear()
        close()
        if found:
            yield from pa.concat_tables(found).combine_chunks().to_batches()

    return run


_ROWS = ("band long, i int, j int, no int, block int, set long, size long, part long, "
         "minima binary")


def _blocks(placed: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Sets of bands that hold several parts, once for each pair of blocks that they are in.

    ``placed`` has no and band, set, size and part, ``classes`` set and minima. A band of many or
    large sets is cut into blocks, so a pair of blocks fits a task.
    """
    sizes = placed.groupBy("band").agg(
        F.count("*").alias("sets"), F.sum("size").alias("shingles"),
        F.min("part").alias("x"), F.max("part").alias("y"),
    )
    # Bands whose sets are all connected have nothing left to compare.
    sizes = sizes.where("x <> y").select("band", F.expr(
        f"CAST(1 + greatest((sets - 1) div {block}, shingles div {_SHINGLES}) AS INT)"
    ).alias("blocks"))
    rows = materialize(placed.join(sizes, "band"), "copies-open")
    rows = rows.join(classes.select("set", "minima"), "set").withColumn(
        "block", F.expr("CAST(pmod(xxhash64(set, 1), blocks) AS INT)")
    )
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "no", "block", "set", "size", "part", "minima",
    )


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ["band", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _alike(words: int, similarity: float, seed: int):
    """Those pairs of texts whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in slices(batches, "b_body"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            near = []
            for i in range(batch.num_rows):
                if a[i] != last:  # the pairs of one text mostly follow each other
                    last = a[i]
                    left = shingle_set(batch.column("a_body")[i].as_py(), words, seed)
                right = shingle_set(batch.column("b_body")[i].as_py(), words, seed)
                near.append(similarity_of(left, right) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, seed: int):
    """The pairs (a, b) of sets that are similar enough; ``texts`` has one text of each set."""
    a, b = (texts.select(F.col("set").alias(x), F.col("body").alias(f"{x}_body")) for x in "ab")
    # Texts are never broadcast.
    both = pairs.hint("merge").join(a.hint("merge"), "a").hint("merge").join(b.hint("merge"), "b")
    return both.select("a", "b", "a_body", "b_body").mapInArrow(
        lean(_alike(words, similarity, seed)), "a long, b long"
    )


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 20,
                width: int = 4, seed: int = 42, keep: tuple[str, ...] = ("doc_id",),
                budget: int = 2, agree: float = 0.6, block: int = 512) -> DataFrame:
    """Group documents linked by a Jaccard similarity of at least ``similarity`` between their
    sets of ``words``-word shingles.

    Returns the columns ``keep`` (doc_id and more) and ``component``, the name of a set that stands
    for the group, for every row of ``docs``. Documents with equal sets are one class. Pairs of
    classes are found in three rounds, and each counts only if the whole sets are similar enough:

    1. SimHash: the trie self-join groups sets whose fingerprints are linked by ``budget`` differing
       bits or fewer; every set is compared with the smallest of its group. Large groups of copies
       with few changes are one part from here on.
    2. Sets of different parts that agree in one of ``bands`` bands of ``width`` minima: each with
       that earlier set of its band with which it shares the most minima, and the hub of a band,
       the set with the most likely partners, with all of them.
    3. All such pairs that are still in different parts, each in the first band that it shares.

    Rounds 2 and 3 compare minima inside tasks and go on with only pairs with a share of at least
    ``agree`` of all minima equal and sizes that allow the similarity. With the defaults a pair
    at 0.8 exactly meets in a band with probability 0.99997 and has enough equal minima with
    0.99999; a closer one more surely. Bands of many sets are compared in pairs of blocks. The
    pairs of round 3 never leave their task: the texts of their sets are brought there, and only
    links that join parts come back, fewer than there are sets.

    NULL and wordless texts are one class. NULL and repeated ids and repeated rows are rows like
    any other; an empty table gives none; columns not kept are ignored.
    """
    named = docs.select(*keep, F.col("text").cast("binary"))
    kept = [f"k{i}" for i in range(len(keep))]
    fields = [f"`{k}` {docs.schema[c].dataType.simpleString()}" for k, c in zip(
        kept, keep, strict=True)]
    named = named.toDF(*kept, "body").select(*kept, "body", F.xxhash64("body").alias("mark"),
                                             F.xxhash64("body", F.lit(1)).alias("mark2"))
    sets = materialize(
        named.select(*kept, "mark", "mark2", "body").mapInArrow(
            lean(_sketches(words, bands, width, seed, [*kept, "mark", "mark2"])),
            ", ".join([*fields, "mark long", "mark2 long", _SKETCH_TYPES])),
        "copies-sets",
    )
    classes = materialize(
        sets.groupBy("set").agg(
            F.first("size").alias("size"), F.first("print").alias("print"),
            F.first("minima").alias("minima"), F.first("bands").alias("bands"),
            F.min(F.struct("mark", "mark2")).alias("mark"),
        ),
        "copies-classes",
    )
    marks = classes.select("set", "mark.*")
    bands_of = classes.select("set", "size", F.posexplode("bands").alias("no", "band"))
    shared = bands_of.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    bands_of = materialize(bands_of.join(shared, "band", "left_semi"), "copies-bands")

    def parts(links):
        roots = connected_components(links, "copies-parts")
        return roots.select(F.col("node").alias("set"), "component")

    def blocks(links, most):
        placed = bands_of.join(parts(links), "set", "left").select(
            "no", "band", "set", "size", F.coalesce("component", "set").alias("part")
        )
        return _dealt(_blocks(placed, classes, most))

    def by_blocks(of):
        return lean(_by_blocks(of, width, similarity, agree))

    def texts_of(sets, name):
        """set and body: one text of each of the given sets. Bitmaps of their marks tell most
        other texts, which are not shuffled."""
        needed = materialize(sets.distinct().join(marks, "set"), "copies-needed")
        _, texts = split_by_keys(named.select("mark", "mark2", "body"), needed, "mark")
        texts = texts.join(needed, ["mark", "mark2"])
        return materialize(texts.select("set", "body").dropDuplicates(["set"]), name)

    def checked(pairs):
        """Those written pairs that are similar enough, by one text of each set in them."""
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("set")), "copies-texts")
        return materialize(_verified(pairs, texts, words, similarity, seed), "copies-links")

    def joined(ends):
        """Links between parts among the likely pairs of the given rows of blocks."""
        texts = texts_of(ends.select("set"), "copies-rest-texts")
        whole = ends.hint("merge").join(texts.hint("merge"), "set")  # texts are never broadcast
        found = _dealt(whole).mapInArrow(by_blocks(_similar(words, seed)), "a long, b long")
        return materialize(found, "copies-rest-links")

    tree = connected_components(
        simhash.links(classes.select("print").distinct(), budget), "copies-prints"
    ).select(F.col("node").alias("print"), "component")
    grouped = classes.select("set", "print").join(tree, "print", "left").select(
        "set", F.coalesce("component", "print").alias("component")
    )
    first = grouped.groupBy("component").agg(F.min("set").alias("a"))
    stars = grouped.join(first, "component").where("a <> set").select(
        "a", F.col("set").alias("b"))
    stars = materialize(stars, "copies-stars")
    links = checked(stars)
    likely = blocks(links, block).mapInArrow(by_blocks(_partners), "a long, b long").distinct()
    likely = materialize(likely.join(stars, ["a", "b"], "left_anti"), "copies-likely")
    links = links.unionByName(checked(likely))
    # Smaller blocks, since whole texts go with their rows.
    rest = blocks(links, max(1, block // 2)).mapInArrow(by_blocks(_ends), _ROWS)
    links = links.unionByName(joined(materialize(rest, "copies-rest")))
    found = sets.join(parts(links), "set", "left").select(
        *kept, F.coalesce("component", "set").alias("component")
    )
    return found.toDF(*keep, "component")


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8,
                    seed: int = 42) -> DataFrame:
    """One row of each group of near copies, in the columns of ``docs``: as
    ``simhash.representatives``, that with the smallest doc_id."""
    return simhash.one_of_each(
        docs, lambda keyed, keys: near_copies(keyed, words, similarity, seed=seed, keep=keys)
    )
