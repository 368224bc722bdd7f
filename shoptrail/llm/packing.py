"""Best-fit packing of token pieces into sequences, certified by lower bounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.text import lean, slices
from shoptrail.session import materialize


# Words of Latin letters whose lower case is one letter each, and the signs that may follow.
_LETTERS = re.compile(r"([a-zÀ-ÖØ-öø-ÿŒœ]+)([!-&(-/:-@\[-`{-~]*)")


class _Encoder:
    """Ids of words as packed 32-bit numbers, by a tokenizer of the tokenizers library.

    The tokenizer lower-cases, drops white space, and joins no text across it, nor letters with
    signs. So texts are cut at white space, and each distinct word is encoded once and remembered.
    When ``most`` are, those go that half as many others were met without them; frequent words
    stay. New words of letters are encoded many at a time as one text, whose ids are cut where a
    word ends, which the vocabulary shows; they need none of the tokenizer's patterns, so its model
    encodes them behind a split at blanks. Signs that follow them are encoded apart.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Words met lately, and those met before them.
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _letters(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each of ``texts``, all of letters only."""
        for start in range(0, len(texts), 200):
            text = " ".join(texts[start : start + 200]).lower()
            found = self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(found, "<u4")
            data, at = ids.tobytes(), 0
            for cut in (4 * np.flatnonzero(self.ends[ids]) + 4).tolist():
                yield data[at:cut]
                at = cut

    def _others(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each of ``texts``."""
        for start in range(0, len(texts), 5_000):
            for found in self.tokenizer.encode_batch_fast(
                texts[start : start + 5_000], add_special_tokens=False
            ):
                yield np.array(found.ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        letters, heads, tails, rest, texts = [], [], [], [], []
        for word in new:
            text = word.decode("utf-8", "replace")
            found = _LETTERS.fullmatch(text)
            if found:
                letters.append(word)
                heads.append(found[1])
                tails.append(found[2])
            else:
                rest.append(word)
                texts.append(text)
        signs = list(set(tails) - {""})
        signs = dict(zip(signs, self._others(signs), strict=True)) | {"": b""}
        for word, ids, tail in zip(letters, self._letters(heads), tails, strict=True):
            self.words[word] = ids + signs[tail]
        self.words.update(zip(rest, self._others(texts), strict=True))

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        missing = [word for word in words if word not in self.words]
        if len(self.words) + len(missing) > self.most // 2:
            self.before, self.words, missing = self.words, {}, words
        new = []
        for word in missing:
            ids = self.before.get(word)
            if ids is None:
                new.append(word)
            else:
                self.words[word] = ids
        self._learn(new)
        return [self.words[word] for word in words]

    def ids(self, bodies: pa.Array) -> list[bytes]:
        """The ids of every text (binary; NULL has none)."""
        texts = bodies.fill_null(b"").view(pa.string())
        # What may name a special token keeps its case.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._known(words.dictionary.view(pa.binary()).to_pylist())
        ids = pa.array(ids, pa.large_binary()).take(words.indices)
        edges = np.frombuffer(ids.buffers()[1], np.int64, count=len(ids) + 1)
        cuts = edges[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One per Python worker; what it has learnt serves the worker's later tasks."""
    return _Encoder(path)


_PIECE = "piece int, start long, length int, ids binary"


def _pieces(path: str, capacity: int, end: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        last = np.array([end], "<u4").tobytes()
        step = 4 * capacity
        for batch in slices(batches, "body", 4 << 20):
            row, piece, ids = [], [], []
            for i, found in enumerate(encoder.ids(batch.column("body"))):
                found += last
                for k in range(0, len(found), step):
                    row.append(i), piece.append(k // step), ids.append(found[k : k + step])
            piece = np.array(piece, np.int32)
            length = np.array([len(x) // 4 for x in ids], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(row, pa.int64())) for c in keep),
                    pa.array(piece),
                    pa.array(piece.astype(np.int64) * capacity),
                    pa.array(length),
                    pa.array(ids, pa.binary()),
                ],
                names=[*keep, "piece", "start", "length", "ids"],
            )

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode whole texts, end each with id ``end`` and cut it into pieces of ``capacity`` ids.

    ``tokenizer`` is a file that every executor has. Returns the columns ``keep``, piece, start
    (ids before it), length and ids (packed 32-bit little-endian numbers). A NULL or empty text is
    the one id ``end``.
    """
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    texts = docs.select(*keep, F.col("text").cast("binary").alias("body"))
    return texts.mapInArrow(
        lean(_pieces(tokenizer, capacity, end, list(keep))), ", ".join([*fields, _PIECE])
    )


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every size, and the number of bins.

    Larger sizes first, each into the fullest bin that still holds it. Open bins are kept by their
    free room, and the set of rooms in use is one integer, so a step costs the same for any number
    of bins.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = count = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, own = capacity, count
            count += 1
        bins[i], offsets[i] = own, capacity - room
        rest = room - size
        if rest:
            rooms[rest].append(own)
            used |= 1 << rest
    return bins, offsets, count


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins.

    The largest bound of two families of dual feasible functions, each of which maps sizes so that
    what fits a bin maps to at most 1: one counts sizes above capacity - e as whole bins and drops
    those below e, the other rounds (k + 1) * size / capacity down to k-ths where it is no integer.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    values = np.arange(capacity + 1, dtype=np.int64)
    count, weight = np.cumsum(counts), np.cumsum(counts * values)
    total = int(weight[-1])
    best = -(-total // capacity)
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e]
    middle = weight[capacity - e] - weight[e - 1]
    best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 64):
        scaled = (k + 1) * values
        whole = scaled % capacity == 0
        mapped = np.where(whole, k * values, scaled // capacity * capacity)  # in 1/(k*capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def _packed(size: str, capacity: int, round_no: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Pack one group; bins that a better grouping might fill go on as ``open``."""
        group = key[0].as_py()
        sizes = rows.column(size).to_numpy().astype(np.int64)
        bins, offsets, count = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=count)
        if last or count == lower_bound(sizes, capacity):
            # Certified: these documents need no fewer bins. Only a bin with room to spare for
            # other groups' documents is exchanged.
            spare = np.zeros(count, bool)
            if not last:
                spare[np.argmin(fill)] = fill.min() < capacity
        else:
            # A gap: the emptiest half of the bins that waste room is packed anew.
            spare = fill < capacity
            spare &= fill <= np.quantile(fill[spare], 0.5) if spare.any() else spare
        sequence = (np.int64(round_no) << 56) | (np.int64(group) << 32) | bins
        out = rows.drop_columns([c for c in ("sequence_id", "offset", "open") if c in
                                 rows.column_names])
        out = out.append_column("sequence_id", pa.array(sequence))
        out = out.append_column("offset", pa.array(offsets))
        return out.append_column("open", pa.array(spare[bins]))

    return run


def pack(pieces: DataFrame, capacity: int = 2048, size: str = "length", group_rows: int = 50_000,
         rounds: int = 4) -> DataFrame:
    """Put ``pieces`` into as few sequences of ``capacity`` as it can.

    Returns the columns of ``pieces`` and sequence_id (long) and offset (long; gapless from 0 in
    each sequence). Every size must lie in 1..capacity. Use narrow rows: they are shuffled.

    Groups of about ``group_rows`` rows, dealt by a random number fixed by the stored rows, are
    packed best-fit decreasing and compared with a lower bound. A group that meets it is done but
    for its emptiest sequence; one with a gap gives up the emptier half of its unfilled sequences.
    What is given up is exchanged between the groups and packed again, until one group is left or
    after ``rounds`` rounds. Equal rows are interchangeable; no rows give no rows.
    """
    columns = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    schema = f"{fields}, sequence_id long, offset long, open boolean"
    rest, done = pieces, None
    for round_no in range(rounds):
        count = rest.count()
        groups = max(1, -(-count // group_rows))
        last = round_no == rounds - 1 or groups == 1
        group = F.pmod(F.xxhash64(*columns, F.lit(round_no)), F.lit(groups)).cast("int")
        packed = rest.groupBy(group.alias("_group")).applyInArrow(
            _packed(size, capacity, round_no, last), schema
        )
        if last:
            closed = packed.drop("open")
            return closed if done is None else done.unionByName(closed)
        packed = materialize(packed, "packed")
        closed = packed.where("NOT open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        rest = packed.where("open").select(*columns)
    return done


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0
                   ) -> DataFrame:
    """Encode and pack ``docs``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``token_pieces`` are stored with their ids first, so that texts are encoded once; the packing
    moves their lengths and checksums only. A NULL id is kept as it is; repeated rows give pieces
    of their own; columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end), "token-pieces")
    narrow = pieces.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return pack(narrow, capacity)
