"""Packing: round trips, capacity, and the lower bound."""

import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoptrail.llm import packing, queries
from tests.llm.helpers import SF_DIR, documents, load


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def plain_pieces(tokenizer, rows, capacity=2048):
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4").tobytes()
            out.append((doc_id, k // capacity, k, len(part) // 4, zlib.crc32(part)))
    return sorted(out, key=repr)


def check_places(rows, capacity=2048):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_query_keeps_all_tokens_in_few_sequences(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in load(spark).collect()]
    got = queries.op9_packing(spark, SF_DIR).collect()
    want = plain_pieces(tokenizer, docs)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got),
                  key=repr) == want
    bound = packing.lower_bound(np.array([w[3] for w in want]), 2048)
    assert check_places(got) <= bound + 1


def test_edge_texts(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "  \x1c x́ ΣΣ it's <|endoftext|>a"),
             (None, "A b" * 3), (5, "x y"), (5, "x y"), (6, "w1 " * 9000), (7, "q" * 5000),
             (8, "q!" * 40_000)]
    docs = documents(spark, texts, piece=F.lit("p"), length=F.lit(0), ids=F.lit(1))
    got = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got),
                  key=repr) == plain_pieces(tokenizer, texts)
    check_places(got)
    assert packing.pack_documents(docs.where("false"), queries.tokenizer_path()).count() == 0


def test_groups_exchange_what_they_leave_open(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2049, 4000)
    rows = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, length int")
    got = packing.pack(rows, group_rows=300).collect()
    assert sorted(r.id for r in got) == list(range(4000))
    count = check_places(got)
    assert count < check_places(packing.pack(rows, group_rows=300, rounds=1).collect())
    assert count <= packing.lower_bound(sizes, 2048) * 1.025


def test_lower_bound_never_exceeds_the_best_packing():
    def best(sizes, capacity):
        n = len(sizes)
        for bins in range(1, n + 1):
            for choice in product(range(bins), repeat=n):
                if all(sum(s for s, c in zip(sizes, choice, strict=True) if c == b) <= capacity
                       for b in range(bins)):
                    return bins
        return 0

    rng = np.random.default_rng(7)
    met = 0
    for _ in range(60):
        sizes = rng.integers(1, 13, rng.integers(1, 6))
        low, want = packing.lower_bound(sizes, 12), best(sizes.tolist(), 12)
        assert low <= want <= packing.best_fit_decreasing(sizes, 12)[2]
        met += low == want
    assert met > 50
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3  # more than the sum says


class _Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_letters_need_no_pattern_and_signs_are_encoded_once():
    encoder = packing._Encoder(queries.tokenizer_path())
    encoder.tokenizer = counted = _Counted(encoder.tokenizer)
    texts = [f"Word{'x' * i}$$$ über{'é' * i}. plain{'y' * i}" for i in range(1, 60)] + [None]
    found = encoder.ids(pa.array([t and t.encode() for t in texts], pa.binary()))
    assert sorted(filter(None, counted.texts)) == ["$$$", "."]
    want = counted.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert found == [np.array(w.ids, "<u4").tobytes() for w in want]


@pytest.mark.parametrize("most", [8, 600_000])
def test_encoder_equals_the_tokenizer(tokenizer, most):
    rng = random.Random(1)
    signs = "\x0b\x1c\x85\xa0abzAÀÉßŒ.,!?$%&'()<|>*+-/:;=@[]\\^_`{}~#\"0 9x́ \n\t"
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["It's don't''ll a<|endoftext|>b A.<|startoftext|> x$$$ Y.,' z.'s"]
    encoder = packing._Encoder(queries.tokenizer_path(), most)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = tokenizer.encode_batch_fast(part, add_special_tokens=False)
        found = encoder.ids(pa.array([t.encode() for t in part], pa.binary()))
        assert found == [np.array(w.ids, "<u4").tobytes() for w in want]
