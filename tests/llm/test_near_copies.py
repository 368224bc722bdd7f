"""Near copies against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoptrail.llm import near_copies
from shoptrail.session import materialize
from tests.llm.helpers import SF_DIR, ascii_lower, components, documents, load, words


def plain_set(text):
    found = words(ascii_lower(text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_kept(rows, similarity=0.8):
    """The smallest id of each group, from all pairs."""
    sets = {d: plain_set(t) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            shared = len(x & y)
            if x == y or shared and shared >= similarity * (len(x) + len(y) - shared):
                links.append((a, b))
    return set(components(ids, links).values())


def planted():
    """Texts with 0 to 12 words changed, chains of small changes, and texts of few words."""
    rng = random.Random(5)
    texts = [None, "", " \t", "One two", "one TWO", "a b c d e", "a b c d e f"]
    for n in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(5):
            if n % 2:
                copy = list(base)
            else:
                copy = base  # a chain: the next copy is made from this one
            for _ in range(rng.randrange(1 + len(base) // 33)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[at]) for i, at in enumerate(order)]


def test_stage_drops_planted_near_copies(spark):
    rows = planted()
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    kept = {r.doc_id for r in stage(spark, documents(spark, rows), SF_DIR).collect()}
    want = plain_kept(rows)
    assert 20 < len(want) < 0.7 * len(rows)
    assert kept == want


def test_stage_equals_all_pairs_of_the_given_table(spark):
    docs = load(spark)
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    kept = {r.doc_id for r in stage(spark, docs, SF_DIR).collect()}
    assert kept == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs_the_first_of_a_band_does_not_link(spark):
    # Two pairs of near copies share a band's first set only by half of their words.
    base = [f"b{i}" for i in range(100)]
    rows = []
    for side in range(4):
        text = base[:70] + [f"s{side}-{i}" for i in range(30)]
        rows += [(2 * side, " ".join(text)), (2 * side + 1, " ".join(text + ["end"]))]
    found = near_copies.near_copies(documents(spark, rows), bands=200, width=1)
    parts = {r.doc_id: r.component for r in found.collect()}
    assert len(set(parts.values())) == 4
    assert all(parts[2 * side] == parts[2 * side + 1] for side in range(4))


def test_null_ids_lose_no_link(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b = a + " end"
    for rows, kept in (
        ([(None, a), (1, b), (2, a)], {1}),
        ([(None, a), (None, b), (None, a)], {None}),
        ([(None, a), (3, b)], {3}),
        ([(5, a), (5, b), (4, "other words here")], {4, 5}),
    ):
        got = near_copies.representatives(documents(spark, rows)).collect()
        assert {r.doc_id for r in got} == kept and len(got) == len(kept)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(150_000))
    texts = [(1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (5, "One  TWO"),
             (6, long), (7, long + " end"), (None, "one two")]
    clash = dict.fromkeys(["_key", "_KEY2", "component", "set", "part", "body"], F.lit("x"))
    docs = documents(spark, texts, **clash)
    kept = near_copies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert {r._key for r in kept.collect()} == {"x"}
    assert near_copies.representatives(docs.where("false")).count() == 0


@pytest.mark.parametrize("best", [True, False])
def test_likely_pairs_against_loops(best):
    draw = np.random.default_rng(1)
    minima = draw.integers(0, 3, (30, 20)).astype(np.uint32)
    sizes, parts = draw.integers(10, 14, 30), draw.integers(0, 5, 30)
    for own in (True, False):
        right = slice(None) if own else slice(10, 30)
        got = near_copies.likely_pairs(
            minima, minima[right], (sizes, sizes[right]), (parts, parts[right]), own, 0.8, 0.4,
            best)
        want = {}
        for i in range(30):
            for j in range(len(minima[right])):
                equal = int((minima[i] == minima[right][j]).sum())
                small, large = sorted((sizes[i], sizes[right][j]))
                if (equal >= 8 and parts[i] != parts[right][j] and small >= 0.8 * large
                        and (j < i or not own)):
                    want.setdefault(i, []).append((-equal, j))
        pairs = {(i, min(x)[1]) for i, x in want.items()} if best else {
            (i, j) for i, x in want.items() for _, j in x}
        assert set(zip(*(x.tolist() for x in got))) == pairs and len(got[0]) == len(pairs)


def test_bands_cut_into_blocks_lose_no_pair(spark):
    rows = planted()
    parts = []
    for block in (512, 3):
        found = near_copies.near_copies(documents(spark, rows), block=block)
        groups = {}
        for r in found.collect():
            groups.setdefault(r.component, set()).add(r.doc_id)
        parts.append(sorted(map(sorted, groups.values())))
    assert parts[0] == parts[1]


def test_fingerprint_of_a_set():
    hashes = near_copies.shingle_set(b" ".join(b"w%d" % i for i in range(5000)))
    want = sum(
        (2 * sum(int(h) >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))
    assert int(near_copies.fingerprint_of(hashes)) == want
    assert int(near_copies.fingerprint_of(hashes[:0])) == 0


def test_recall_by_share_of_changed_words(spark):
    """Copies at 0.8 or more are found whatever the length of the text; others are left."""
    rng = random.Random(11)
    texts, near, far = [], [], []
    for n in (20, 60, 200, 1000, 5000):
        for share in (0.01, 0.02, 0.04, 0.1, 0.2):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            copy = list(base)
            for at in rng.sample(range(n), max(1, int(n * share))):
                copy[at] = f"x{rng.randrange(10**6)}"
            pair = len(texts), len(texts) + 1
            texts += [" ".join(base), " ".join(copy)]
            a, b = plain_set(texts[-2]), plain_set(texts[-1])
            (near if len(a & b) >= 0.8 * len(a | b) else far).append(pair)
    kept = {r.doc_id for r in near_copies.representatives(documents(spark, texts)).collect()}
    assert len(near) >= 6 and len(far) >= 10
    assert all(a in kept and b not in kept for a, b in near)
    assert all(a in kept and b in kept for a, b in far)


def test_pairs_of_a_family_stay_in_their_tasks(spark, monkeypatch):
    """Copies that are each changed elsewhere: tables grow with the family, not with its square."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(10, 290, 10), 6):
            copy[at] = f"x{i}-{at}"
        rows.append((i + 1, " ".join(copy)))
    written = []

    def counted(df, name, folder=None):
        out = materialize(df, name, folder)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    for more in ([], [(0, " ".join(base))]):
        written.clear()
        docs = rows + more
        got = {r.doc_id for r in near_copies.representatives(documents(spark, docs)).collect()}
        assert got == plain_kept(docs) and (got == {0} if more else len(got) > 110)
        assert max(written)[0] <= 20 * len(docs), max(written)
