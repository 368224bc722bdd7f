"""Toxicity scores: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.text import lean, slices
from shoptrail.session import materialize

# A plain list of insults; more are learned from the labels.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers trash garbage scum vermin "
    "filth filthy pathetic worthless disgusting clown clowns jerk imbecile ugly liar hate hateful "
    "dumm idiotin abschaum dreck versager widerlich crétin imbécile débile ordure minable "
    "estúpido estúpida idiota imbécil basura asqueroso patético inútil".split()
)

SECOND_PERSON = frozenset(
    "you your yours yourself u ur youre du dich dir dein deine ihr euch tu toi te ton ta vous "
    "votre vos tú ti usted ustedes tus vosotros".split()
)

# Signs that stand for letters in disguised words.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
                           "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None,
                           ".": None})

_EDGES = re.compile(r"^\W+|\W+$")
_OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*_!]+[^\W\d_]")
_RUN = re.compile(r"([^\w\s])\1\1")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

# What is known of a word, as bits of one byte.
_INSULT, _LEARNED, _STEM, _YOU, _SHOUT, _HIDDEN, _DECODED, _SYMBOLS = (1 << i for i in range(8))
_HIT = _INSULT | _LEARNED | _STEM | _DECODED

FEATURES = (
    "insult_density", "learned_density", "stem_density", "insult_count", "learned_count",
    "stem_count", "hits_in_a_window", "second_person_density", "hits_near_second_person",
    "capital_share", "shouted_share", "exclamation_rate", "question_rate", "punctuation_rate",
    "symbol_run_share", "obfuscated_share", "decoded_density", "log_words", "mean_word_length",
)

_STEMS = (4, 5, 6)
_WINDOW = 50
_NEAR = 3


@dataclass(frozen=True)
class Lexicon:
    """Words and word beginnings that the labels mark as toxic."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()


class _Kinds(dict):
    """Word -> its bits as one byte."""

    def __init__(self, lexicon: Lexicon, most: int = 200_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        word = raw.decode("utf-8", "replace")
        bare = _EDGES.sub("", word)
        low = bare.lower()
        kind = _INSULT * (low in INSULTS) | _LEARNED * (low in self.lexicon.words)
        kind |= _STEM * any(low[:n] in self.lexicon.stems for n in _STEMS if len(low) >= n)
        kind |= _YOU * (low in SECOND_PERSON)
        kind |= _SHOUT * (len(bare) > 1 and bare.isupper())
        kind |= _SYMBOLS * bool(_RUN.search(word))
        if _OBFUSCATED.search(word):
            kind |= _HIDDEN
            plain = _EDGES.sub("", word.lower().translate(_DISGUISE))
            kind |= _DECODED * (plain in INSULTS or plain in self.lexicon.words)
        out = self[raw] = bytes((kind,))
        return out


def text_features(text: bytes, kinds: dict) -> list[float]:
    """The values of FEATURES for one whole text."""
    words = text.split()
    n = max(1, len(words))
    size = max(1, len(text))
    bits = np.frombuffer(b"".join(map(kinds.__getitem__, words)), np.uint8)

    def count(kind: int) -> int:
        return int(np.count_nonzero(bits & kind))

    hits = np.flatnonzero(bits & _HIT)
    you = np.flatnonzero(bits & _YOU)
    burst = near = 0
    if len(hits):
        burst = int((np.searchsorted(hits, hits + _WINDOW) - np.arange(len(hits))).max())
        if len(you):
            low, high = (np.searchsorted(you, hits + d) for d in (-_NEAR, _NEAR + 1))
            near = int(np.count_nonzero(high > low))
    insult, learned, stem = count(_INSULT), count(_LEARNED), count(_STEM)
    letters = size - len(words)
    return [
        insult / n, learned / n, stem / n, np.log1p(insult), np.log1p(learned), np.log1p(stem),
        float(burst), len(you) / n, near / n,
        (size - len(text.translate(None, _CAPITALS))) / size if text else 0.0,
        count(_SHOUT) / n, text.count(b"!") / n, text.count(b"?") / n,
        (len(text) - len(text.translate(None, _PUNCTUATION))) / size,
        count(_SYMBOLS) / n, count(_HIDDEN) / n, count(_DECODED) / n,
        float(np.log1p(len(words))), letters / n,
    ]


def _featured(lexicon: Lexicon, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds(lexicon)
        for batch in slices(batches, text):
            bodies = batch.column(text).cast(pa.binary()).to_pylist()
            rows = [text_features(x or b"", kinds) for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))],
                names=[*keep, "features"],
            )

    return run


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text"
                  ) -> DataFrame:
    """The columns ``keep`` and ``features`` of the column ``text`` (string or binary)."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, features array<double>"
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(
        lean(_featured(lexicon, keep, text)), schema
    )


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return crc % 5 == 0


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each word and word beginning stands."""
    for batch in slices(batches, "body", 32 << 20):
        counts = (Counter(), Counter())
        labels = batch.column("toxic").to_pylist()
        for toxic, body in zip(labels, batch.column("body").to_pylist(), strict=True):
            words = {
                _EDGES.sub("", w) for w in {*(body or b"").decode("utf-8", "replace").lower().split()}
            }
            stems = {(n, w[:n]) for w in words for n in _STEMS if len(w) > n}
            counts[toxic].update({(0, w) for w in words if w} | stems)
        keys = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([counts[1][k] for k in keys], pa.int64()),
                pa.array([counts[0][k] for k in keys], pa.int64()),
            ],
            names=["length", "token", "toxic", "other"],
        )


def learn_lexicon(sample: DataFrame, most: int = 400, support: int = 3) -> Lexicon:
    """The ``most`` words and beginnings that best tell toxic texts of ``sample`` from others.

    ``sample`` has columns body and toxic (0 or 1). Only these few hundred come to the driver.
    """
    totals = sample.groupBy("toxic").count().collect()
    total = {row["toxic"]: row["count"] for row in totals}
    if not total.get(1) or not total.get(0):
        return Lexicon()
    rate = (F.col("toxic") + 0.5) / (total[1] + 1) / ((F.col("other") + 0.5) / (total[0] + 1))
    counted = (
        sample.select("body", "toxic")
        .mapInArrow(lean(_tokens), "length int, token string, toxic long, other long")
        .groupBy("length", "token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") >= support) & (rate >= 8))
    )
    rows = counted.orderBy((F.log(rate) * F.col("toxic")).desc(), "length", "token").limit(most)
    found = [(row["length"], row["token"]) for row in rows.collect()]
    return Lexicon(
        frozenset(t for n, t in found if n == 0), frozenset(t for n, t in found if n)
    )


@dataclass(frozen=True)
class ToxicityModel:
    """Scores features; a constant where the labels know one class only."""

    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    constant: float = 0.0

    def annotate(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column ``score``; other columns stay, texts included, except those with
        names that Spark ML adds on the way: features, raw, vector, rawPrediction, probability,
        prediction, and an older score."""
        clash = ("features", "raw", "vector", "rawPrediction", "probability", "prediction", "score")
        keep = [c for c in docs.columns if c not in clash]
        return self._score(with_features(docs, self.lexicon, keep))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) for every row of ``docs``."""
        return self._score(with_features(docs, self.lexicon, ["doc_id"])).select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )

    def _score(self, featured: DataFrame) -> DataFrame:
        if self.trees is None:
            return featured.withColumn("score", F.lit(self.constant))
        raw = _raw(self.trees, featured)
        if self.calibration is None:
            return raw.withColumnRenamed("raw", "score")
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        return self.calibration.transform(raw).withColumn("score", score)


def _raw(trees, featured: DataFrame) -> DataFrame:
    vectors = featured.withColumn("vector", array_to_vector("features"))
    scored = trees.transform(vectors)
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop(
        "vector", "rawPrediction", "probability", "prediction"
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 24_000, trees: int = 20,
          depth: int = 4, seed: int = 42) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled documents at most, none of them held out.

    The sample is drawn by a hash of the id, so it is the same in every run, and its bound is what
    allows the broadcast of its ids. A half of it gives the lexicon, a third the trees, a sixth the
    calibration: no part is judged by what it taught. Labels other than 0 and 1 and NULL ids are
    ignored; a document labelled twice is toxic if any label says so.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    count = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    share = min(1.0, sample_rows / max(1, count))
    drawn = known.where(draw < int(1_000_000 * share))
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(6)).cast("int")
    sample = docs.join(F.broadcast(drawn), "doc_id").select(
        "doc_id", "toxic", part.alias("part"), F.col("text").cast("binary").alias("body")
    )
    sample = materialize(sample, "toxicity-sample")
    lexicon = learn_lexicon(sample.where("part < 3").dropDuplicates(["body"]))
    rest = materialize(
        with_features(
            sample.where("part >= 3"), lexicon, ["doc_id", "toxic", "part"], "body"
        ).coalesce(4),
        "toxicity-features",
    )
    classes = {
        (row["last"], row["toxic"])
        for row in rest.selectExpr("part = 5 AS last", "toxic").distinct().collect()
    }
    if not {(False, 0), (False, 1)} <= classes:
        return ToxicityModel(lexicon, None, None, float(any(t for _, t in classes)))
    booster = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2,
        seed=seed, cacheNodeIds=False,
    )
    model = booster.fit(
        rest.where("part < 5").withColumn("vector", array_to_vector("features"))
        .select("toxic", "vector")
    )
    calibration = None
    if {(True, 0), (True, 1)} <= classes:
        fit = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score")
        calibration = fit.fit(
            _raw(model, rest.where("part = 5")).select(F.col("toxic").cast("double"), "raw")
        )
    return ToxicityModel(lexicon, model, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Score every whole text of ``docs`` for toxicity, learning from ``labels`` (doc_id, toxic).

    Returns (doc_id, held_out, score, predicted), one row per row of ``docs``. A NULL or empty
    text is scored by its (zero) features like any other; a NULL id counts as text '' for the
    fold; repeated rows get equal scores; without labels of both classes all get one score; an
    empty table gives no rows; other columns are ignored.
    """
    return train(docs, labels, **options).score(docs)
