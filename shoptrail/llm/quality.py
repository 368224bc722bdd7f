"""Quality rules: a ledger of measurements and failure bits, read by versioned policies."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrail.llm.text import WordHashes, lean, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
# Without these bytes every code point of a word is one byte.
_NOT_FIRST = _SPACE + bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """A row fails if the SQL condition over MEASURES holds; ``bit`` is its place in the mask."""

    bit: int
    name: str
    fails: str


# A rule keeps its bit for ever: stored ledgers are read by later policies.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that a row has to pass."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {rule.name: rule.bit for rule in rules}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("web", 1, ("few_words", "repeated_words", "symbols")),
    Policy("web", 2, ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words",
                      "short_words")),
)
LATEST = POLICIES[-1]


def repeated_words(words: list[bytes], hashes: WordHashes, width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    values = np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64)
    with np.errstate(over="ignore"):
        mixed = values[:count].copy()
        for step in range(1, width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + values[step : step + count]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Equal windows have equal hashes; the words tell whether the reverse holds.
    maybe = order[np.append(same, False) | np.append(False, same)]
    places = defaultdict(list)
    for start in maybe.tolist():
        places[tuple(words[start : start + width])].append(start)
    steps = np.zeros(len(words) + 1, np.int64)
    for starts in places.values():
        if len(starts) > 1:
            steps[starts] += 1
            steps[np.array(starts) + width] -= 1
    return int((np.cumsum(steps) > 0).sum())


def measure_text(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    """MEASURES of one whole text."""
    words = text.split()  # of bytes: ASCII white space
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_FIRST)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
    )


def _measure(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last = len(names)
        for batch in slices(batches, last):
            found = [measure_text(x or b"", hashes) for x in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(last)),
                    *(pa.array(c, pa.int64()) for c in zip(*found, strict=True)),
                ],
                names=[*names, *MEASURES],
            )

    return run


def ledger(docs: DataFrame, keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES
           ) -> DataFrame:
    """Measure every whole text once and evaluate every rule once.

    Returns the columns ``keep``, MEASURES (longs) and ``failed`` (long: bit b is set if the rule of
    bit b fails), one row per row of ``docs``. Words stand between ASCII white space; n_lines are
    the lines with a word, n_dup_lines those equal to an earlier line, n_repeat_words the words in
    5-word windows that the text holds twice or more. NULL, empty and wordless texts measure 0
    everywhere; repeated rows give equal rows; an empty table gives none; columns not kept are
    ignored, and a kept one may not have the name of a measurement.

    One scan without a shuffle; policies are applied to the stored ledger, so a new version reads
    no text.
    """
    clash = set(keep) & {*MEASURES, "failed"}
    if clash:
        raise ValueError(f"columns to keep have names of measurements: {sorted(clash)}")
    bits = [rule.bit for rule in rules]
    if len(set(bits)) < len(bits) or not all(0 <= bit < 63 for bit in bits):
        raise ValueError("rules need bits of their own from 0 to 62")
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    body = docs.select(*keep, F.col("text").cast("binary").alias("_body"))
    measured = body.mapInArrow(
        lean(_measure(list(keep))), ", ".join([*fields, *(f"{m} long" for m in MEASURES)])
    )
    failed = F.lit(0).cast("long")
    for rule in rules:
        failed = failed.bitwiseOR(
            F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
        )
    return measured.withColumn("failed", failed)


def passes(policy: Policy, rules: Sequence[Rule] = RULES):
    """The condition on a ledger's ``failed`` that no rule of the policy fails."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def _masks(entries: DataFrame) -> DataFrame:
    """How many rows have each mask: at most one row per combination of rules."""
    return entries.groupBy("failed").agg(
        F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words")
    )


def ablation(entries: DataFrame, policies: Sequence[Policy] = POLICIES,
             rules: Sequence[Rule] = RULES) -> DataFrame:
    """What every rule of every policy does, from a ledger.

    Returns policy, version, rule, n_docs (all rows), n_kept, n_failed (rows that fail the rule),
    n_only (rows that fail this rule of the policy alone, which would be kept without it) and
    words_only (their words). The ledger is reduced to counts per mask first; all sums are over
    these few rows with bitwise tests. An empty ledger gives zeros.
    """
    bits = {rule.name: rule.bit for rule in rules}
    wanted = entries.sparkSession.createDataFrame(
        [(p.name, p.version, name, p.mask(rules), 1 << bits[name])
         for p in policies for name in p.rules],
        "policy string, version int, rule string, policy_mask long, bit long",
    )
    masks = _masks(entries).agg(
        F.collect_list(F.struct("failed", "n_docs", "n_words")).alias("masks")
    )
    # Bounded: one row of masks (at most 2 ** rules) beside each rule of each policy.
    rows = wanted.join(F.broadcast(masks), how="left").select(
        "policy", "version", "rule", "policy_mask", "bit", F.explode_outer("masks").alias("m")
    )
    hit = F.col("m.failed").bitwiseAND(F.col("policy_mask"))

    def total(condition, what="n_docs"):
        counted = F.when(condition, F.col(f"m.{what}")).otherwise(F.lit(0))
        return F.coalesce(F.sum(counted), F.lit(0)).cast("long")

    return rows.groupBy("policy", "version", "rule").agg(
        total(F.lit(True)).alias("n_docs"),
        total(hit == 0).alias("n_kept"),
        total(F.col("m.failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
        total(hit == F.col("bit"), "n_words").alias("words_only"),
    )
