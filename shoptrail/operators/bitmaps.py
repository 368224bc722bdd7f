"""Sets of a session as bitmaps over the codes of a dictionary."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = 64


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(value, code) of the distinct values as text, codes from 0 in text order.

    For dictionaries like categories and keywords: distinct values are numbered in ranges of text
    order, so no task holds them all; each range's first code is the number of values before it.
    """
    distinct = values.select(F.col(column).cast("string").alias("value")).where(
        "value IS NOT NULL"
    ).distinct()
    # Values with one two-letter beginning are a range; ranges are few.
    ranged = distinct.withColumn("range", F.substring("value", 1, 2))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    first = sizes.select("range", F.coalesce(before, F.lit(0)).cast("long").alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    return ranged.withColumn("place", place).join(first, "range").select(
        "value", (F.col("first") + F.col("place")).alias("code")
    )


def set_bitmaps(rows: DataFrame, key: str, column: str, codes: DataFrame, name: str) -> DataFrame:
    """(key, name): the set of a key's values as a map from word number to 64 bits of codes.

    Every value is one bit, combined map-side with ``bit_or``: a set has at most one word per 64
    values of the dictionary, however many rows its key has. Keys without a value have an empty
    map.
    """
    coded = rows.select(key, F.col(column).cast("string").alias("value")).join(
        codes, "value", "left"
    )
    word = F.shiftright("code", 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("code", F.lit(_WORD)).cast(
        "int"))
    words = coded.groupBy(key, word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    entry = F.when(F.col("word").isNotNull(), F.struct("word", "bits"))
    return words.groupBy(key).agg(
        F.map_from_entries(F.array_compact(F.collect_list(entry))).alias(name)
    )


def values_of(bitmaps: DataFrame, key: str, name: str, codes: DataFrame) -> DataFrame:
    """(key, value): one row per value of every set, NULL for an empty one."""
    words = bitmaps.select(key, F.explode_outer(name).alias("word", "bits"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)),
                       lambda i: F.getbit(F.col("bits"), i) == 1)
    coded = words.select(key, "word", F.explode_outer(numbers).alias("bit")).select(
        key, (F.col("word").cast("long") * _WORD + F.col("bit")).alias("code")
    )
    return coded.join(codes, "code", "left").select(key, "value")


def any_in_bitmap(field: Column, wanted: Sequence[int] | None) -> Column | None:
    """Any of the codes ``wanted`` is in the set; no condition without a list, false for an empty
    one (none of the values is in the dictionary)."""
    if wanted is None:
        return None
    masks: dict[int, int] = {}
    for code in wanted:
        masks[code // _WORD] = masks.get(code // _WORD, 0) | 1 << code % _WORD
    found = F.lit(False)
    for word, mask in sorted(masks.items()):
        signed = mask - (1 << 64) if mask >> 63 else mask
        bits = F.coalesce(F.element_at(field, word), F.lit(0).cast("long"))
        found = found | (bits.bitwiseAND(F.lit(signed).cast("long")) != 0)
    return found


def codes_of(codes: DataFrame, values: Sequence[str]) -> list[int]:
    """The codes of a few values, in order; unknown values have none."""
    rows = codes.where(F.col("value").isin(*values)).select("code").collect()
    return sorted(r.code for r in rows)
