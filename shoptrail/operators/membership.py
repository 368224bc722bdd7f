"""An approximate membership filter ahead of an anti join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of one row of the filter, and the most bits of a filter (16 MB).
_PART_BITS = 1 << 15
MOST_BITS = 1 << 27


def _spot(column: str, bits: int):
    return F.xxhash64(column).bitwiseAND(F.lit(bits - 1).cast("long"))


def filter_bits(rows: int, per_row: int = 16) -> int:
    """A power of two of bits, ``per_row`` for each of ``rows`` as long as MOST_BITS allows."""
    return min(MOST_BITS, max(_PART_BITS, 1 << (per_row * rows).bit_length()))


def bitmap_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """Bitmaps (part, bits) in which the bit of the hash of every key is set: at most
    ``bits / 32768`` rows of 4 KB, whatever the number of keys."""
    spot = _spot(column, bits)
    return keys.select(
        F.shiftright(spot, 15).alias("part"), F.pmod(spot, F.lit(_PART_BITS)).alias("bit")
    ).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_possible_hit(rows: DataFrame, column: str, bitmaps: DataFrame, bits: int, name: str
                      ) -> DataFrame:
    """Rows with a flag ``name``: false if ``column`` is certainly none of the keys.

    The bitmaps are broadcast; their size is bounded by ``bits``. NULL is no key.
    """
    if bits > MOST_BITS:
        raise ValueError(f"a filter has {MOST_BITS} bits at most")
    part, word, spot = (f"_{name}_{x}" for x in ("part", "bits", "spot"))
    placed = rows.withColumn(spot, _spot(column, bits))
    known = bitmaps.select(F.col("part").alias(part), F.col("bits").alias(word))
    joined = placed.join(
        F.broadcast(known), F.shiftright(F.col(spot), 15) == F.col(part), "left"
    )
    place = F.pmod(F.col(spot), F.lit(_PART_BITS)).cast("int")
    # One byte of the bitmap as a number.
    byte = F.conv(F.hex(F.substring(F.col(word), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10)
    hit = F.getbit(byte.cast("int"), F.pmod(place, F.lit(8))) == 1
    return joined.withColumn(
        name, F.col(column).isNotNull() & F.coalesce(hit, F.lit(False))
    ).drop(part, word, spot)


def split_by_keys(rows: DataFrame, keys: DataFrame, column: str, name: str = "possible_hit"
                  ) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``column`` is certainly none of ``keys`` (a written
    table), and possible hits, which need an exact join. No row is shuffled; the rows are read
    once per part. ``name`` is a helper column that ``rows`` must not have."""
    keys = keys.select(column).where(F.col(column).isNotNull())
    size = filter_bits(keys.count())
    flagged = with_possible_hit(rows, column, bitmap_filter(keys, column, size), size, name)
    hit = F.col(name)
    return tuple(flagged.where(x).select(*rows.columns) for x in (~hit, hit))


def filtered_anti_join(rows: DataFrame, keys: DataFrame, column: str, bits: int | None = None
                       ) -> DataFrame:
    """Rows whose ``column`` is none of ``keys``, where the keys are too many to broadcast.

    Rows that the filter clears pass as they are; only possible hits are shuffled for the exact
    anti join. With 16 bits a key about one clear row in 16 is shuffled too; none is dropped
    wrongly. Rows with NULL stay, as in any anti join; NULL and repeated keys change nothing. The
    rows are read twice, once per branch.
    """
    keys = keys.select(column).where(F.col(column).isNotNull())
    size = bits or filter_bits(keys.count())
    flagged = with_possible_hit(
        rows, column, bitmap_filter(keys, column, size), size, "possible_hit"
    )
    clear = flagged.where("NOT possible_hit")
    rest = flagged.where("possible_hit").join(keys.hint("shuffle_hash"), column, "left_anti")
    return clear.unionByName(rest).select(*rows.columns)
