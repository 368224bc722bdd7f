"""Rounding functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A double's fraction scaled by a power of two is a whole number, so halves compare exactly.
_FRACTION_BITS = 62


def _div(dividend: Column, divisor: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", dividend, divisor)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` of two counts, rounded half up to two decimals; NULL for no whole."""
    part, whole = part.cast("long"), whole.cast("long")
    hundredths = _div(part * 200 + whole, F.nullif(whole * 2, F.lit(0)))
    return hundredths.cast("double") / 100.0


def format_double(number: Column, scale: int) -> Column:
    """Round half up on the binary value of a double (0.145 lies below its half: 0.14).

    For scales 0 to 18; exact where the result has 15 digits at most. NULL for NaN and infinities.
    """
    size = F.abs(number.cast("double"))
    whole = F.floor(size)
    unit = F.lit(2**_FRACTION_BITS).cast("decimal(20,0)")
    half = F.lit(2 ** (_FRACTION_BITS - 1)).cast("decimal(20,0)")
    fraction = ((size - whole) * float(2**_FRACTION_BITS)).cast("long").cast("decimal(20,0)")
    # 2**62 times 10**18 has 37 digits.
    power = F.lit(10**scale).cast("decimal(19,0)")
    steps = _div((fraction * power).cast("decimal(38,0)") + half, unit)
    rounded = (whole.cast("double") * 10**scale + steps.cast("double")) / float(10**scale)
    usable = size < F.lit(float(2**53))
    return F.when(
        usable, F.when(number < 0, -rounded).otherwise(rounded)
    ).when(~F.isnan(size) & (size < F.lit(float("inf"))), number.cast("double"))
