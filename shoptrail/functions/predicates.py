"""Optional conditions; each is None when its parameter is missing and so passes every row.

As a filter, NULL data fails. ``flag`` turns a condition into a plain true/false column.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(field: Column, low: int | None, high: int | None) -> Column | None:
    """Inclusive range; no condition unless both bounds are given."""
    if low is None or high is None:
        return None
    return field.between(low, high)


def any_in(field: Column, wanted: Sequence[str] | None) -> Column | None:
    """Any element of a comma list equals any wanted value."""
    if wanted is None:
        return None
    return F.arrays_overlap(F.split(field, ","), F.array(*[F.lit(value) for value in wanted]))


def equal(field: Column, wanted: str | None) -> Column | None:
    return None if wanted is None else field == wanted


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are present."""
    present = [condition for condition in conditions if condition is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def flag(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
