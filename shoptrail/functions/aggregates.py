"""Aggregate functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_concat_distinct(text: Column, separator: str = ",") -> Column:
    """Distinct non-NULL values of a group in text order, joined; NULL for none.

    Each task merges its own distinct values before the shuffle.
    """
    values = F.array_sort(F.collect_set(text))
    return F.nullif(F.array_join(values, separator), F.lit(""))
