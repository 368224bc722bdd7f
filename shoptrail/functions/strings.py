"""Text functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(text: Column) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(text, F.lit("")) == ""


def is_not_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def trim_comma(text: Column) -> Column:
    """Drop one comma at each end."""
    return F.regexp_replace(text, "^,|,$", "")


def zero_pad(text: Column) -> Column:
    """Two-character text stays, anything else gets one leading zero."""
    return F.when(F.length(text) == 2, text).otherwise(F.concat(F.lit("0"), text))


def split_ids(text: Column) -> Column:
    """Ids of a comma list; NULL for an element that is no number and for NULL text."""
    return F.transform(F.split(text, ","), lambda part: part.try_cast("long"))


def concat_long_string(number: Column, text: Column, separator: Column) -> Column:
    return F.concat(number.cast("string"), separator, text)


def random_prefix(text: Column, n: Column, seed: int | None = None) -> Column:
    """``<0..n-1>_text`` with a random prefix."""
    draw = F.rand() if seed is None else F.rand(seed)
    return F.concat(F.floor(draw * n).cast("string"), F.lit("_"), text)


def remove_random_prefix(text: Column) -> Column:
    """Undo ``random_prefix``; later underscores stay."""
    return F.regexp_replace(text, "^[^_]*_", "")
