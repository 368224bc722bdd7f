"""JSON text functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_json_field(json_text: Column, field: str) -> Column:
    """Top-level field of a JSON object as text."""
    return F.get_json_object(json_text, f"$.{field}")


def get_param(json_text: Column, field: str) -> Column:
    """First element of an array field of a task parameter, NULL if there is none or it is ''."""
    values = F.from_json(json_text, "map<string,array<string>>").getItem(field)
    return F.nullif(F.get(values, F.lit(0)), F.lit(""))


def parse_param(json_text: Column) -> Column:
    """A task parameter parsed once into a VARIANT; NULL if it is not JSON."""
    return F.try_parse_json(json_text)


def get_variant_param(parsed: Column, field: str) -> Column:
    """First element of an array field of a parsed task parameter as text, NULL if there is none
    or it is ''."""
    return F.nullif(F.try_variant_get(parsed, f"$.{field}[0]", "string"), F.lit(""))
