"""The functions under SQL names, as SQL expressions that the optimizer inlines."""

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "concat_long_string": (
        "id BIGINT, text STRING, separator STRING",
        "concat(CAST(id AS STRING), separator, text)",
    ),
    "get_json_field": ("json STRING, field STRING", "get_json_object(json, concat('$.', field))"),
    "random_prefix": (
        "text STRING, n INT",
        "concat(CAST(floor(rand() * n) AS STRING), '_', text)",
    ),
    "remove_random_prefix": ("text STRING", "regexp_replace(text, '^[^_]*_', '')"),
    # An SQL function cannot aggregate: wrap it around collect_set(x) in the query.
    "group_concat_distinct": (
        "collected ARRAY<STRING>",
        "nullif(array_join(array_sort(array_distinct(collected)), ','), '')",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Make the functions callable from ``spark.sql`` in this session."""
    for name, (arguments, body) in _FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body}"
        )
