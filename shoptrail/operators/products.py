"""Most clicked products per area."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrail import constants as C
from shoptrail import schemas
from shoptrail.functions.aggregates import group_concat_distinct
from shoptrail.functions.json import get_json_field
from shoptrail.functions.strings import concat_long_string


def area_level(area: Column) -> Column:
    level = F.lit(C.OTHER_AREA_LEVEL)
    for label, areas in reversed(C.AREA_LEVELS):
        level = F.when(area.isin(*areas), label).otherwise(level)
    return level


def product_status(extend_info: Column) -> Column:
    """Own or third-party product; a missing flag counts as third party."""
    own = get_json_field(extend_info, "product_status") == C.OWN_PRODUCT_FLAG
    return F.when(own, C.OWN_PRODUCT).otherwise(C.THIRD_PARTY_PRODUCT)


def click_product_basic(clicks: DataFrame, city_info: DataFrame) -> DataFrame:
    """Product clicks with the city and area they came from."""
    cities = city_info.select(F.col("city_id").cast("long"), "city_name", "area")
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "product_id")


def _city_product_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("city_id", "product_id").agg(F.count("*").alias("clicks"))


def area_product_click_count(clicks: DataFrame, city_info: DataFrame) -> DataFrame:
    """Clicks and cities per area and product.

    Clicks are counted per city before the join, so the join and all later steps see one row
    per city and product, however busy a city is.
    """
    cities = city_info.select(F.col("city_id").cast("long"), "city_name", "area")
    city = concat_long_string(F.col("city_id"), F.col("city_name"), F.lit(":"))
    return (
        _city_product_counts(clicks)
        .join(cities, "city_id")
        .groupBy("area", "product_id")
        .agg(
            F.sum("clicks").alias("click_count"),
            group_concat_distinct(city).alias("city_infos"),
        )
    )


def area_full_product(area_counts: DataFrame, product_info: DataFrame) -> DataFrame:
    """Area counts with product name and status; unknown products drop out."""
    products = product_info.select(
        "product_id", "product_name",
        product_status(F.col("extend_info")).alias("product_status"),
    )
    return area_counts.join(products, "product_id").select(
        "area", "product_id", "click_count", "city_infos", "product_name", "product_status"
    )


def area_top3_product(
    full_products: DataFrame, task_id: int, n: int = C.TOP_PRODUCTS_PER_AREA
) -> DataFrame:
    """The ``n`` most clicked products of every area."""
    by_clicks = Window.partitionBy("area").orderBy(F.desc("click_count"), "product_id")
    return (
        full_products.withColumn("rank", F.row_number().over(by_clicks))
        .where(F.col("rank") <= n)
        .withColumn("area_level", area_level(F.col("area")))
        .withColumn("task_id", F.lit(task_id).cast("long"))
        .select(*schemas.AREA_TOP3_PRODUCT)
    )


def salted_count(
    df: DataFrame, keys: Sequence[str], salt_from: Sequence[str], salts: int = 16
) -> DataFrame:
    """Rows per key in two stages: per key and salt, then per key.

    The salt is a hash of other columns, so a repeated task draws the same salts again.
    """
    salt = F.pmod(F.xxhash64(*salt_from), F.lit(salts))
    partial = df.groupBy(*keys, salt.alias("salt")).agg(F.count("*").alias("part"))
    return partial.groupBy(*keys).agg(F.sum("part").alias("row_count"))
