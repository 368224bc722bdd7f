"""Reading reference tables over JDBC."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(
    spark: SparkSession, url: str, dbtable: str, user: str, password: str,
    driver: str | None = None, split_by: tuple[str, int, int, int] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A database table; ``split_by`` = (column, lower, upper, partitions) reads in parallel."""
    options = {
        "url": url, "dbtable": dbtable, "user": user, "password": password,
        "fetchsize": str(fetch_size),
    }
    if driver:
        options["driver"] = driver
    if split_by:
        column, lower, upper, partitions = split_by
        options |= {
            "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def city_info(spark: SparkSession, **connection) -> DataFrame:
    """The city table with the key as long, whatever the database's number type."""
    cities = read_jdbc(spark, dbtable="city_info", **connection)
    return cities.select(F.col("city_id").cast("long"), "city_name", "area")


def ad_blacklist(spark: SparkSession, **connection) -> DataFrame:
    """Blacklisted users; as the static side of a stream it is queried in every micro-batch."""
    users = read_jdbc(spark, dbtable="ad_blacklist", **connection)
    return users.select(F.col("user_id").cast("long"))
