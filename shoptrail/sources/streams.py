"""Ad log streams: one text column ``value`` per click."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrail import schemas


def kafka_ad_log(
    spark: SparkSession, brokers: str, topics: str, starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Ad log from Kafka topics (comma list); needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topics)
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def file_ad_log(
    spark: SparkSession, path: str, file_format: str = "text",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Ad log from files as they arrive in a folder."""
    reader = spark.readStream.format(file_format).schema(schemas.AD_LOG)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
