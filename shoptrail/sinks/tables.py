"""Writing result tables as a whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    """Add rows to a parquet table."""
    df.write.mode("append").parquet(path)


def append_jdbc(
    df: DataFrame, url: str, dbtable: str, user: str, password: str,
    driver: str | None = None, batch_size: int = 1_000, connections: int = 10,
) -> None:
    """Add rows to a database table in batched inserts over a limited number of connections."""
    options = {
        "url": url, "dbtable": dbtable, "user": user, "password": password,
        "batchsize": str(batch_size), "numPartitions": str(connections),
    }
    if driver:
        options["driver"] = driver
    df.write.format("jdbc").mode("append").options(**options).save()


def replace_groups(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the rows of exactly those key groups that occur in ``df``; others stay.

    Writing the same rows again leaves the table as it is, so a repeated job does no harm.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def replace_task(df: DataFrame, path: str, task_id: int) -> None:
    """Replace the rows of one task, also by none; other tasks' rows stay."""
    df.drop("task_id").write.mode("overwrite").parquet(f"{path}/task_id={task_id}")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report of all tasks with ``task_id`` as a long in front."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c != "task_id"]
    return rows.select(F.col("task_id").cast("long").alias("task_id"), *others)


def save_actions(df: DataFrame, table: str, buckets: int | None = None) -> None:
    """Store the action log partitioned by date, so that date ranges prune whole folders.

    With ``buckets`` it is also clustered by session: session aggregates and joins then need
    no shuffle, at the price that a very long session stays in one bucket.
    """
    writer = df.write.mode("overwrite").format("parquet").partitionBy("date")
    if buckets:
        writer = writer.bucketBy(buckets, "session_id")
    writer.saveAsTable(table)
