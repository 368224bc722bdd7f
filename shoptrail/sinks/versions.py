"""Tables whose days micro-batches replace: of every day the newest version counts.

A micro-batch writes all rows of the days it changes under ``live/batch_id=N/date=D``. What came
before stays until later batches make it superfluous, so a repeated batch starts from what its first
attempt started from, and readers that have listed a folder still find it.
"""

from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shoptrail.sinks.keyed import complete, day_folders, delete_folder

_KIND = "live/batch_id"


def write_days(rows: DataFrame, path: str, batch_id: int, days: Collection[str]) -> None:
    """Replace ``days`` as of a micro-batch by ``rows`` (column ``date`` and more); a repeated batch
    replaces all that its first attempt wrote. Each day is one small file."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(1, min(tasks, len(days))), "date")
    dealt.write.mode("overwrite").partitionBy("date").parquet(f"{path}/{_KIND}={batch_id}")


def _versions(
    spark: SparkSession, path: str, days: Iterable[str] | None, before: int | None
) -> dict[str, list[tuple[int, str]]]:
    """The complete versions of every day, oldest first, as (batch id, folder)."""
    numbers = [n for n in complete(spark, path, _KIND) if before is None or n < before]
    found: dict[str, list[tuple[int, str]]] = {}
    for number, day, folder in sorted(day_folders(spark, path, _KIND, numbers, days)):
        found.setdefault(day, []).append((number, folder))
    return found


def read_days(
    spark: SparkSession, path: str, schema: T.StructType, days: Iterable[str] | None = None,
    before: int | None = None,
) -> DataFrame:
    """The newest version of every day, or of some ``days``; with ``before`` only versions of
    batches older than that. Only the folders needed are read."""
    folders = sorted(v[-1][1] for v in _versions(spark, path, days, before).values())
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/live")
    return reader.parquet(*folders).select(*schema.fieldNames())


def drop_superseded(
    spark: SparkSession, path: str, running: int, days: Iterable[str], keep: int = 2
) -> None:
    """Delete those versions of ``days`` that ``keep`` newer ones from before the running batch
    supersede."""
    for versions in _versions(spark, path, days, running).values():
        for _, folder in versions[:-keep]:
            delete_folder(spark, folder)
