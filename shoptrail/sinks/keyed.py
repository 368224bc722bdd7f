"""Tables of counts that grow by micro-batches.

A micro-batch adds its own counts under ``live/batch_id=N``, in few files whatever the number of
days it touches, so that a batch of late clicks costs no more. Old batches are summed into
``base/upto=M/date=D``, which stands for all batches up to M of the days it holds. Every folder
is written as a whole and counts once it is complete; readers take the newest base of each day and
the batches after the last base.
"""

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LIVE_BATCHES = 50

_FOLDER = re.compile(r"/(base/upto|live/batch_id|version)=(\d+)(?:/date=([^/]*))?/?$")


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    hadoop_path, fs = file_system(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(hadoop_path) or []]


def complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders of a kind (``base/upto``, ``live/batch_id``) written to their end."""
    found = glob_paths(spark, f"{path}/{kind}=*/_SUCCESS")
    return sorted(int(_FOLDER.search(f.removesuffix("/_SUCCESS"))[2]) for f in found)


def day_folders(
    spark: SparkSession, path: str, kind: str, numbers: Iterable[int], days: Iterable[str] | None
) -> list[tuple[int, str, str]]:
    """Number, day and path of the day folders below complete folders."""
    numbers = set(numbers)
    if not numbers:
        return []
    day = "*" if days is None else "{" + ",".join(days) + "}"
    found = []
    for folder in glob_paths(spark, f"{path}/{kind}=*/date={day}"):
        match = _FOLDER.search(folder)
        if int(match[2]) in numbers:
            found.append((int(match[2]), match[3], folder))
    return found


def _live(path: str, batch_id: int) -> str:
    return f"{path}/live/batch_id={batch_id}"


def write_counts(counts: DataFrame, path: str, batch_id: int) -> None:
    """Add the counts of one micro-batch (column ``date`` and more).

    A repeated batch replaces all that its first attempt wrote, whatever days either touches.
    """
    counts.write.mode("overwrite").parquet(_live(path, batch_id))


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The counts that one micro-batch wrote."""
    return spark.read.schema(schema).parquet(_live(path, batch_id))


def _days_of(spark: SparkSession, folders: Sequence[str]) -> list[str]:
    """The days in live folders, from their column ``date`` alone."""
    if not folders:
        return []
    days = spark.read.schema("date string").parquet(*folders).distinct().collect()
    return sorted(r.date for r in days if r.date is not None)


def batch_days(spark: SparkSession, path: str, batch_id: int) -> list[str]:
    """The days that a micro-batch wrote."""
    return _days_of(spark, glob_paths(spark, _live(path, batch_id)))


def all_days(spark: SparkSession, path: str) -> list[str]:
    """The days with counts."""
    bases = glob_paths(spark, f"{path}/base/upto=*/date=*")
    live = [_live(path, n) for n in complete(spark, path, "live/batch_id")]
    return sorted({_FOLDER.search(f)[3] for f in bases} | set(_days_of(spark, live)))


def _chosen(
    spark: SparkSession, path: str, days: Iterable[str] | None, before: int | None = None
) -> dict[str, list[str]]:
    """The folders that make up the counts, by kind: those of days, and those of batches."""
    bases = complete(spark, path, "base/upto")
    newest: dict[str, tuple[int, str]] = {}
    for upto, day, folder in day_folders(spark, path, "base/upto", bases, days):
        newest[day] = max(newest.get(day, (-1, "")), (upto, folder))
    last = max(bases, default=-1)
    return {
        "base": sorted(folder for _, folder in newest.values()),
        "live": [
            _live(path, n) for n in complete(spark, path, "live/batch_id")
            if n > last and (before is None or n < before)
        ],
    }


def read_counts(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
    days: Iterable[str] | None = None, before: int | None = None,
) -> DataFrame:
    """The current ``click_count`` of every key, from the folders complete at the call.

    With ``days`` only the folders of these days are listed and read, and of the few batches since
    only their rows; with ``before`` only batches older than that.
    """
    days = None if days is None else list(days)
    rows = spark.createDataFrame([], schema)
    for kind, folders in _chosen(spark, path, days, before).items():
        if folders:
            reader = spark.read.schema(schema).option("basePath", f"{path}/{kind}")
            part = reader.parquet(*folders).select(*schema.fieldNames())
            if kind == "live" and days is not None:
                part = part.where(F.col("date").isin(days))
            rows = rows.unionByName(part)
    return rows.groupBy(*keys).agg(F.sum("click_count").alias("click_count"))


def merge(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], running: int,
    max_batches: int | None = None, delete: Callable[[str], None] | None = None,
) -> None:
    """Sum the batches before the ``running`` one into a base once there are ``max_batches``
    (MAX_LIVE_BATCHES).

    The running batch may be repeated, so it is never merged. A base counts when its folder is
    complete; what it replaces stays for readers that have listed it and goes with the next merge.
    """
    bases = complete(spark, path, "base/upto")
    last = max(bases, default=-1)
    every = complete(spark, path, "live/batch_id")
    ripe = [n for n in every if last < n < running]
    if len(ripe) < (max_batches or MAX_LIVE_BATCHES):
        return
    days = _days_of(spark, [_live(path, n) for n in ripe])
    summed = read_counts(spark, path, schema, keys, days, before=running)
    summed.write.mode("overwrite").partitionBy("date").parquet(f"{path}/base/upto={ripe[-1]}")
    remove = delete or (lambda folder: delete_folder(spark, folder))
    for number in every:
        if number <= last:
            remove(_live(path, number))
    older = day_folders(spark, path, "base/upto", bases, None)
    newest: dict[str, int] = {}
    for upto, day, _ in older:
        newest[day] = max(newest.get(day, -1), upto)
    for upto, day, folder in older:
        if upto < newest[day]:
            remove(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    hadoop_path, fs = file_system(spark, folder)
    fs.delete(hadoop_path, True)
