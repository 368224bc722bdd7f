"""A blacklist that grows by versions, and micro-batches pinned to the version they read."""

import re

from pyspark.sql import DataFrame, SparkSession

from shoptrail import schemas
from shoptrail.sinks.keyed import complete, file_system, glob_paths

_PIN = re.compile(r"/batch_id=(\d+)\.version=(-?\d+)$")


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest complete version; -1 before the first."""
    return max(complete(spark, path, "version"), default=-1)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The users listed as of a version (the newest by default), once each."""
    last = newest_version(spark, path) if version is None else version
    folders = [f"{path}/version={n}" for n in complete(spark, path, "version") if n <= last]
    if not folders:
        return spark.createDataFrame([], schemas.AD_BLACKLIST)
    return spark.read.schema(schemas.AD_BLACKLIST).parquet(*folders)


def insert_new(spark: SparkSession, path: str, users: DataFrame) -> int:
    """List those users (column user_id) that are not listed yet, as one new version.

    Returns the newest version, which stays the same if all were listed. Repeated and NULL ids
    are ignored. A version counts once it is written to its end, so a writer that fails changes
    nothing and may simply run again. One writer at a time.
    """
    last = newest_version(spark, path)
    new = (
        users.select("user_id").where("user_id IS NOT NULL").distinct()
        .join(read_version(spark, path, last), "user_id", "left_anti")
    )
    target = f"{path}/version={last + 1}"
    new.write.mode("overwrite").parquet(target)
    written = spark.read.schema(schemas.AD_BLACKLIST).parquet(target)
    if written.isEmpty():
        hadoop_path, fs = file_system(spark, target)
        fs.delete(hadoop_path, True)
        return last
    return last + 1


class PinnedBlacklist:
    """The blacklist at ``path`` for micro-batches that may be repeated.

    The first attempt of a batch records the newest version in ``pins``; a repetition reads the
    same one, so it counts what its first attempt counted however the list has grown since.
    """

    def __init__(self, path: str, pins: str):
        self.path, self.pins = path, pins

    def version(self, spark: SparkSession, batch_id: int) -> int:
        """The version of a batch, recorded now if it has none."""
        for name in glob_paths(spark, f"{self.pins}/batch_id={batch_id}.version=*"):
            return int(_PIN.search(name)[2])
        last = newest_version(spark, self.path)
        hadoop_path, fs = file_system(
            spark, f"{self.pins}/batch_id={batch_id}.version={last}"
        )
        fs.create(hadoop_path, True).close()
        return last

    def for_batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The list of a batch. Pins of batches before the last one are deleted: only the newest
        can be repeated."""
        users = read_version(spark, self.path, self.version(spark, batch_id))
        for name in glob_paths(spark, f"{self.pins}/batch_id=*"):
            if int(_PIN.search(name)[1]) < batch_id - 1:
                hadoop_path, fs = file_system(spark, name)
                fs.delete(hadoop_path, False)
        return users
