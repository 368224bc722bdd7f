"""Spark session settings and the shared working folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Times are text or epoch values; one zone keeps parsing and formatting stable.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan from measured sizes: coalesce partitions, split skewed joins, pick join strategy.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort where every measured partition of one side is this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Distinct lists per session stay in a hash map for this many sessions a task before it sorts.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}

# Shuffles start with many small partitions, which are coalesced by measured size.
_CLUSTER_SETTINGS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators rely on to a session made elsewhere.

    They hold for the whole session: its time zone becomes UTC and execution adaptive.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "shoptrail",
    master: str | None = None,
    conf: dict[str, str] | None = None,
    hive: bool = False,
) -> SparkSession:
    """Create a session; with ``hive`` tables resolve in the Hive metastore.

    A session on a cluster starts shuffles with 8000 partitions, unless ``conf`` says otherwise.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    settings = {**_SETTINGS, **({} if local else _CLUSTER_SETTINGS), **(conf or {})}
    for key, value in settings.items():
        builder = builder.config(key, value)
    if hive:
        builder = builder.enableHiveSupport()
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="shoptrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder below the shared one that is deleted at the end of the block, also on failure."""
    folder = new_folder(spark, name)
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from the written table.

    Later readers neither repeat the work nor lose it with an executor. ``folder`` is one from
    ``scratch``.
    """
    path = f"{folder}/{name}" if folder else new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
