"""Operators for preparing training data: deduplication, search, mixing, packing and scans."""

import os
from pathlib import Path

from pyspark.sql import SparkSession


# Rows of one batch between Spark and its Python workers: whole texts are long.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators' Python workers need, for the whole session.

    Batches become small, which bounds the memory of executors and workers alike, and workers on
    this machine import this package from where the driver did. On a cluster the package is
    installed on the nodes or shipped with ``--py-files``.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return spark
