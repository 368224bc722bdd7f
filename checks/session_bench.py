"""Seconds of session_aggregate over generated actions, by the number of sessions that a task holds
in a hash map before it sorts: ``python -m checks.session_bench [rows]``.
"""

import sys
import time

from pyspark.sql import functions as F

from shoptrail.operators.sessions import session_aggregate
from shoptrail.session import build_session

KEY = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def main(rows: int) -> None:
    spark = build_session("bench", "local[8]", {"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("OFF")
    # A third of all actions belong to one session.
    session = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.xxhash64("id") % 50_000)
    actions = spark.range(rows).select(
        F.concat(F.lit("s"), session).alias("session_id"), session.alias("user_id"),
        F.concat(F.lit("kw"), F.col("id") % 50).alias("search_keyword"),
        (F.col("id") % 100).alias("click_category_id"),
        F.lit("2024-01-01 10:00:00").alias("action_time"),
    )
    for limit in ("128", "20000", "128", "20000"):
        spark.conf.set(KEY, limit)
        start = time.perf_counter()
        session_aggregate(actions).write.format("noop").mode("overwrite").save()
        print(limit, round(time.perf_counter() - start, 1), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 5_000_000)
