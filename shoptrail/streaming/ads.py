"""Real-time ad statistics as Structured Streaming queries.

Every micro-batch is counted as a batch of its own and its counts are added to what is stored,
under its batch id. So no click is too late, no state grows, the blacklist is that of the batch,
and a query restarted from its checkpoint goes on where it stopped.
"""

from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoptrail import constants as C
from shoptrail import schemas
from shoptrail.functions.datetimes import format_date
from shoptrail.operators import ads
from shoptrail.sinks.blacklist import PinnedBlacklist
from shoptrail.sinks.keyed import (
    all_days,
    batch_days,
    merge,
    read_batch,
    read_counts,
    write_counts,
)
from shoptrail.sinks.versions import drop_superseded, read_days, write_days

# Fixed value: the micro-batch interval of the reports.
BATCH_INTERVAL = {"processingTime": "5 seconds"}

_STAT = schemas.layout(
    "date string, province string, city string, ad_id bigint, click_count bigint"
)
_PROVINCE = schemas.layout("date string, province string, ad_id bigint, click_count bigint")
_TREND = schemas.layout(
    "date string, hour string, minute string, ad_id bigint, click_count bigint"
)
_PANES = schemas.layout("date string, pane_start timestamp, ad_id bigint, click_count bigint")
_PROVINCE_KEYS = ("date", "province", "ad_id")
_TOP3 = schemas.layout("date string, province string, ad_id bigint, click_count bigint")
_PANE_KEYS = ("date", "pane_start", "ad_id")

# A blacklist, a function that gives the one of the moment, or one that batches pin.
Blacklist = DataFrame | Callable[[], DataFrame] | PinnedBlacklist


def _start(
    log: DataFrame, on_batch, checkpoint: str, trigger: dict[str, Any], name: str | None
) -> StreamingQuery:
    def adaptive(batch: DataFrame, batch_id: int) -> None:
        # Streams run in a session without adaptive execution; a micro-batch is a batch job.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        on_batch(batch, batch_id)

    writer = (
        log.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(adaptive)
    )
    return (writer.queryName(name) if name else writer).start()


def _allowed(log: DataFrame, blacklist: Blacklist | None, batch_id: int) -> DataFrame:
    clicks = ads.parse_ad_log(log)
    if blacklist is None:
        return clicks
    if isinstance(blacklist, PinnedBlacklist):
        blacklist = blacklist.for_batch(log.sparkSession, batch_id)
    return ads.drop_blacklisted(clicks, blacklist() if callable(blacklist) else blacklist)


def update_province_top3(
    spark: SparkSession, stat_path: str, batch_id: int, top3_path: str
) -> None:
    """Bring the ranking of the days that a micro-batch changed up to date.

    Counts only grow, so the new winners of a province are among its winners before the batch and
    the ads that the batch touched: only these are ranked, with the totals of the touched ads. The
    winners before are those of the newest version older than the batch, so a repeated batch does
    not start from what its first attempt wrote. A day is a folder of its own with few files.
    """
    path = f"{stat_path}/province"
    days = batch_days(spark, path, batch_id)
    if not days:
        write_days(spark.createDataFrame([], _TOP3), top3_path, batch_id, days)
        return
    touched = read_batch(spark, path, batch_id, _PROVINCE)
    # The semi-join is pushed below the sum: counts of other ads are not even shuffled.
    totals = read_counts(spark, path, _PROVINCE, _PROVINCE_KEYS, days).join(
        touched.select(*_PROVINCE_KEYS), list(_PROVINCE_KEYS), "left_semi"
    )
    dated = [str(datetime.strptime(day, "%Y%m%d").date()) for day in days]
    before = read_days(spark, top3_path, _TOP3, dated, before=batch_id)
    best = ads.next_top3(before, ads.with_text_date(totals))
    write_days(best, top3_path, batch_id, dated)
    drop_superseded(spark, top3_path, batch_id, dated)


def start_ad_stat(
    log: DataFrame, blacklist: Blacklist, stat_path: str, top3_path: str | None,
    checkpoint: str, trigger: dict[str, Any] = BATCH_INTERVAL, name: str | None = None,
) -> StreamingQuery:
    """Count the clicks of users not blacklisted, and rank the ads of each province and day.

    Pass a function as ``blacklist`` to read the list anew in every micro-batch. Counts per
    province are kept beside those per city, so that the ranking reads few rows.
    """
    spark = log.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        city, province = f"{stat_path}/city", f"{stat_path}/province"
        write_counts(ads.ad_stat(_allowed(batch, blacklist, batch_id)), city, batch_id)
        written = read_batch(spark, city, batch_id, _STAT)
        summed = written.groupBy(*_PROVINCE_KEYS).agg(F.sum("click_count").alias("click_count"))
        write_counts(summed, province, batch_id)
        if top3_path is not None:
            update_province_top3(spark, stat_path, batch_id, top3_path)
        merge(spark, city, _STAT, schemas.AD_STAT_KEYS, batch_id)
        merge(spark, province, _PROVINCE, _PROVINCE_KEYS, batch_id)

    return _start(log, on_batch, checkpoint, trigger, name)


def start_ad_click_trend(
    log: DataFrame, trend_path: str, checkpoint: str,
    trigger: dict[str, Any] = BATCH_INTERVAL, blacklist: Blacklist | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Count the clicks per minute and ad, however late they come.

    All clicks count, unless a ``blacklist`` is given.
    """
    spark = log.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_counts(ads.ad_click_trend(_allowed(batch, blacklist, batch_id)), trend_path, batch_id)
        merge(spark, trend_path, _TREND, schemas.AD_CLICK_TREND_KEYS, batch_id)

    return _start(log, on_batch, checkpoint, trigger, name)


def start_ad_click_panes(
    log: DataFrame, pane_path: str, checkpoint: str, size_seconds: int, slide_seconds: int,
    trigger: dict[str, Any] = BATCH_INTERVAL, name: str | None = None,
) -> StreamingQuery:
    """Count the clicks per pane and ad: the parts that sliding windows of this size share."""
    spark = log.sparkSession
    width = f"{ads.pane_seconds(size_seconds, slide_seconds)} seconds"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        panes = ads.ad_click_panes(ads.parse_ad_log(batch), width)
        dated = panes.withColumn("date", format_date(F.col("pane_start")))
        write_counts(dated, pane_path, batch_id)
        merge(spark, pane_path, _PANES, _PANE_KEYS, batch_id)

    return _start(log, on_batch, checkpoint, trigger, name)


def read_stat(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """Current ad statistics, of some days (``yyyyMMdd``) or all."""
    return read_counts(spark, f"{path}/city", _STAT, schemas.AD_STAT_KEYS, days)


def read_trend(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """Current click trend, of some days (``yyyy-MM-dd``) or all."""
    return read_counts(spark, path, _TREND, schemas.AD_CLICK_TREND_KEYS, days)


def read_last_hour(spark: SparkSession, path: str, minutes: int = C.TREND_MINUTES) -> DataFrame:
    """The trend of the last ``minutes`` minutes; reads the newest day and those it reaches back
    into only."""
    known = [day for day in all_days(spark, path) if day[:1].isdigit()]
    days = None
    if known:
        newest = date.fromisoformat(known[-1])
        days = [str(newest - timedelta(days=n)) for n in range(minutes // 1440 + 2)]
    return ads.ad_click_trend_last_hour(read_trend(spark, path, days), minutes)


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    """Current pane counts."""
    return read_counts(spark, path, _PANES, _PANE_KEYS).drop("date")


def read_province_top3(
    spark: SparkSession, path: str, days: Sequence[str] | None = None
) -> DataFrame:
    """Current ranking, of some days (``yyyy-MM-dd``) or all."""
    return read_days(spark, path, _TOP3, days)
