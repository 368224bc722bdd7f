"""Ad clicks: parsing, blacklist, counts and rankings, on batches and on micro-batches alike."""

import math
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrail import constants as C
from shoptrail.functions.datetimes import (
    format_date,
    format_date_key,
    millis_to_timestamp,
    parse_date_key,
)


def parse_ad_log(log: DataFrame) -> DataFrame:
    """Split ``epoch_millis province city user ad`` lines into typed columns."""
    part = F.split("value", " ")
    return log.select(
        millis_to_timestamp(F.get(part, F.lit(0))).alias("ts"),
        F.get(part, F.lit(1)).alias("province"),
        F.get(part, F.lit(2)).alias("city"),
        F.get(part, F.lit(3)).try_cast("long").alias("user_id"),
        F.get(part, F.lit(4)).try_cast("long").alias("ad_id"),
    )


def drop_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users that are not on the blacklist.

    Spark broadcasts the list while it is below its size threshold and shuffles beyond.
    """
    return clicks.join(blacklist.select("user_id"), "user_id", "left_anti")


def ad_stat(clicks: DataFrame) -> DataFrame:
    """Clicks per day (``yyyyMMdd``), province, city and ad."""
    counted = clicks.groupBy(F.to_date("ts").alias("day"), "province", "city", "ad_id").count()
    return counted.select(
        format_date_key(F.col("day")).alias("date"), "province", "city", "ad_id",
        F.col("count").alias("click_count"),
    )


def with_text_date(counts: DataFrame) -> DataFrame:
    """Counts with the date ``yyyy-MM-dd`` in place of ``yyyyMMdd``."""
    return counts.withColumn("date", format_date(parse_date_key(F.col("date"))))


def province_ad_count(stat: DataFrame) -> DataFrame:
    """Clicks per day (``yyyy-MM-dd``), province and ad, summed over cities."""
    return stat.groupBy(
        format_date(parse_date_key(F.col("date"))).alias("date"), "province", "ad_id"
    ).agg(F.sum("click_count").alias("click_count"))


def ad_province_top3(province_counts: DataFrame, n: int = C.TOP_ADS_PER_PROVINCE) -> DataFrame:
    """The ``n`` most clicked ads per day and province."""
    by_clicks = Window.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id")
    return (
        province_counts.withColumn("rank", F.row_number().over(by_clicks))
        .where(F.col("rank") <= n)
        .select("date", "province", "ad_id", "click_count")
    )


def next_top3(
    winners: DataFrame, touched: DataFrame, n: int = C.TOP_ADS_PER_PROVINCE
) -> DataFrame:
    """The ``n`` most clicked ads after some counts have grown.

    ``winners`` are the ``n`` best before, ``touched`` the new totals of all ads whose counts have
    changed since (date, province, ad_id, click_count each). No other ad can have become one of
    the best, as counts never shrink.
    """
    best = winners.unionByName(touched).groupBy("date", "province", "ad_id")
    return ad_province_top3(best.agg(F.max("click_count").alias("click_count")), n)


def ad_click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks per minute and ad."""
    counted = clicks.groupBy(F.window("ts", "1 minute").alias("minute"), "ad_id").count()
    start = F.col("minute.start")
    return counted.select(
        format_date(start).alias("date"),
        F.date_format(start, "HH").alias("hour"),
        F.date_format(start, "mm").alias("minute"),
        "ad_id",
        F.col("count").alias("click_count"),
    )


def trend_minute(trend: DataFrame) -> DataFrame:
    """The trend with the start of its minute as a timestamp."""
    text = F.concat("date", F.lit(" "), "hour", F.lit(":"), "minute", F.lit(":00"))
    return trend.withColumn("minute_start", F.to_timestamp(text, C.TIME_FORMAT))


def ad_click_trend_last_hour(trend: DataFrame, minutes: int = C.TREND_MINUTES) -> DataFrame:
    """The trend of the last ``minutes`` minutes before the newest one."""
    timed = trend_minute(trend)
    newest = timed.agg(F.max("minute_start")).scalar()
    start = newest - F.lit(timedelta(minutes=minutes))
    # The condition on the date follows from the other one and prunes folders by date.
    recent = (F.col("date") >= format_date(start)) & (F.col("minute_start") > start)
    return timed.where(recent).drop("minute_start")


def pane_seconds(size_seconds: int, slide_seconds: int) -> int:
    """The longest pane that no window of this size and slide cuts."""
    return math.gcd(size_seconds, slide_seconds)


def ad_click_panes(clicks: DataFrame, width: str) -> DataFrame:
    """Clicks per pane and ad: the shared parts of overlapping windows."""
    counted = clicks.groupBy(F.window("ts", width).alias("pane"), "ad_id").count()
    return counted.select(
        F.col("pane.start").alias("pane_start"), "ad_id", F.col("count").alias("click_count")
    )


def ad_click_window_runs(
    panes: DataFrame, size_seconds: int, slide_seconds: int
) -> DataFrame:
    """Runs of consecutive sliding windows with equal clicks of an ad, from panes of
    ``pane_seconds``: the first window's start, the last one's (seconds), ad_id, click_count.

    A pane enters a window with +n and leaves behind the last window that holds it with -n; the
    running sum of these events is the count of every window until the next event. So a pane
    gives a few events however many windows hold it. Time is cut into chunks of a day (or of a
    window, if that is longer), and what crosses the end of a chunk enters the next one again:
    sums run within one ad and chunk, so a busy ad is many small groups. Runs end with chunks.
    """
    slide = F.lit(slide_seconds).cast("long")
    width = pane_seconds(size_seconds, slide_seconds)
    pane = F.unix_seconds("pane_start")
    # Windows start at multiples of the slide: the last one at or before the pane, and all before
    # it that still hold the pane. With a slide longer than the window there may be none.
    last = F.floor(pane / slide) * slide
    first = F.ceil((pane - F.lit(size_seconds - width)) / slide) * slide
    chunk = slide * math.ceil(max(size_seconds, 86_400) / slide_seconds)
    start = F.col("first") - F.pmod("first", chunk)
    crosses = F.col("leave") > start + chunk

    def event(chunk_start, at, sign):
        return F.struct(
            chunk_start.alias("chunk"), at.alias("at"), (sign * F.col("click_count")).alias("n")
        )

    within = F.array(event(start, F.col("first"), 1),
                     event(start, F.least("leave", start + chunk), -1))
    beyond = F.array(event(start + chunk, start + chunk, 1),
                     event(start + chunk, F.col("leave"), -1))
    none = F.array().cast("array<struct<chunk:bigint,at:bigint,n:bigint>>")
    events = (
        panes.select(first.cast("long").alias("first"), (last + slide).cast("long").alias("leave"),
                     "ad_id", "click_count")
        .where("first < leave")
        .select("ad_id", F.explode(F.concat(within, F.when(crosses, beyond).otherwise(none))))
        .groupBy("ad_id", "col.chunk", "col.at").agg(F.sum("col.n").alias("n"))
        .where("n <> 0")
    )
    by_time = Window.partitionBy("ad_id", "chunk").orderBy("at")
    runs = events.select(
        "ad_id", F.col("at").alias("first_start"),
        (F.lead("at").over(by_time) - slide).alias("last_start"),
        F.sum("n").over(by_time).alias("click_count"),
    )
    return runs.where("click_count > 0").select(
        "first_start", "last_start", "ad_id", "click_count"
    )


def ad_click_sliding(panes: DataFrame, size_seconds: int, slide_seconds: int) -> DataFrame:
    """Clicks per sliding window and ad, from panes of ``pane_seconds``: one row per window with
    clicks, filled in from the runs of ``ad_click_window_runs`` without another shuffle."""
    runs = ad_click_window_runs(panes, size_seconds, slide_seconds)
    starts = F.sequence("first_start", "last_start", F.lit(slide_seconds).cast("long"))
    return runs.select(F.explode(starts).alias("start"), "ad_id", "click_count").select(
        F.date_format(F.timestamp_seconds("start"), C.TIME_FORMAT).alias("window_start"),
        F.date_format(
            F.timestamp_seconds(F.col("start") + size_seconds), C.TIME_FORMAT
        ).alias("window_end"),
        "ad_id",
        "click_count",
    )
