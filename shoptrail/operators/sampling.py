"""Stratified extraction of sessions over days and hours."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrail import constants as C
from shoptrail import schemas


def _with_date_hour(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns(
        {
            "date": F.substring("start_time", 1, 10),
            "hour": F.substring("start_time", 12, 2),
        }
    )


def _levels(sessions: DataFrame) -> DataFrame:
    """Sessions per hour, per date and of all dates as rows of three levels (0, 1 and 3), from one
    rollup. A missing time makes date and hour NULL, which the level tells from a total."""
    return _with_date_hour(sessions).rollup("date", "hour").agg(
        F.grouping_id().alias("level"), F.count("*").alias("session_count")
    )


def sessions_per_date_hour(sessions: DataFrame) -> DataFrame:
    """Sessions started per date and hour, with the total of the date."""
    day = Window.partitionBy("date")
    total = F.max(F.when(F.col("level") == 1, F.col("session_count"))).over(day)
    levels = _levels(sessions).where("level < 3").withColumn("day_count", total)
    return levels.where("level = 0").select("date", "hour", "session_count", "day_count")


def extract_quota(sessions: DataFrame, total: int = C.EXTRACT_SESSIONS) -> DataFrame:
    """Number of sessions to draw per date and hour.

    Every date gets the same whole share of ``total``, split over its hours by their counts.
    Sessions without a time belong to no date and take no share. Hour counts, date totals and the
    number of dates come from one rollup over the sessions: what follows it are 25 rows a date.
    """
    counts = sessions_per_date_hour(sessions).where(F.col("date").isNotNull())
    # One row per date: their number, counted over the hour with the first place of its date.
    first = Window.partitionBy("date").orderBy("hour")
    every = Window.partitionBy(F.lit(0))
    placed = counts.withColumn("place", F.row_number().over(first))
    days = F.count_if(F.col("place") == 1).over(every)
    share = F.col("session_count").cast("double") / F.col("day_count").cast("double")
    quota = F.floor(share * F.floor(F.lit(total) / days))
    return placed.select(
        "date", "hour", "session_count", "day_count",
        F.least(F.col("session_count"), quota).alias("quota"),
    )


def random_extract_session(
    sessions: DataFrame, task_id: int, seed: int = 0, total: int = C.EXTRACT_SESSIONS
) -> DataFrame:
    """Draw the quota of every date and hour, by the order of a seeded digest.

    No quota exceeds ``total``, so each task passes on at most that many sessions per hour.
    """
    draw = Window.partitionBy("date", "hour").orderBy(
        F.md5(F.concat("session_id", F.lit(f"|{seed}"))), "session_id"
    )
    ranked = (
        _with_date_hour(sessions)
        .select("date", "hour", "session_id", "start_time", "search_keywords",
                "click_category_ids")
        .withColumn("draw", F.row_number().over(draw))
        .where(F.col("draw") <= total)
    )
    quota = extract_quota(sessions, total).select("date", "hour", "quota")
    return (
        ranked.join(quota, ["date", "hour"])
        .where(F.col("draw") <= F.col("quota"))
        .withColumn("task_id", F.lit(task_id).cast("long"))
        .select(*schemas.SESSION_RANDOM_EXTRACT)
    )


def random_extract_detail(extracted: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions of the extracted sessions, which are EXTRACT_SESSIONS at most.

    They passed the task's conditions already, so ``actions`` need not be narrowed to kept
    sessions, and the broadcast of the ids leaves the action table unshuffled.
    """
    return actions.join(F.broadcast(extracted.select("session_id")), "session_id")
