"""Visit sessions: aggregation, filtering and distribution statistics."""

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shoptrail import constants as C
from shoptrail import schemas
from shoptrail.functions.aggregates import group_concat_distinct
from shoptrail.functions.datetimes import format_time, parse_time, seconds_between
from shoptrail.functions.numbers import ratio
from shoptrail.functions.predicates import all_of, any_in, between, equal
from shoptrail.functions.strings import is_not_empty
from shoptrail.params import TaskParams


def session_aggregate(actions: DataFrame) -> DataFrame:
    """One row per session: user, keywords, categories, visit length (s), steps, start time.

    All aggregates combine map-side, so a busy session costs one partial row per task.
    """
    rows = actions.select(
        "session_id",
        "user_id",
        F.when(is_not_empty(F.col("search_keyword")), F.col("search_keyword")).alias("keyword"),
        F.col("click_category_id").cast("string").alias("category"),
        parse_time(F.col("action_time")).alias("action_ts"),
    )
    first, last = F.min("action_ts"), F.max("action_ts")
    return rows.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        group_concat_distinct(F.col("keyword")).alias("search_keywords"),
        group_concat_distinct(F.col("category")).alias("click_category_ids"),
        seconds_between(first, last).alias("visit_length"),
        F.count("*").alias("step_length"),
        format_time(first).alias("start_time"),
    )


def session_full_aggr(sessions: DataFrame, user_info: DataFrame) -> DataFrame:
    """Sessions with the attributes of their user; sessions of unknown users drop out."""
    users = user_info.select("user_id", "age", "professional", "city", "sex")
    return sessions.join(users, "user_id").select(
        "session_id", "user_id", "search_keywords", "click_category_ids",
        "visit_length", "step_length", "start_time", "age", "professional", "city", "sex",
    )


def session_condition(params: TaskParams) -> Column:
    """The conditions of a task on a session; absent ones pass every session."""
    return all_of(
        between(F.col("age"), params.start_age, params.end_age),
        any_in(F.col("professional"), params.professionals),
        any_in(F.col("city"), params.cities),
        equal(F.col("sex"), params.sex),
        any_in(F.col("search_keywords"), params.keywords),
        any_in(F.col("click_category_ids"), params.category_ids),
    )


def session_filter(full_sessions: DataFrame, params: TaskParams) -> DataFrame:
    return full_sessions.where(session_condition(params))


def session_detail(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Actions of the kept sessions.

    Pass stored sessions (see ``materialize``): Spark splits a hot session only where both
    sides are shuffled for the join, not where one still holds the layout of its aggregation.
    """
    return actions.join(sessions.select("session_id"), "session_id", "left_semi")


def _in_bucket(field: str, low: int, high: int | None) -> Column:
    value = F.col(field)
    return value >= low if high is None else value.between(low, high)


def _bucket_counts() -> list[Column]:
    """Session count and the number of sessions per visit-length and step-length bucket."""
    buckets = [
        F.count_if(_in_bucket(field, low, high)).alias(f"{field}_{name}")
        for field, table in (
            ("visit_length", C.VISIT_LENGTH_BUCKETS),
            ("step_length", C.STEP_LENGTH_BUCKETS),
        )
        for name, low, high in table
    ]
    return [F.count("*").alias("session_count"), *buckets]


def session_aggr_counts(sessions: DataFrame) -> DataFrame:
    """Session count and the number of sessions per visit-length and step-length bucket."""
    return sessions.agg(*_bucket_counts())


def observe_session_counts(sessions: DataFrame) -> tuple[DataFrame, Observation]:
    """The same sessions, whose counts are taken on the way when they are next written.

    Write the returned frame as it is, in the same stage: Spark takes the metrics of each
    partition that a writing stage has finished once, however often a task was tried. The counts
    are there after the write, which must be the first action on the frame.
    """
    seen = Observation(f"session-counts-{uuid.uuid4().hex}")
    return sessions.observe(seen, *_bucket_counts()), seen


def observed_counts(spark: SparkSession, seen: Observation) -> DataFrame:
    """The counts of a finished write in the layout of ``session_aggr_counts``; one row."""
    counts = seen.get
    return spark.createDataFrame(
        [tuple(counts.values())], ", ".join(f"`{name}` long" for name in counts)
    )


def session_aggr_stat(sessions: DataFrame, task_id: int) -> DataFrame:
    """Bucket shares of all sessions, two decimals."""
    return aggr_stat_of(session_aggr_counts(sessions), task_id)


def aggr_stat_of(counts: DataFrame, task_id: int) -> DataFrame:
    """Bucket shares from counts."""
    ratios = [
        ratio(F.col(name), F.col("session_count")).alias(f"{name}_ratio")
        for name in counts.columns
        if name != "session_count"
    ]
    return counts.select(F.lit(task_id).cast("long").alias("task_id"), "session_count", *ratios)


def as_session_detail(detail: DataFrame, task_id: int) -> DataFrame:
    """Detail actions in the layout of the session_detail result table."""
    return detail.withColumn("task_id", F.lit(task_id).cast("long")).select(
        *schemas.SESSION_DETAIL
    )
