import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shoptrail.operators import pages
from tests.helpers import action, actions, dicts, final_plan, rows


def views_of(spark, *page_times, session="a"):
    return actions(spark, *[action(session, page, time) for page, time in page_times])


def test_pages_follow_time_not_input_order(spark):
    df = views_of(spark, (3, "10:00:02"), (1, "9:59:59"), (2, "10:00:01"))
    got = {r["page_id"]: r["prev_page"] for r in dicts(pages.page_views(df))}
    assert got == {1: None, 2: 1, 3: 2}


def brute_force(rows_in):
    sessions = defaultdict(list)
    for session, page, seconds, tie in rows_in:
        sessions[session].append((seconds, tie, page))
    pairs = []
    for session, visits in sessions.items():
        visits.sort()
        previous = None
        for _, _, page in visits:
            pairs.append((session, page, previous))
            previous = page
    return sorted(pairs, key=repr)


@pytest.mark.parametrize("piece_seconds", [1, 74, 600, 10**9])
def test_page_views_equal_brute_force_for_any_piece(spark, piece_seconds):
    draw = random.Random(piece_seconds)
    # One session holds a third of the views, no session another; times repeat, so ties matter.
    given = [
        (draw.choice(["hot", None, f"s{draw.randint(0, 40)}"]), draw.randint(0, 5),
         draw.randint(0, 900), tie)
        for tie in range(3000)
    ]
    table = spark.createDataFrame(given, "session_id string, page_id long, s long, tie long")
    table = table.selectExpr(
        "*", "date_format(timestamp_seconds(1704067200 + s), 'yyyy-MM-dd H:mm:ss') AS action_time"
    )
    got = pages.page_views(table, tie=("tie",), piece_seconds=piece_seconds)
    assert rows(got.select("session_id", "page_id", "prev_page")) == brute_force(given)


def test_the_log_is_shuffled_once(spark):
    df = views_of(spark, (1, "1:00:00"), (2, "1:00:01"))
    text = final_plan(pages.page_views(df))
    assert text.count("Exchange hashpartitioning(session_id") - text.count("ReusedExchange") <= 2
    assert "ReusedExchange" in text


@pytest.mark.parametrize("session", ["a", None])
def test_a_session_of_one_action_a_second_is_spread(spark, session):
    table = spark.range(20_000).select(
        F.lit(session).cast("string").alias("session_id"), (F.col("id") % 7).alias("page_id"),
        F.date_format(F.timestamp_seconds(F.col("id") + 1704067200), "yyyy-MM-dd HH:mm:ss").alias(
            "action_time"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        views = pages.page_views(table)
        tasks = [r["count"] for r in views.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 20_000 and max(tasks) < 10_000 and len(tasks) > 4
    assert views.where("prev_page = (page_id + 6) % 7").count() == 19_999


def test_only_flow_steps_match(spark):
    df = views_of(spark, (1, "1:00:00"), (2, "1:00:01"), (4, "1:00:02"), (2, "1:00:03"),
                  (3, "1:00:04"))
    assert rows(pages.page_split_match(pages.page_views(df), (1, 2, 3))) == [
        ("a", "1_2"), ("a", "2_3"),
    ]


def test_rates_of_missing_pairs_and_empty_bases(spark):
    df = views_of(spark, (1, "1:00:00"), (2, "1:00:01"), (1, "1:00:02"))
    views = pages.page_views(df)
    assert rows(pages.page_convert_rate(views, (1, 2, 3, 4))) == [
        (1, "1_2", 1, 0.5), (2, "2_3", 0, 0.0), (3, "3_4", 0, None),
    ]
    unseen = pages.page_convert_rate(views, (9, 1))
    assert rows(unseen) == [(1, "9_1", 0, None)]
    text = pages.page_split_convert_rate(pages.page_convert_rate(views, (1, 2, 3, 4)), 6)
    assert rows(text) == [(6, "1_2=0.5|2_3=0.0|3_4=null")]


def test_repeated_pair_keeps_a_row_per_step(spark):
    df = views_of(spark, (1, "1:00:00"), (2, "1:00:01"), (1, "1:00:02"), (2, "1:00:03"))
    got = rows(pages.page_convert_rate(pages.page_views(df), (1, 2, 1, 2)))
    assert got == [(1, "1_2", 2, 1.0), (2, "2_1", 1, 0.5), (3, "1_2", 2, 2.0)]
    assert rows(pages.page_split_pv(pages.page_views(df), (1, 2, 1, 2))) == [
        ("1_2", 2), ("2_1", 1),
    ]


def test_start_page(spark):
    df = views_of(spark, (1, "1:00:00"), (2, "1:00:01"), (1, "1:00:02"))
    assert rows(pages.start_page_pv(df, (1, 2))) == [(2,)]


def test_flow_with_more_than_nine_steps_keeps_step_order(spark):
    flow = tuple(range(12))
    df = views_of(spark, *[(page, f"1:00:{page:02}") for page in flow])
    text = pages.page_split_convert_rate(
        pages.page_convert_rate(pages.page_views(df), flow), 1
    )
    assert dicts(text)[0]["convert_rate"] == "|".join(f"{a}_{a + 1}=1.0" for a in range(11))
