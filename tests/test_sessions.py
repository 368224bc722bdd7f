import random

import pytest
from pyspark.sql import functions as F

from shoptrail import schemas
from shoptrail.operators import sampling, sessions
from shoptrail.params import TaskParams
from tests.helpers import action, actions, dicts, plan, rows

USERS = [
    (1, "u1", "n1", 20, "teacher", "city1", "male"),
    (2, "u2", "n2", 30, "nurse", "city2", "female"),
    (3, "u3", "n3", None, None, None, None),
]


def users(spark, rows=USERS):
    return spark.createDataFrame(rows, schemas.USER_INFO)


def test_keywords_and_categories_are_true_sets(spark):
    df = actions(
        spark,
        action("a", search_keyword="hotpot", click_category_id=21),
        action("a", search_keyword="pot", click_category_id=1),
        action("a", search_keyword="pot", click_category_id=21),
        action("a", search_keyword=""),
        action("b", search_keyword=""),
    )
    got = {r["session_id"]: r for r in dicts(sessions.session_aggregate(df))}
    assert got["a"]["search_keywords"] == "hotpot,pot"
    assert got["a"]["click_category_ids"] == "1,21"
    assert got["b"]["search_keywords"] is None
    assert got["b"]["click_category_ids"] is None


def test_lengths_start_and_user(spark):
    df = actions(
        spark,
        action("a", time="9:59:58", user_id=7),
        action("a", time="10:00:01", user_id=5),
        action("a", time="5:03:09", user_id=6),
        action("b", time="1:00:00"),
    )
    got = {r["session_id"]: r for r in dicts(sessions.session_aggregate(df))}
    assert got["a"]["visit_length"] == 4 * 3600 + 56 * 60 + 52
    assert got["a"]["step_length"] == 3
    assert got["a"]["start_time"] == "2024-01-01 05:03:09"
    assert got["a"]["user_id"] == 5
    assert got["b"]["visit_length"] == 0


def test_unknown_users_drop_and_double_users_multiply(spark):
    df = actions(spark, action("a", user_id=1), action("b", user_id=9))
    aggregated = sessions.session_aggregate(df)
    assert [r["session_id"] for r in dicts(sessions.session_full_aggr(aggregated, users(spark)))
            ] == ["a"]
    doubled = users(spark, [*USERS, USERS[0]])
    assert sessions.session_full_aggr(aggregated, doubled).count() == 2


@pytest.mark.parametrize(
    ("params", "kept"),
    [
        (TaskParams(), {"s1", "s2", "s3"}),
        (TaskParams(start_age=20, end_age=25), {"s1"}),
        (TaskParams(start_age=20), {"s1", "s2", "s3"}),
        (TaskParams(professionals=("nurse", "cook")), {"s2"}),
        (TaskParams(cities=("city1", "city2")), {"s1", "s2"}),
        (TaskParams(sex="female"), {"s2"}),
        (TaskParams(keywords=("pot",)), {"s2"}),
        (TaskParams(category_ids=("1",)), {"s3"}),
        (TaskParams(category_ids=("1", "21"), sex="male"), {"s1"}),
    ],
)
def test_session_filter(spark, params, kept):
    df = actions(
        spark,
        action("s1", user_id=1, search_keyword="hotpot", click_category_id=21),
        action("s2", user_id=2, search_keyword="pot"),
        action("s3", user_id=3, click_category_id=1),
    )
    full = sessions.session_full_aggr(sessions.session_aggregate(df), users(spark))
    got = sessions.session_filter(full, params)
    assert {r["session_id"] for r in dicts(got)} == kept


def _lengths(spark, lengths):
    return spark.createDataFrame(
        [(f"s{i}", v, s) for i, (v, s) in enumerate(lengths)],
        "session_id string, visit_length long, step_length long",
    )


def test_buckets_and_zero_seconds(spark):
    edges = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    steps = [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 99, 1, 1, 1, 1, 1, 1]
    df = _lengths(spark, list(zip(edges, steps, strict=True)))
    got = dicts(sessions.session_aggr_counts(df))[0]
    assert got.pop("session_count") == 18
    visits = [v for k, v in got.items() if k.startswith("visit")]
    step_counts = [v for k, v in got.items() if k.startswith("step")]
    assert visits == [2, 2, 2, 2, 2, 2, 2, 2, 1]  # the 0 s session is in none
    assert step_counts == [8, 2, 2, 2, 2, 2]


def test_stat_ratios(spark):
    got = dicts(sessions.session_aggr_stat(_lengths(spark, [(0, 1), (2, 5), (5, 5)]), 9))[0]
    assert len(got) == 17
    assert got["task_id"] == 9
    assert got["session_count"] == 3
    assert got["visit_length_1s_3s_ratio"] == 0.33
    assert got["step_length_4_6_ratio"] == 0.67
    empty = dicts(sessions.session_aggr_stat(_lengths(spark, [(1, 1)]).where("false"), 9))[0]
    assert empty["session_count"] == 0
    assert empty["visit_length_30m_ratio"] is None


def test_detail_keeps_actions_of_kept_sessions_once(spark):
    df = actions(spark, action("a"), action("a", 2), action("b"))
    kept = spark.createDataFrame([("a",), ("a",)], "session_id string")
    got = sessions.as_session_detail(sessions.session_detail(df, kept), 4)
    assert got.columns == list(schemas.SESSION_DETAIL)
    assert sorted(r["page_id"] for r in dicts(got)) == [1, 2]


def test_detail_has_its_own_product_column(spark):
    df = actions(spark, action("a", click_category_id=5, click_product_id=77))
    row = dicts(sessions.as_session_detail(df, 1))[0]
    assert (row["click_category_id"], row["click_product_id"]) == (5, 77)


def _started(spark, starts):
    return spark.createDataFrame(
        [(f"s{i:04}", start, None, None) for i, start in enumerate(starts)],
        "session_id string, start_time string, search_keywords string, "
        "click_category_ids string",
    )


def test_quota_splits_days_evenly_and_hours_by_share(spark):
    starts = ["2024-01-01 05:00:00"] * 30 + ["2024-01-01 06:00:00"] * 90
    starts += ["2024-01-02 00:00:01"] * 7
    got = rows(sampling.extract_quota(_started(spark, starts)))
    assert got == [
        ("2024-01-01", "05", 30, 120, 12), ("2024-01-01", "06", 90, 120, 37),
        ("2024-01-02", "00", 7, 7, 7),
    ]


def test_sessions_without_a_time_take_no_share(spark):
    starts = ["2024-01-01 05:00:00"] * 50 + [None]
    got = rows(sampling.extract_quota(_started(spark, starts), total=20))
    assert got == [("2024-01-01", "05", 50, 50, 20)]


def test_extract_draws_exactly_the_quota(spark):
    draw = random.Random(3)
    starts = [
        f"2024-01-0{draw.randint(1, 3)} {draw.randint(0, 5):02}:00:00" for _ in range(500)
    ]
    df = _started(spark, starts)
    quota = {r["date"] + " " + r["hour"]: r["quota"] for r in dicts(sampling.extract_quota(df))}
    for seed in (0, 1):
        got = dicts(sampling.random_extract_session(df, 5, seed))
        drawn = [r["start_time"][:13] for r in got]
        assert {hour: drawn.count(hour) for hour in quota} == quota
        assert len({r["session_id"] for r in got}) == len(got) <= 100
    first, again, other = (
        {r["session_id"] for r in dicts(sampling.random_extract_session(df, 5, seed))}
        for seed in (0, 0, 1)
    )
    assert first == again != other


def test_extract_of_nothing(spark):
    df = _started(spark, ["2024-01-01 05:00:00"]).where("false")
    assert rows(sampling.random_extract_session(df, 1)) == []


def test_extract_of_more_days_than_sessions_wanted(spark):
    starts = [str(d)[:10] + " 01:00:00" for d in
              spark.range(1).select(F.explode(F.sequence(
                  F.lit("2024-01-01").cast("date"), F.lit("2024-05-01").cast("date")
              ))).toPandas().iloc[:, 0]]
    assert rows(sampling.random_extract_session(_started(spark, starts), 1)) == []


def test_extract_limits_ranks_before_the_shuffle(spark):
    text = plan(sampling.random_extract_session(_started(spark, ["2024-01-01 05:00:00"]), 1))
    assert "row_number(), 100, Partial" in text


def test_extract_detail(spark):
    detail = actions(spark, action("a"), action("a", 2), action("b"))
    extracted = spark.createDataFrame([("a",)], "session_id string")
    assert sampling.random_extract_detail(extracted, detail).count() == 2
