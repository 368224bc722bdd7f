"""Plans and results with one session, city and product holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from shoptrail.operators import categories, pages, products, sampling, sessions
from shoptrail.session import materialize
from tests.helpers import final_plan, plan, rows

N = 30_000


@pytest.fixture(scope="module")
def table(spark):
    """An action log in which every third row belongs to session ``hot``."""
    hot = F.col("id") % 3 == 0
    return spark.range(N).select(
        F.lit("2024-01-01").alias("date"),
        F.col("id").alias("event_id"),
        F.when(hot, 0).otherwise(F.col("id") % 977).alias("user_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 977)).alias("session_id"),
        (F.col("id") * 7 % 10).alias("page_id"),
        F.date_format(F.timestamp_seconds(1704067200 + F.col("id")), "yyyy-MM-dd H:mm:ss").alias(
            "action_time"
        ),
        F.concat(F.lit("kw"), F.col("id") % 50).alias("search_keyword"),
        F.when(hot, 1).otherwise(F.col("id") % 100).alias("click_category_id"),
        F.when(hot, 1).otherwise(F.col("id") % 100).alias("click_product_id"),
        F.lit("1,2").alias("order_category_ids"),
        F.lit(None).cast("string").alias("pay_category_ids"),
        F.when(hot, 1).otherwise(F.col("id") % 25).alias("city_id"),
    )


@pytest.fixture
def small_tasks(spark):
    """Settings under which a few kilobytes count as a skewed partition."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_detail_join_splits_the_hot_session(spark, table, small_tasks):
    kept = materialize(sessions.session_aggregate(table), "kept")
    detail = sessions.session_detail(table, kept)
    assert "skew=true" in final_plan(detail)
    assert detail.count() == N


def test_small_sides_are_hashed_once_measured(spark, table):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = materialize(sessions.session_aggregate(table), "kept")
        assert "ShuffledHashJoin" in final_plan(sessions.session_detail(table, kept))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_user_join_splits_the_hot_user(spark, table, small_tasks):
    users = spark.range(977).select(
        F.col("id").alias("user_id"), F.lit(1).alias("age"), F.lit("p").alias("professional"),
        F.lit("c").alias("city"), F.lit("s").alias("sex"),
    )
    # Two thirds of the sessions belong to one user.
    owned = table.select(
        F.concat("session_id", F.lit("-"), "event_id").alias("session_id"), "user_id",
        F.lit("k").alias("search_keywords"), F.lit("1").alias("click_category_ids"),
        F.lit(1).alias("visit_length"), F.lit(1).alias("step_length"),
        F.lit("2024-01-01 00:00:00").alias("start_time"),
    )
    joined = sessions.session_full_aggr(owned, users)
    assert "skew=true" in final_plan(joined)
    assert joined.count() == N


def test_hot_session_is_merged_before_the_shuffle(table):
    aggregated = sessions.session_aggregate(table)
    text = plan(aggregated)
    assert text.index("partial_collect_set") > text.index("Exchange")  # printed top down
    hot = aggregated.where("session_id = 'hot'").first()
    assert hot["step_length"] == N // 3
    assert len(hot["search_keywords"].split(",")) == 50


def test_hot_session_pages_are_cut_into_pieces(table):
    views = pages.page_views(table, tie=("event_id",))
    whole = pages.page_views(table, tie=("event_id",), piece_seconds=10**9)
    assert rows(views) == rows(whole)


def test_details_of_a_few_sessions_leave_the_log_unshuffled(spark, table):
    few = materialize(spark.createDataFrame([("s1",), ("s2",)], "session_id string"), "few")
    for detail in (sampling.random_extract_detail(few, table),
                   categories.top10_session_detail(few, table)):
        text = final_plan(detail)
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_clicks_are_counted_before_the_city_join(spark, table):
    clicks = table.select("city_id", F.col("click_product_id").alias("product_id"))
    cities = spark.range(25).select(
        F.col("id").alias("city_id"), F.concat(F.lit("c"), "id").alias("city_name"),
        F.lit("China North").alias("area"),
    )
    counts = products.area_product_click_count(clicks, cities)
    text = plan(counts)
    join = text.index("Join")
    assert "partial_count(1)" in text[join:]
    assert "count(1)" not in text[:join]
    assert counts.agg(F.sum("click_count")).first()[0] == N


def test_salts_spread_a_hot_key(table):
    salted = products.salted_count(table, ["click_product_id"], ["event_id"], salts=8)
    assert plan(salted).count("Exchange hashpartitioning") == 2
    plain = table.groupBy("click_product_id").count()
    assert rows(salted) == rows(plain)


def test_no_cross_join_and_no_single_task_sort(table):
    counts = categories.category_counts(table)
    top = categories.top10_category(counts, 1)
    plans = [
        plan(top),
        plan(categories.top10_category_session(table, top, 1)),
        plan(sampling.random_extract_session(
            sessions.session_aggregate(table), 1
        )),
        plan(pages.page_convert_rate(pages.page_views(table), (1, 2, 3))),
    ]
    for text in plans:
        assert "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
    assert "TakeOrderedAndProject" in plans[0]
