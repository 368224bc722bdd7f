from datetime import datetime

import pytest

from shoptrail import schemas
from shoptrail.operators import ads
from tests.helpers import plan, rows

START = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC
MINUTE = 60_000


def line(minute, province="p", city="c", user=1, ad=1):
    return f"{START + int(minute * MINUTE)} {province} {city} {user} {ad}"


def log(spark, *lines):
    return spark.createDataFrame([(text,) for text in lines], schemas.AD_LOG)


def clicks(spark, *lines):
    return ads.parse_ad_log(log(spark, *lines))


def test_parse(spark):
    got = clicks(spark, line(1.5, "north", "Ald", 7, 8), "x p c y 1", "short")
    assert rows(got.selectExpr("unix_millis(ts)", "province", "city", "user_id", "ad_id")) == [
        (START + 90_000, "north", "Ald", 7, 8), (None, "p", "c", None, 1),
        (None, None, None, None, None),
    ]


def test_blacklist(spark):
    df = clicks(spark, line(0, user=1), line(0, user=2))
    listed = spark.createDataFrame([(2,), (2,)], schemas.AD_BLACKLIST)
    assert rows(ads.drop_blacklisted(df, listed).select("user_id")) == [(1,)]
    nobody = listed.where("false")
    assert ads.drop_blacklisted(df, nobody).count() == 2


def test_stat_and_both_date_formats(spark):
    day = 24 * 60
    df = clicks(spark, line(0), line(1), line(0, city="d"), line(day))
    stat = ads.ad_stat(df)
    assert rows(stat) == [
        ("20240101", "p", "c", 1, 2), ("20240101", "p", "d", 1, 1), ("20240102", "p", "c", 1, 1),
    ]
    assert rows(ads.province_ad_count(stat)) == [
        ("2024-01-01", "p", 1, 3), ("2024-01-02", "p", 1, 1),
    ]


def test_top3_per_day_and_province(spark):
    counts = spark.createDataFrame(
        [("2024-01-01", "p", ad, n) for ad, n in ((5, 1), (4, 1), (3, 1), (2, 1), (1, 9))]
        + [("2024-01-02", "p", 7, 1)],
        "date string, province string, ad_id long, click_count long",
    )
    got = ads.ad_province_top3(counts)
    assert [(r[0], r[2]) for r in rows(got)] == [
        ("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-01", 3), ("2024-01-02", 7),
    ]
    assert "row_number(), 3, Partial" in plan(got)


def test_trend_and_last_hour(spark):
    df = clicks(spark, line(0), line(0.9), line(1, ad=2), line(60.2), line(61.5))
    trend = ads.ad_click_trend(df)
    assert rows(trend) == [
        ("2024-01-01", "00", "00", 1, 2), ("2024-01-01", "00", "01", 2, 1),
        ("2024-01-01", "01", "00", 1, 1), ("2024-01-01", "01", "01", 1, 1),
    ]
    last = ads.ad_click_trend_last_hour(trend).select("hour", "minute")
    assert rows(last) == [("01", "00"), ("01", "01")]


@pytest.mark.parametrize(
    ("size", "slide"), [(3600, 600), (3600, 10), (600, 600), (60, 7), (90, 60)]
)
def test_sliding_windows_equal_the_built_in_window(spark, size, slide):
    df = clicks(spark, *[line(m, ad=ad) for m, ad in ((0, 1), (9.99, 1), (10, 2), (75, 1))])
    panes = ads.ad_click_panes(df, f"{ads.pane_seconds(size, slide)} seconds")
    got = ads.ad_click_sliding(panes, size, slide)
    built_in = (
        df.selectExpr(f"window(ts, '{size} seconds', '{slide} seconds') AS w", "ad_id")
        .groupBy("w", "ad_id").count()
        .selectExpr("date_format(w.start, 'yyyy-MM-dd HH:mm:ss')",
                    "date_format(w.end, 'yyyy-MM-dd HH:mm:ss')", "ad_id", "count")
    )
    assert rows(got) == rows(built_in)


def test_epoch_is_utc(spark):
    assert clicks(spark, line(0)).first()["ts"] == datetime(2024, 1, 1)
