import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shoptrail import schemas
from shoptrail.operators import ads
from shoptrail.sinks import keyed
from shoptrail.sinks.keyed import all_days, batch_days, merge, read_counts, write_counts
from shoptrail.sources.streams import file_ad_log
from shoptrail.streaming import ads as stream
from tests.helpers import plan, rows
from tests.test_ads import line, log

NOW = {"availableNow": True}


class Feed:
    """A folder that receives ad log files one after the other."""

    def __init__(self, folder):
        self.path = folder / "log"
        self.path.mkdir()
        self.count = 0
        self.lines = []

    def add(self, *lines):
        self.count += 1
        name = self.path / f"{self.count:03}.txt"
        name.write_text("\n".join(lines) + "\n")
        os.utime(name, (1_700_000_000 + self.count, 1_700_000_000 + self.count))
        self.lines += lines


@pytest.fixture
def feed(tmp_path):
    return Feed(tmp_path)


def random_lines(seed, n, minutes):
    draw = random.Random(seed)
    return [
        line(draw.uniform(*minutes), f"p{draw.randint(0, 2)}", f"c{draw.randint(0, 3)}",
             draw.randint(0, 9), draw.randint(0, 5))
        for _ in range(n)
    ]


def run_stat(spark, feed, tmp_path, blacklist, **options):
    query = stream.start_ad_stat(
        file_ad_log(spark, str(feed.path), max_files_per_trigger=1), blacklist,
        str(tmp_path / "stat"), str(tmp_path / "top3"), str(tmp_path / "state"), NOW, **options
    )
    query.awaitTermination()
    return query


def expected_stat(spark, feed, blacklist):
    clicks = ads.drop_blacklisted(ads.parse_ad_log(log(spark, *feed.lines)), blacklist)
    return ads.ad_stat(clicks)


def test_running_counts_and_top3_over_batches_and_restarts(spark, feed, tmp_path):
    blacklist = spark.createDataFrame([(3,), (4,)], schemas.AD_BLACKLIST)
    day = 24 * 60
    for seed in range(3):
        # Days overlap between files, so later batches change counts of earlier ones.
        feed.add(*random_lines(seed, 60, (seed * day / 2, seed * day / 2 + day)))
    query = run_stat(spark, feed, tmp_path, blacklist)
    assert query.lastProgress["batchId"] == 2

    def check():
        stat = expected_stat(spark, feed, blacklist)
        assert rows(stream.read_stat(spark, str(tmp_path / "stat"))) == rows(stat)
        top3 = ads.ad_province_top3(ads.province_ad_count(stat))
        got = stream.read_province_top3(spark, str(tmp_path / "top3"))
        assert rows(got) == rows(top3)

    check()
    run_stat(spark, feed, tmp_path, blacklist)  # nothing new
    check()
    feed.add(*random_lines(9, 40, (0, 2 * day)))
    run_stat(spark, feed, tmp_path, blacklist)
    check()


def test_counts_made_before_a_user_was_blacklisted_stay(spark, feed, tmp_path):
    nobody = spark.createDataFrame([], schemas.AD_BLACKLIST)
    feed.add(line(0, user=1), line(0, user=2))
    run_stat(spark, feed, tmp_path, nobody)
    feed.add(line(1, user=1), line(1, user=2))
    run_stat(spark, feed, tmp_path, spark.createDataFrame([(2,)], schemas.AD_BLACKLIST))
    assert rows(stream.read_stat(spark, str(tmp_path / "stat"))) == [("20240101", "p", "c", 1, 3)]


def test_stat_counts_clicks_however_late(spark, feed, tmp_path):
    day = 24 * 60
    for minute in (0, 10 * day, 11 * day, 1):
        feed.add(line(minute))
    nobody = spark.createDataFrame([], schemas.AD_BLACKLIST)
    run_stat(spark, feed, tmp_path, nobody)
    counts = {r[0]: r[4] for r in rows(stream.read_stat(spark, str(tmp_path / "stat")))}
    assert counts == {"20240101": 2, "20240111": 1, "20240112": 1}
    one = stream.read_stat(spark, str(tmp_path / "stat"), ["20240111"])
    assert rows(one) == [("20240111", "p", "c", 1, 1)]


def test_blacklist_is_read_in_every_batch(spark, feed, tmp_path):
    listed = str(tmp_path / "blacklist")
    spark.createDataFrame([(7,)], schemas.AD_BLACKLIST).write.parquet(listed)
    for minute in range(3):
        feed.add(line(minute, user=1), line(minute, user=2))
    seen = []

    def blacklist():
        # The list changes between two batches of one running query.
        seen.append(len(seen))
        if len(seen) == 2:
            users = spark.createDataFrame([(2,)], schemas.AD_BLACKLIST)
            users.write.mode("append").parquet(listed)
        return spark.read.schema(schemas.AD_BLACKLIST).parquet(listed)

    run_stat(spark, feed, tmp_path, blacklist)
    assert len(seen) == 3
    assert rows(stream.read_stat(spark, str(tmp_path / "stat")))[0][4] == 2 + 1 + 1


def run_trend(spark, feed, tmp_path, **options):
    stream.start_ad_click_trend(
        file_ad_log(spark, str(feed.path), max_files_per_trigger=1),
        str(tmp_path / "trend"), str(tmp_path / "trend-state"), NOW, **options
    ).awaitTermination()
    return stream.read_trend(spark, str(tmp_path / "trend"))


def test_trend_keeps_final_counts_per_minute(spark, feed, tmp_path):
    for start in (0, 5, 10):
        feed.add(*random_lines(start, 50, (start, start + 8)))
    expected = ads.ad_click_trend(ads.parse_ad_log(log(spark, *feed.lines)))
    assert rows(run_trend(spark, feed, tmp_path)) == rows(expected)


def test_trend_counts_every_click_in_any_order(spark, feed, tmp_path):
    lines = random_lines(4, 200, (0, 30 * 24 * 60))
    random.Random(1).shuffle(lines)
    for start in range(0, 200, 50):
        feed.add(*lines[start : start + 50])
    expected = ads.ad_click_trend(ads.parse_ad_log(log(spark, *feed.lines)))
    got = run_trend(spark, feed, tmp_path)
    assert sum(r[4] for r in rows(got)) == 200
    assert rows(got) == rows(expected)
    last = stream.read_last_hour(spark, str(tmp_path / "trend"))
    assert rows(last) == rows(ads.ad_click_trend_last_hour(expected))


def test_last_hour_reads_two_days_at_most(spark, feed, tmp_path):
    day = 24 * 60
    feed.add(line(0), line(5 * day - 10), line(5 * day + 20))
    run_trend(spark, feed, tmp_path)
    last = stream.read_last_hour(spark, str(tmp_path / "trend"))
    assert [r[:3] for r in rows(last)] == [("2024-01-05", "23", "50"), ("2024-01-06", "00", "20")]
    assert "PushedFilters: [In(date, [2024-01-05,2024-01-06])" in plan(last)
    # Days of merged batches are folders, and only those needed are listed.
    merge(spark, str(tmp_path / "trend"), stream._TREND, schemas.AD_CLICK_TREND_KEYS, 1, 1)
    merged = stream.read_last_hour(spark, str(tmp_path / "trend"))
    assert rows(merged) == rows(last)
    assert {f.split("date=")[1][:10] for f in merged.inputFiles()} == {"2024-01-05", "2024-01-06"}


def test_trend_can_leave_out_blacklisted_users(spark, feed, tmp_path):
    feed.add(line(0, user=1), line(0, user=2))
    listed = spark.createDataFrame([(2,)], schemas.AD_BLACKLIST)
    assert rows(run_trend(spark, feed, tmp_path, blacklist=listed))[0][4] == 1


@pytest.mark.parametrize("size, slide", [(3600, 600), (1500, 600), (600, 600)])
def test_sliding_windows_from_streamed_panes(spark, feed, tmp_path, size, slide):
    for start in (60, 0, 30):
        feed.add(*random_lines(start, 50, (start, start + 50)))
    stream.start_ad_click_panes(
        file_ad_log(spark, str(feed.path), max_files_per_trigger=1),
        str(tmp_path / "panes"), str(tmp_path / "pane-state"), size, slide, NOW,
    ).awaitTermination()
    got = ads.ad_click_sliding(stream.read_panes(spark, str(tmp_path / "panes")), size, slide)
    clicks = ads.parse_ad_log(log(spark, *feed.lines))
    expected = clicks.groupBy(
        F.window("ts", f"{size} seconds", f"{slide} seconds").alias("w"), "ad_id"
    ).count().select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss"),
        F.date_format("w.end", "yyyy-MM-dd HH:mm:ss"), "ad_id", "count",
    )
    assert rows(got) == rows(expected)


LAYOUT = "date string, ad_id bigint, click_count bigint"
KEYS = ("date", "ad_id")


def counts(spark, *values):
    return spark.createDataFrame(list(values), LAYOUT)


def current(spark, path, **options):
    return rows(read_counts(spark, str(path), schemas.layout(LAYOUT), KEYS, **options))


def test_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    first = counts(spark, ("d1", 1, 5), ("d1", 2, 1), ("d2", 1, 1))
    second = counts(spark, ("d1", 1, 3))
    for batch_id, batch in ((0, first), (1, second), (1, second), (0, first)):
        write_counts(batch, path, batch_id)
    assert current(spark, path) == [("d1", 1, 8), ("d1", 2, 1), ("d2", 1, 1)]
    # A repetition that no longer touches a day leaves nothing of the first attempt.
    write_counts(counts(spark, ("d1", 1, 5)), path, 0)
    assert current(spark, path) == [("d1", 1, 8)]
    write_counts(counts(spark).where("false"), path, 1)
    assert current(spark, path) == [("d1", 1, 5)]
    assert batch_days(spark, path, 0) == ["d1"] and batch_days(spark, path, 1) == []


def merged_by_hand(batches):
    total = {}
    for batch in batches:
        for day, ad, n in batch:
            total[day, ad] = total.get((day, ad), 0) + n
    return sorted((*key, n) for key, n in total.items())


def random_batches(n):
    draw = random.Random(5)
    return [[(f"d{draw.randint(0, 2)}", ad, draw.randint(1, 9)) for ad in range(3)]
            for _ in range(n)]


def test_merges_keep_counts_and_few_folders(spark, tmp_path):
    path, layout = tmp_path / "t", schemas.layout(LAYOUT)
    batches = random_batches(8)
    for batch_id, batch in enumerate(batches):
        for _ in range(2):  # every batch is repeated, also after the merge
            write_counts(counts(spark, *batch), str(path), batch_id)
            merge(spark, str(path), layout, KEYS, batch_id, max_batches=2)
            assert current(spark, path) == merged_by_hand(batches[: batch_id + 1])
    assert len(list(path.glob("live/batch_id=*"))) <= 5
    assert all_days(spark, str(path)) == ["d0", "d1", "d2"]


def test_merge_that_stops_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    path, layout = tmp_path / "t", schemas.layout(LAYOUT)
    batches = random_batches(6)
    for batch_id, batch in enumerate(batches):
        write_counts(counts(spark, *batch), str(path), batch_id)
        if batch_id == 3:
            merge(spark, str(path), layout, KEYS, batch_id, max_batches=2)
    want = merged_by_hand(batches)

    def stop(folder):
        raise OSError("lost connection")

    # While the base is written: its folder is there, but not complete.
    half = path / "base" / "upto=4"
    (half / "date=d0").mkdir(parents=True)
    assert current(spark, path) == want
    # After it, at the first and at a later deletion.
    with pytest.raises(OSError, match="lost"):
        merge(spark, str(path), layout, KEYS, 5, max_batches=2, delete=stop)
    assert current(spark, path) == want
    write_counts(counts(spark, ("d0", 0, 1)), str(path), 6)
    batches.append([("d0", 0, 1)])
    calls = []

    def later(folder):
        calls.append(folder)
        if len(calls) == 2:
            stop(folder)
        keyed.delete_folder(spark, folder)

    with pytest.raises(OSError, match="lost"):
        merge(spark, str(path), layout, KEYS, 6, max_batches=1, delete=later)
    assert current(spark, path) == merged_by_hand(batches)
    merge(spark, str(path), layout, KEYS, 7, max_batches=1)
    assert current(spark, path) == merged_by_hand(batches)


def test_reader_open_during_a_merge(spark, tmp_path):
    path, layout = str(tmp_path / "t"), schemas.layout(LAYOUT)
    batches = random_batches(7)
    for batch_id, batch in enumerate(batches[:6]):
        write_counts(counts(spark, *batch), path, batch_id)
        if batch_id == 3:
            merge(spark, path, layout, KEYS, batch_id, max_batches=2)
    opened = read_counts(spark, path, layout, KEYS)
    write_counts(counts(spark, *batches[6]), path, 6)
    merge(spark, path, layout, KEYS, 6, max_batches=2)
    assert rows(opened) == merged_by_hand(batches[:6])
    assert current(spark, path) == merged_by_hand(batches)


def test_one_hour_is_written_by_several_tasks(spark, tmp_path):
    path, layout = tmp_path / "t", schemas.layout(LAYOUT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch_id in range(2):
            batch = spark.range(50_000).selectExpr(
                "'d1' AS date", "id AS ad_id", "1L AS click_count")
            write_counts(batch.groupBy("date", "ad_id").agg(
                F.sum("click_count").alias("click_count")), str(path), batch_id)
        merge(spark, str(path), layout, KEYS, 2, max_batches=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(path.glob("live/batch_id=1/*.parquet"))) > 2
    assert len(list(path.glob("base/upto=1/date=d1/*.parquet"))) > 2
    assert current(spark, path)[0][2] == 2


def test_query_that_fails_between_its_writes_recovers(spark, feed, tmp_path, monkeypatch):
    blacklist = spark.createDataFrame([(3,)], schemas.AD_BLACKLIST)
    feed.add(*random_lines(1, 60, (0, 2000)))
    run_stat(spark, feed, tmp_path, blacklist)
    feed.add(*random_lines(2, 60, (0, 2000)))

    def fail(*_):
        raise OSError("lost connection")

    real = stream.update_province_top3
    monkeypatch.setattr(stream, "update_province_top3", fail)
    with pytest.raises(StreamingQueryException):
        run_stat(spark, feed, tmp_path, blacklist)
    monkeypatch.setattr(stream, "update_province_top3", real)
    feed.add(*random_lines(3, 60, (0, 2000)))
    run_stat(spark, feed, tmp_path, blacklist)
    stat = expected_stat(spark, feed, blacklist)
    assert rows(stream.read_stat(spark, str(tmp_path / "stat"))) == rows(stat)
    top3 = ads.ad_province_top3(ads.province_ad_count(stat))
    assert rows(stream.read_province_top3(spark, str(tmp_path / "top3"))) == rows(top3)


def test_running_query_merges_its_batches(spark, feed, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MAX_LIVE_BATCHES", 2)
    nobody = spark.createDataFrame([], schemas.AD_BLACKLIST)
    for seed in range(6):
        feed.add(*random_lines(seed, 40, (0, 1400)))
    run_stat(spark, feed, tmp_path, nobody)
    assert list((tmp_path / "stat").glob("city/base/upto=*"))
    stat = expected_stat(spark, feed, nobody)
    assert rows(stream.read_stat(spark, str(tmp_path / "stat"))) == rows(stat)
    top3 = ads.ad_province_top3(ads.province_ad_count(stat))
    assert rows(stream.read_province_top3(spark, str(tmp_path / "top3"))) == rows(top3)
