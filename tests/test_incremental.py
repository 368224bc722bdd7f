"""The incremental ranking, versioned blacklists and batches that are repeated."""

import pytest
from pyspark.errors import StreamingQueryException

from shoptrail import schemas
from shoptrail.operators import ads
from shoptrail.sinks import blacklist as listing
from shoptrail.sinks.keyed import write_counts
from shoptrail.sinks.versions import drop_superseded, read_days, write_days
from shoptrail.sources.streams import file_ad_log
from shoptrail.streaming import ads as stream
from tests.helpers import plan, rows
from tests.test_ads import line
from tests.test_streams import Feed, expected_stat, random_lines, run_stat

DAY = 24 * 60
TOP3 = schemas.layout("date string, province string, ad_id bigint, click_count bigint")


@pytest.fixture
def feed(tmp_path):
    return Feed(tmp_path)


def nobody(spark):
    return spark.createDataFrame([], schemas.AD_BLACKLIST)


def test_an_ad_that_overtakes_late(spark, feed, tmp_path):
    for ad, n in ((1, 9), (2, 8), (3, 7), (4, 3)):
        feed.add(*[line(0, ad=ad)] * n)
    feed.add(*[line(0, ad=4)] * 5, line(DAY, ad=9))  # 8 in all: before ad 3, behind ad 2
    feed.add(*[line(1, ad=4)] * 2)
    run_stat(spark, feed, tmp_path, nobody(spark))
    got = rows(stream.read_province_top3(spark, str(tmp_path / "top3")))
    assert got == [("2024-01-01", "p", 1, 9), ("2024-01-01", "p", 2, 8),
                   ("2024-01-01", "p", 4, 10), ("2024-01-02", "p", 9, 1)]
    one = stream.read_province_top3(spark, str(tmp_path / "top3"), ["2024-01-02"])
    assert rows(one) == [("2024-01-02", "p", 9, 1)]


def test_ranking_of_random_batches(spark, feed, tmp_path):
    for seed in range(6):
        feed.add(*random_lines(seed, 80, (seed * 300, seed * 300 + 2 * DAY)))
    run_stat(spark, feed, tmp_path, nobody(spark))
    top3 = ads.ad_province_top3(ads.province_ad_count(expected_stat(spark, feed, nobody(spark))))
    assert rows(stream.read_province_top3(spark, str(tmp_path / "top3"))) == rows(top3)
    # A day is one folder per version, and few versions stay.
    folders = list((tmp_path / "top3").glob("live/batch_id=*/date=2024-01-02"))
    assert 0 < len(folders) <= 4
    assert not list((tmp_path / "top3").glob("live/*/*/province=*"))


def province_batch(spark, path, batch_id, *counts):
    df = spark.createDataFrame(list(counts), TOP3)
    write_counts(df, f"{path}/stat/province", batch_id)
    stream.update_province_top3(spark, f"{path}/stat", batch_id, f"{path}/top3")
    return rows(stream.read_province_top3(spark, f"{path}/top3"))


def test_replayed_batch_that_counts_less(spark, tmp_path):
    path = str(tmp_path)
    first = [("20240101", "p", ad, 10 * ad) for ad in (1, 2, 3)]
    province_batch(spark, path, 0, *first)
    got = province_batch(spark, path, 1, ("20240101", "p", 4, 100), ("20240102", "p", 1, 1))
    assert [r[2:] for r in got] == [(2, 20), (3, 30), (4, 100), (1, 1)]
    # The blacklist has grown before the replay: ad 4 got one click, and no click of the 2nd.
    got = province_batch(spark, path, 1, ("20240101", "p", 4, 1))
    assert [r[2:] for r in got] == [(1, 10), (2, 20), (3, 30)]
    got = province_batch(spark, path, 1)
    assert [r[2:] for r in got] == [(1, 10), (2, 20), (3, 30)]
    got = province_batch(spark, path, 2, ("20240101", "p", 1, 15), ("20240101", "q", 1, 1))
    assert [r[1:] for r in got] == [("p", 1, 25), ("p", 2, 20), ("p", 3, 30), ("q", 1, 1)]


def test_ranking_shuffles_touched_ads_only(spark, tmp_path):
    path = str(tmp_path)
    history = [("20240101", "p", ad, 1) for ad in range(500)]
    province_batch(spark, path, 0, *history)
    write_counts(spark.createDataFrame([("20240101", "p", 7, 5)], TOP3), f"{path}/stat/province", 1)
    touched = spark.read.schema(TOP3).parquet(f"{path}/stat/province/live/batch_id=1")
    keys = ["date", "province", "ad_id"]
    totals = stream.read_counts(spark, f"{path}/stat/province", TOP3, keys, ["20240101"]).join(
        touched.select(*keys), keys, "left_semi")
    steps = plan(totals)
    # Read from below: the semi-join stands between the scan and the sum.
    assert steps.index("HashAggregate") < steps.index("LeftSemi")
    assert rows(totals) == [("20240101", "p", 7, 6)]


def test_next_top3_ties_go_to_the_smaller_ad(spark):
    before = spark.createDataFrame([("d", "p", ad, 5) for ad in (2, 3, 4)], TOP3)
    touched = spark.createDataFrame([("d", "p", 1, 5), ("d", "p", 4, 6)], TOP3)
    assert rows(ads.next_top3(before, touched)) == [
        ("d", "p", 1, 5), ("d", "p", 2, 5), ("d", "p", 4, 6)]


def test_versions_of_days(spark, tmp_path):
    path = str(tmp_path / "v")

    def day(d, n):
        return spark.createDataFrame([(d, "p", 1, n)], TOP3)

    assert read_days(spark, path, TOP3).count() == 0
    for batch, (d, n) in enumerate([("a", 1), ("b", 2), ("a", 3), ("a", 4), ("a", 5)]):
        write_days(day(d, n), path, batch, [d])
    assert [r[3] for r in rows(read_days(spark, path, TOP3))] == [5, 2]
    assert [r[3] for r in rows(read_days(spark, path, TOP3, before=4))] == [4, 2]
    opened = read_days(spark, path, TOP3, before=4)
    drop_superseded(spark, path, 4, ["a", "b"])
    assert len(list((tmp_path / "v").glob("live/*/date=a"))) == 3
    assert [r[3] for r in rows(opened)] == [4, 2]
    assert [r[3] for r in rows(read_days(spark, path, TOP3))] == [5, 2]
    # A version that was not written to its end does not count.
    (tmp_path / "v/live/batch_id=9/date=a").mkdir(parents=True)
    assert [r[3] for r in rows(read_days(spark, path, TOP3))] == [5, 2]


def test_insert_new_users_only(spark, tmp_path):
    path = str(tmp_path / "list")
    users = spark.createDataFrame([(1,), (2,), (2,), (None,)], schemas.AD_BLACKLIST)
    assert listing.newest_version(spark, path) == -1
    assert listing.insert_new(spark, path, users) == 0
    assert listing.insert_new(spark, path, users) == 0
    assert listing.insert_new(spark, path, spark.range(1, 5).toDF("user_id")) == 1
    assert rows(listing.read_version(spark, path)) == [(1,), (2,), (3,), (4,)]
    assert rows(listing.read_version(spark, path, 0)) == [(1,), (2,)]
    assert listing.read_version(spark, path, -1).count() == 0
    # A writer that failed on its way left a folder that is not complete.
    (tmp_path / "list/version=2").mkdir()
    assert listing.newest_version(spark, path) == 1
    assert listing.insert_new(spark, path, spark.range(9, 10).toDF("user_id")) == 2


def test_replayed_batch_keeps_its_blacklist(spark, feed, tmp_path, monkeypatch):
    path, pins = str(tmp_path / "list"), str(tmp_path / "pins")
    listing.insert_new(spark, path, spark.createDataFrame([(3,)], schemas.AD_BLACKLIST))
    pinned = listing.PinnedBlacklist(path, pins)
    feed.add(line(0, user=1), line(0, user=2), line(0, user=3))
    run_stat(spark, feed, tmp_path, pinned)
    feed.add(line(1, user=1), line(1, user=2), line(1, user=3))

    def fail(*_):
        raise OSError("lost connection")

    real = stream.update_province_top3
    monkeypatch.setattr(stream, "update_province_top3", fail)
    with pytest.raises(StreamingQueryException):
        run_stat(spark, feed, tmp_path, pinned)
    monkeypatch.setattr(stream, "update_province_top3", real)
    # The list grows between the attempt and its repetition.
    listing.insert_new(spark, path, spark.createDataFrame([(2,)], schemas.AD_BLACKLIST))
    run_stat(spark, feed, tmp_path, pinned)
    assert rows(stream.read_stat(spark, str(tmp_path / "stat")))[0][4] == 4
    # The next batch reads the new list.
    feed.add(line(2, user=1), line(2, user=2), line(2, user=3))
    run_stat(spark, feed, tmp_path, pinned)
    assert rows(stream.read_stat(spark, str(tmp_path / "stat")))[0][4] == 5
    assert rows(stream.read_province_top3(spark, str(tmp_path / "top3")))[0][3] == 5
    left = sorted(p.name for p in (tmp_path / "pins").iterdir() if not p.name.startswith("."))
    assert left == ["batch_id=1.version=0", "batch_id=2.version=1"]


def test_batches_at_the_interval_of_the_trigger(spark, feed, tmp_path):
    feed.add(line(0))
    query = stream.start_ad_stat(
        file_ad_log(spark, str(feed.path), max_files_per_trigger=1), nobody(spark),
        str(tmp_path / "stat"), None, str(tmp_path / "state"), {"processingTime": "1 second"},
    )
    try:
        query.processAllAvailable()
        feed.add(line(1))
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(stream.read_stat(spark, str(tmp_path / "stat"))) == [("20240101", "p", "c", 1, 2)]
    assert stream.BATCH_INTERVAL == {"processingTime": "5 seconds"}
