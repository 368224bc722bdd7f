from contextlib import nullcontext
from pathlib import Path
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from shoptrail import schemas
from shoptrail.operators import sessions
from shoptrail.params import TaskParams
from shoptrail.functions.json import get_param
from shoptrail.session import materialize, new_folder, scratch, shared_dir
from shoptrail.sinks.tables import (
    append,
    append_jdbc,
    read_report,
    replace_groups,
    replace_task,
    save_actions,
)
from shoptrail.sources import jdbc, streams, tables
from tests.helpers import action, actions, final_plan, plan, rows

RANGE = TaskParams(start_date="2024-01-02", end_date="2024-01-03")


def dated(spark):
    return actions(spark, *[
        action(f"s{day}", date=f"2024-01-0{day}", click_product_id=p)
        for day in (1, 2, 3, 4) for p in (7, None)
    ])


def test_date_range_is_inclusive(spark):
    got = tables.actions_by_date_range(dated(spark), RANGE)
    assert {r["date"] for r in got.collect()} == {"2024-01-02", "2024-01-03"}
    clicks = tables.click_actions_by_date(dated(spark), RANGE)
    assert rows(clicks) == [(1, 7), (1, 7)]


def test_a_missing_date_leaves_its_end_open(spark):
    def days(**bounds):
        got = tables.actions_by_date_range(dated(spark), TaskParams(**bounds)).collect()
        return {int(r["date"][-1]) for r in got}

    assert days() == {1, 2, 3, 4}
    assert days(start_date="2024-01-03") == {3, 4}
    assert days(end_date="2024-01-03") == {1, 2, 3}


def test_empty_parameters_are_absent(spark):
    names = ("startDate", "startAge", "endAge", "professionals", "cities", "sex", "keywords",
             "categoryIds", "targetPageFlow")
    empty = "{" + ", ".join(f'"{name}": [""]' for name in names) + "}"
    assert TaskParams.from_json(empty) == TaskParams()
    df = spark.createDataFrame([(empty,)], "p string")
    assert df.select(get_param(F.col("p"), "keywords")).first()[0] is None


def test_dates_prune_folders_and_columns(spark):
    save_actions(dated(spark), "actions_by_date")
    tables.register_views({"recent": tables.table(spark, "actions_by_date")})
    clicks = tables.click_actions_by_date(tables.table(spark, "recent"), RANGE)
    text = plan(clicks)
    assert "PartitionFilters: [isnotnull(date" in text
    assert "PushedFilters: [IsNotNull(click_product_id)]" in text
    assert "ReadSchema: struct<click_product_id:bigint,city_id:bigint>" in text
    assert clicks.count() == 2


def test_bucketed_actions_need_no_shuffle(spark):
    save_actions(dated(spark), "actions_bucketed", buckets=4)
    stored = tables.table(spark, "actions_bucketed")
    aggregated = sessions.session_aggregate(stored)
    assert "Exchange" not in final_plan(aggregated)
    kept = aggregated.where(F.col("step_length") > 1).hint("merge")
    assert "Exchange" not in final_plan(sessions.session_detail(stored, kept))


def test_task_lookup(spark):
    tasks = spark.createDataFrame(
        [(3, "t", "", "", "", "", "", '{"startDate":["2024-01-01","x"],"endAge":["30"],'
          '"keywords":["a,b"],"sex":[],"targetPageFlow":["1,2"]}')],
        schemas.TASK,
    )
    assert tables.find_task(tasks, 3) == TaskParams(
        start_date="2024-01-01", end_age=30, keywords=("a", "b"), target_page_flow=(1, 2)
    )
    with pytest.raises(LookupError, match="no task with id 4"):
        tables.find_task(tasks, 4)


def _options(calls):
    return {key: value for call in calls for key, value in call.kwargs.items()}


def test_jdbc_read_options():
    # No database runs here: only what is handed to Spark's own reader is checked.
    spark = MagicMock()
    jdbc.read_jdbc(spark, "jdbc:x:y", "city_info", "u", "p", driver="d",
                   split_by=("city_id", 0, 100, 4))
    spark.read.format.assert_called_with("jdbc")
    options = _options(spark.read.format.return_value.options.call_args_list)
    assert options == {
        "url": "jdbc:x:y", "dbtable": "city_info", "user": "u", "password": "p",
        "driver": "d", "fetchsize": "10000", "partitionColumn": "city_id", "lowerBound": "0",
        "upperBound": "100", "numPartitions": "4",
    }


def test_jdbc_write_options():
    df = MagicMock()
    append_jdbc(df, "jdbc:x:y", "ad_stat", "u", "p", batch_size=50, connections=3)
    options = _options(
        df.write.format.return_value.mode.return_value.options.call_args_list
    )
    assert options["batchsize"] == "50"
    assert options["numPartitions"] == "3"
    df.write.format.return_value.mode.assert_called_with("append")


def test_kafka_options(spark):
    reader = MagicMock()
    session = MagicMock()
    session.readStream.format.return_value = reader
    reader.option.return_value = reader
    streams.kafka_ad_log(session, "a:1,b:2", "ads,more", "earliest", 1000)
    assert {call.args[0]: call.args[1] for call in reader.option.call_args_list} == {
        "kafka.bootstrap.servers": "a:1,b:2", "subscribe": "ads,more",
        "startingOffsets": "earliest", "maxOffsetsPerTrigger": 1000,
    }


def test_append_and_replace(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (1, "b")], "task_id long, v string")
    two = spark.createDataFrame([(2, "c")], "task_id long, v string")
    added = str(tmp_path / "added")
    append(one, added)
    append(two, added)
    assert spark.read.parquet(added).count() == 3

    replaced = str(tmp_path / "replaced")
    for df in (one, two, one.limit(1), one.limit(1)):
        replace_groups(df, replaced, "task_id")
    got = spark.read.parquet(replaced)
    assert sorted(r["task_id"] for r in got.collect()) == [1, 2]


def test_a_task_is_replaced_also_by_nothing(spark, tmp_path):
    path = str(tmp_path / "report")
    one = spark.createDataFrame([(1, "a"), (1, "b")], "task_id long, v string")
    replace_task(one, path, 1)
    replace_task(one.withColumn("task_id", F.lit(2)), path, 2)
    replace_task(one.where("false"), path, 1)
    got = read_report(spark, path)
    assert got.dtypes == [("task_id", "bigint"), ("v", "string")]
    assert rows(got) == [(2, "a"), (2, "b")]


def test_scratch_folders_go_also_on_failure(spark):
    for fail in (False, True):
        with pytest.raises(ZeroDivisionError) if fail else nullcontext():
            with scratch(spark, "job") as folder:
                assert materialize(spark.range(3), "part", folder).count() == 3
                assert Path(folder).exists()
                1 / (not fail)
        assert not Path(folder).exists()


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    assert new_folder(spark, "x").startswith(folder)
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_a_cluster_without_a_shared_folder_is_refused():
    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(spark)


def test_materialize_cuts_the_plan(spark):
    df = materialize(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count(), "t")
    assert "Aggregate" not in plan(df)
    assert rows(df) == [(0, 5), (1, 5)]
