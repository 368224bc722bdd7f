"""The shop's tables as views over the generic tables ``events``, ``customer``, ``part``,
``nation`` in a folder of parquet files (the mapping is described in FIXTURES.md).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The number in props, which is JSON text with this one field; a pattern is faster than a parser.
_K = r"""try_cast(regexp_extract(props, r'"k": *([0-9]+)', 1) AS BIGINT)"""

# Areas by n_nationkey % 7.
_AREAS = (
    "China North", "China East", "China South", "China Middle", "West North", "West South",
    "East North",
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")


def user_visit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = events(spark, sf_dir).selectExpr(
        "event_id",
        "user_id",
        "event_type",
        f"{_K} AS k",
        "trunc(CAST(ts AS DATE), 'MM') AS month",
        "hour(ts) * 3600 + minute(ts) * 60 + CAST(second(ts) AS INT) AS sod",
        "CASE user_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 240 ELSE 4800 END AS squeeze",
        "CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 30 END AS span",
        "day(ts) AS day",
    ).selectExpr("*", "(day - 1) div span AS blk", "sod div squeeze AS off")
    base = base.selectExpr(
        "*", "CAST(date_add(month, CAST(blk * span AS INT)) AS STRING) AS date"
    )
    return base.selectExpr(
        "date",
        "user_id",
        "concat(user_id, '-', blk) AS session_id",
        "k % 10 AS page_id",
        "concat(date, ' ', (user_id * 7 + blk) % 23, ':', lpad(CAST(off div 60 AS STRING), 2, '0'),"
        " ':', lpad(CAST(off % 60 AS STRING), 2, '0')) AS action_time",
        "CASE WHEN event_type = 'view' THEN concat('kw', k % 10) END AS search_keyword",
        "CASE WHEN event_type = 'click' THEN k END AS click_category_id",
        "CASE WHEN event_type = 'click' THEN 1 + (event_id * 7 + k) % 100 END AS click_product_id",
        "CASE WHEN event_type = 'signup' THEN concat(k, ',', (k + event_id) % 100) END"
        " AS order_category_ids",
        "CASE WHEN event_type = 'signup' THEN CAST(1 + event_id % 100 AS STRING) END"
        " AS order_product_ids",
        "CASE WHEN event_type = 'purchase' THEN CAST(k AS STRING) END AS pay_category_ids",
        "CASE WHEN event_type = 'purchase' THEN CAST(1 + event_id % 100 AS STRING) END"
        " AS pay_product_ids",
        "(user_id + k) % 25 AS city_id",
        "event_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a registered user."""
    return _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "concat('user', c_custkey) AS username",
        "c_name AS name",
        "CAST(c_custkey * 37 % 60 AS INT) AS age",
        "concat('professional', c_custkey % 10) AS professional",
        "concat('city', c_nationkey) AS city",
        "CASE c_custkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS sex",
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a listed product."""
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        "concat('{\"product_status\": ', p_partkey % 2, '}') AS extend_info",
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = ", ".join(f"'{area}'" for area in _AREAS)
    return _read(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS city_id",
        "n_name AS city_name",
        f"element_at(array({areas}), CAST(n_nationkey % {len(_AREAS)} AS INT) + 1) AS area",
    )


def ad_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad log lines from click and view events."""
    shown = events(spark, sf_dir).where(F.col("event_type").isin("click", "view")).selectExpr(
        "unix_millis(CAST(ts AS TIMESTAMP)) AS millis",
        "user_id",
        f"{_K} % 12 AS ad_id",
        "(user_id + event_id) % 25 AS city",
    )
    nation = _read(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS city", "n_regionkey AS province"
    )
    return shown.join(nation, "city").selectExpr(
        "concat_ws(' ', millis, concat('prov', province), concat('city', city), user_id, ad_id)"
        " AS value"
    )


def ad_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one market segment are blacklisted."""
    return (
        _read(spark, sf_dir, "customer")
        .where("c_mktsegment = 'MACHINERY'")
        .selectExpr("c_custkey AS user_id")
    )


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per customer; some conditions are missing for some market segments."""
    return _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS task_id",
        "concat('task of ', c_name) AS task_name",
        "'2024-01-31 00:00:00' AS create_time",
        "CAST(NULL AS STRING) AS start_time",
        "CAST(NULL AS STRING) AS finish_time",
        "lower(c_mktsegment) AS task_type",
        "'created' AS task_status",
        "concat('{\"startDate\":[\"2024-01-01\"],\"endDate\":[\"2024-01-31\"]',"
        " CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat("
        "',\"startAge\":[\"', c_custkey % 30, '\"],\"endAge\":[\"', c_custkey % 30 + 20, '\"]')"
        " END,"
        " CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE concat("
        "',\"cities\":[\"city', c_nationkey, ',city1\"],\"sex\":[\"male\",\"female\"]')"
        " END,"
        " CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ',\"keywords\":[]' ELSE"
        " ',\"keywords\":[\"kw1,kw2\"]' END,"
        " ',\"targetPageFlow\":[\"1,2,3,4\"]}') AS task_param",
    )
