"""Column layouts of the input tables and of the result tables."""

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def layout(text: str) -> T.StructType:
    """Nullable columns from ``name type, name type``; needs no running session."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


USER_VISIT_ACTION = layout(
    "date string, user_id bigint, session_id string, page_id bigint, action_time string, "
    "search_keyword string, click_category_id bigint, click_product_id bigint, "
    "order_category_ids string, order_product_ids string, "
    "pay_category_ids string, pay_product_ids string, city_id bigint"
)
USER_INFO = layout(
    "user_id bigint, username string, name string, age int, "
    "professional string, city string, sex string"
)
PRODUCT_INFO = layout("product_id bigint, product_name string, extend_info string")
CITY_INFO = layout("city_id bigint, city_name string, area string")
TASK = layout(
    "task_id bigint, task_name string, create_time string, start_time string, "
    "finish_time string, task_type string, task_status string, task_param string"
)
AD_BLACKLIST = layout("user_id bigint")
AD_LOG = layout("value string")

SESSION_RANDOM_EXTRACT = (
    "task_id", "session_id", "start_time", "search_keywords", "click_category_ids",
)
SESSION_DETAIL = (
    "task_id", "user_id", "session_id", "page_id", "action_time", "search_keyword",
    "click_category_id", "click_product_id", "order_category_ids", "order_product_ids",
    "pay_category_ids", "pay_product_ids",
)
TOP10_CATEGORY = ("task_id", "category_id", "click_count", "order_count", "pay_count")
TOP10_CATEGORY_SESSION = ("task_id", "category_id", "session_id", "click_count")
PAGE_SPLIT_CONVERT_RATE = ("task_id", "convert_rate")
AREA_TOP3_PRODUCT = (
    "task_id", "area", "area_level", "product_id", "city_infos", "click_count",
    "product_name", "product_status",
)
AD_STAT_KEYS = ("date", "province", "city", "ad_id")
AD_PROVINCE_TOP3_KEYS = ("date", "province")
AD_CLICK_TREND_KEYS = ("date", "hour", "minute", "ad_id")
