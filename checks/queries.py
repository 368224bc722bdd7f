"""Every operator as a query over the views of ``shoptrail.sources.warehouse``."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrail import schemas
from shoptrail.functions import aggregates, datetimes, json, numbers, predicates, strings
from shoptrail.operators import (
    ads,
    bitmaps,
    categories,
    heavy,
    membership,
    pages,
    products,
    sampling,
    sessions,
)
from shoptrail.params import TaskParams
from shoptrail.session import configure, materialize, new_folder
from shoptrail.sinks.blacklist import PinnedBlacklist, insert_new, read_version
from shoptrail.sinks.keyed import merge, read_counts, write_counts
from shoptrail.sources import streams, tables, warehouse
from shoptrail.streaming import ads as stream

TASK_ID = 1
SEED = 7
FLOW = (1, 2, 3, 4)

# The task of all session reports.
TASK = TaskParams(
    start_date="2024-01-01",
    end_date="2024-01-31",
    start_age=5,
    end_age=50,
    professionals=tuple(f"professional{i}" for i in (0, 1, 2, 4, 5, 6, 7, 9)),
    keywords=("kw0", "kw1", "kw2", "kw3", "kw5", "kw7", "kw8", "kw9"),
    target_page_flow=FLOW,
)

# A task that sets every condition.
NARROW_TASK = TaskParams(
    start_date="2024-01-01",
    end_date="2024-01-31",
    start_age=2,
    end_age=57,
    professionals=tuple(f"professional{i}" for i in range(8)),
    cities=tuple(f"city{i}" for i in range(20)),
    sex="male",
    keywords=("kw1", "kw2", "kw3", "kw4", "kw5", "kw6"),
    category_ids=tuple(str(i) for i in range(5, 70)),
)

# A date range that leaves out days at both ends.
RANGE_TASK = TaskParams(start_date="2024-01-02", end_date="2024-01-21")

# Clicks from this instant on arrive after the stored statistics were taken.
UPDATE_FROM = "2024-01-16 12:00:00"

NOW = {"availableNow": True}

LOG_FILES = 4


class Shop:
    """The tables of one folder and the intermediate results that queries build on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def _view(self, build) -> DataFrame:
        return build(self.spark, self.sf_dir)

    @cached_property
    def all_actions(self) -> DataFrame:
        return self._view(warehouse.user_visit_action)

    @cached_property
    def actions(self) -> DataFrame:
        return tables.actions_by_date_range(self.all_actions, TASK)

    @cached_property
    def users(self) -> DataFrame:
        return self._view(warehouse.user_info)

    @cached_property
    def products(self) -> DataFrame:
        return self._view(warehouse.product_info)

    @cached_property
    def cities(self) -> DataFrame:
        return self._view(warehouse.city_info)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.session_aggregate(self.actions)

    @cached_property
    def full_sessions(self) -> DataFrame:
        return sessions.session_full_aggr(self.sessions, self.users)

    @cached_property
    def kept_sessions(self) -> DataFrame:
        return sessions.session_filter(self.full_sessions, TASK)

    @cached_property
    def detail(self) -> DataFrame:
        return sessions.session_detail(self.actions, self.kept_table)

    @cached_property
    def kept_table(self) -> DataFrame:
        """The kept sessions, stored for the detail join and for queries that use them twice."""
        return materialize(self.kept_sessions, "sessions")

    @cached_property
    def detail_table(self) -> DataFrame:
        """Their actions, stored for queries that use them more than once."""
        return materialize(self.detail, "session-detail")

    @cached_property
    def extracted(self) -> DataFrame:
        return sampling.random_extract_session(self.kept_table, TASK_ID, SEED)

    @cached_property
    def category_counts(self) -> DataFrame:
        return categories.category_counts(self.detail)

    @cached_property
    def top_sessions(self) -> DataFrame:
        detail = self.detail_table
        top = categories.top10_category(categories.category_counts(detail), TASK_ID)
        return categories.top10_category_session(detail, top, TASK_ID)

    @cached_property
    def page_views(self) -> DataFrame:
        return pages.page_views(self.actions, tie=("event_id",))

    @cached_property
    def clicks(self) -> DataFrame:
        return tables.click_actions_by_date(self.all_actions, TASK)

    @cached_property
    def area_counts(self) -> DataFrame:
        return products.area_product_click_count(self.clicks, self.cities)

    @cached_property
    def full_products(self) -> DataFrame:
        return products.area_full_product(self.area_counts, self.products)

    @cached_property
    def ad_clicks(self) -> DataFrame:
        return ads.parse_ad_log(self._view(warehouse.ad_log))

    @cached_property
    def blacklist(self) -> DataFrame:
        return self._view(warehouse.ad_blacklist)

    @cached_property
    def allowed_clicks(self) -> DataFrame:
        return ads.drop_blacklisted(self.ad_clicks, self.blacklist)

    def log_stream(self) -> DataFrame:
        """The whole ad log in LOG_FILES text files of mixed order, one per micro-batch."""
        folder = new_folder(self.spark, "ad-log")
        log = self._view(warehouse.ad_log)
        log.repartition(LOG_FILES, F.xxhash64("value")).write.text(folder)
        return streams.file_ad_log(self.spark, folder, max_files_per_trigger=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Shop], DataFrame]):
    """Register a query under its function name."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Shop(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


# Session analysis


@query
def actions_by_date_range(shop: Shop) -> DataFrame:
    return tables.actions_by_date_range(shop.all_actions, RANGE_TASK)


@query
def session_aggregate(shop: Shop) -> DataFrame:
    return shop.sessions


@query
def session_full_aggr(shop: Shop) -> DataFrame:
    return shop.full_sessions


@query
def session_filter(shop: Shop) -> DataFrame:
    return sessions.session_filter(shop.full_sessions, NARROW_TASK)


@query
def session_aggr_counts(shop: Shop) -> DataFrame:
    return sessions.session_aggr_counts(shop.kept_sessions)


@query
def session_aggr_stat(shop: Shop) -> DataFrame:
    return sessions.session_aggr_stat(shop.kept_sessions, TASK_ID)


@query
def session_aggr_stat_observed(shop: Shop) -> DataFrame:
    """The statistics as a side effect of writing the kept sessions."""
    watched, seen = sessions.observe_session_counts(shop.kept_sessions)
    materialize(watched, "sessions")
    return sessions.aggr_stat_of(sessions.observed_counts(shop.spark, seen), TASK_ID)


@query
def session_category_bitmap(shop: Shop) -> DataFrame:
    """The clicked categories of every session from a bitmap, and a test on its bits."""
    actions = shop.actions
    codes = materialize(bitmaps.dictionary(actions, "click_category_id"), "category-codes")
    sets = materialize(
        bitmaps.set_bitmaps(actions, "session_id", "click_category_id", codes, "categories"),
        "category-sets",
    )
    listed = bitmaps.values_of(sets, "session_id", "categories", codes).groupBy("session_id").agg(
        aggregates.group_concat_distinct(F.col("value")).alias("click_category_ids")
    )
    wanted = bitmaps.codes_of(codes, NARROW_TASK.category_ids)
    hit = predicates.flag(bitmaps.any_in_bitmap(F.col("categories"), wanted))
    return sets.select("session_id", hit.alias("in_list")).join(listed, "session_id")


@query
def session_detail(shop: Shop) -> DataFrame:
    return sessions.as_session_detail(shop.detail, TASK_ID)


@query
def sessions_per_date_hour(shop: Shop) -> DataFrame:
    return sampling.sessions_per_date_hour(shop.kept_sessions)


@query
def extract_quota(shop: Shop) -> DataFrame:
    return sampling.extract_quota(shop.kept_sessions)


@query
def random_extract_session(shop: Shop) -> DataFrame:
    return shop.extracted


@query
def random_extract_detail(shop: Shop) -> DataFrame:
    detail = sampling.random_extract_detail(shop.extracted, shop.actions)
    return sessions.as_session_detail(detail, TASK_ID)


@query
def distinct_categories(shop: Shop) -> DataFrame:
    return categories.distinct_categories(shop.detail)


@query
def category_click_count(shop: Shop) -> DataFrame:
    return categories.category_click_count(shop.detail)


@query
def category_order_count(shop: Shop) -> DataFrame:
    return categories.category_order_count(shop.detail)


@query
def category_pay_count(shop: Shop) -> DataFrame:
    return categories.category_pay_count(shop.detail)


@query
def category_counts(shop: Shop) -> DataFrame:
    return shop.category_counts


@query
def top10_category(shop: Shop) -> DataFrame:
    return categories.top10_category(shop.category_counts, TASK_ID)


@query
def category_session_counts(shop: Shop) -> DataFrame:
    return categories.category_session_counts(shop.detail)


@query
def top10_category_session(shop: Shop) -> DataFrame:
    return shop.top_sessions


@query
def top10_session_detail(shop: Shop) -> DataFrame:
    detail = categories.top10_session_detail(shop.top_sessions, shop.actions)
    return sessions.as_session_detail(detail, TASK_ID)


@query
def task_params(shop: Shop) -> DataFrame:
    return tables.task_params(warehouse.task(shop.spark, shop.sf_dir))


@query
def task_params_variant(shop: Shop) -> DataFrame:
    return tables.task_params_variant(warehouse.task(shop.spark, shop.sf_dir))


# Page conversion


@query
def start_page_pv(shop: Shop) -> DataFrame:
    return pages.start_page_pv(shop.actions, FLOW)


@query
def page_split_match(shop: Shop) -> DataFrame:
    return pages.page_split_match(shop.page_views, FLOW)


@query
def page_split_pv(shop: Shop) -> DataFrame:
    return pages.page_split_pv(shop.page_views, FLOW)


@query
def page_convert_rate(shop: Shop) -> DataFrame:
    return pages.page_convert_rate(shop.page_views, FLOW)


@query
def page_split_convert_rate(shop: Shop) -> DataFrame:
    return pages.page_split_convert_rate(
        pages.page_convert_rate(shop.page_views, FLOW), TASK_ID
    )


# Products per area


@query
def click_actions_by_date(shop: Shop) -> DataFrame:
    return tables.click_actions_by_date(shop.all_actions, RANGE_TASK)


@query
def click_product_basic(shop: Shop) -> DataFrame:
    return products.click_product_basic(shop.clicks, shop.cities)


@query
def area_product_click_count(shop: Shop) -> DataFrame:
    return shop.area_counts


@query
def group_concat_distinct(shop: Shop) -> DataFrame:
    city = strings.concat_long_string(F.col("city_id"), F.col("city_name"), F.lit(":"))
    basic = products.click_product_basic(shop.clicks, shop.cities)
    return basic.groupBy("product_id").agg(
        aggregates.group_concat_distinct(city).alias("city_infos")
    )


@query
def area_full_product(shop: Shop) -> DataFrame:
    return shop.full_products


@query
def area_top3_product(shop: Shop) -> DataFrame:
    return products.area_top3_product(shop.full_products, TASK_ID)


@query
def salted_count(shop: Shop) -> DataFrame:
    return products.salted_count(shop.clicks, ["product_id"], ["city_id"])


@query
def salted_count_skewed(shop: Shop) -> DataFrame:
    """Views and visiting sessions of every page; a page has about a tenth of all actions."""
    actions = shop.all_actions.select("page_id", "session_id")
    tasks = 4 * int(shop.spark.conf.get("spark.sql.shuffle.partitions"))
    share = heavy.fair_share(actions.count(), tasks)
    return heavy.salted_count_skewed(actions, "page_id", "session_id", share)


# Ad statistics; those named in the stream section run as streams over the events table


@query
def parse_ad_log(shop: Shop) -> DataFrame:
    clicks = shop.ad_clicks
    return clicks.withColumn("millis", F.unix_millis("ts")).drop("ts")


@query
def ad_blacklist_filter(shop: Shop) -> DataFrame:
    clicks = shop.allowed_clicks
    return clicks.withColumn("millis", F.unix_millis("ts")).drop("ts")


@query
def ad_blacklist_large(shop: Shop) -> DataFrame:
    """The same by a bitmap filter, as for lists too long to broadcast."""
    clicks = membership.filtered_anti_join(shop.ad_clicks, shop.blacklist, "user_id")
    return clicks.withColumn("millis", F.unix_millis("ts")).drop("ts")


@query
def ad_blacklist_insert(shop: Shop) -> DataFrame:
    """The blacklist after three inserts that overlap."""
    path = new_folder(shop.spark, "blacklist")
    for users in (shop.blacklist.where("user_id % 3 < 2"), shop.blacklist, shop.blacklist):
        insert_new(shop.spark, path, users)
    return read_version(shop.spark, path)


@query
def province_ad_count(shop: Shop) -> DataFrame:
    return ads.province_ad_count(ads.ad_stat(shop.allowed_clicks))


def _upserted(shop: Shop, clicks: DataFrame, count, keys) -> DataFrame:
    """Stored counts as of UPDATE_FROM, brought up to date with the clicks since."""
    since = F.col("ts") >= F.to_timestamp(F.lit(UPDATE_FROM))
    path = new_folder(shop.spark, "counts")
    for batch_id, part in enumerate((clicks.where(~since), clicks.where(since))):
        write_counts(count(part), path, batch_id)
    schema = schemas.layout(", ".join([*(f"{k} {'bigint' if k == 'ad_id' else 'string'}"
                                         for k in keys), "click_count bigint"]))
    merge(shop.spark, path, schema, keys, running=1, max_batches=1)
    return read_counts(shop.spark, path, schema, keys)


@query
def upsert_ad_stat(shop: Shop) -> DataFrame:
    return _upserted(shop, shop.allowed_clicks, ads.ad_stat, schemas.AD_STAT_KEYS)


@query
def upsert_ad_click_trend(shop: Shop) -> DataFrame:
    return _upserted(shop, shop.ad_clicks, ads.ad_click_trend, schemas.AD_CLICK_TREND_KEYS)


# Streams over the ad log in several files of mixed order, one file per micro-batch


def _stat_stream(shop: Shop, top3: bool) -> str:
    folder = new_folder(shop.spark, "ad-stat")
    stream.start_ad_stat(
        shop.log_stream(), lambda: shop.blacklist, f"{folder}/stat",
        f"{folder}/top3" if top3 else None, f"{folder}/state", NOW,
    ).awaitTermination()
    return folder


@query
def ad_stat(shop: Shop) -> DataFrame:
    return stream.read_stat(shop.spark, f"{_stat_stream(shop, False)}/stat")


@query
def ad_stat_pinned(shop: Shop) -> DataFrame:
    """The statistics with a stored blacklist whose version each micro-batch records."""
    folder = new_folder(shop.spark, "ad-stat")
    insert_new(shop.spark, f"{folder}/blacklist", shop.blacklist)
    stream.start_ad_stat(
        shop.log_stream(), PinnedBlacklist(f"{folder}/blacklist", f"{folder}/pins"),
        f"{folder}/stat", None, f"{folder}/state", NOW,
    ).awaitTermination()
    return stream.read_stat(shop.spark, f"{folder}/stat")


@query
def ad_province_top3(shop: Shop) -> DataFrame:
    return stream.read_province_top3(shop.spark, f"{_stat_stream(shop, True)}/top3")


def _trend_stream(shop: Shop) -> str:
    folder = new_folder(shop.spark, "ad-trend")
    stream.start_ad_click_trend(
        shop.log_stream(), f"{folder}/trend", f"{folder}/state", NOW
    ).awaitTermination()
    return f"{folder}/trend"


@query
def ad_click_trend(shop: Shop) -> DataFrame:
    return stream.read_trend(shop.spark, _trend_stream(shop))


@query
def ad_click_trend_last_hour(shop: Shop) -> DataFrame:
    return stream.read_last_hour(shop.spark, _trend_stream(shop))


def _sliding(shop: Shop, size: int, slide: int) -> DataFrame:
    folder = new_folder(shop.spark, "ad-panes")
    stream.start_ad_click_panes(
        shop.log_stream(), f"{folder}/panes", f"{folder}/state", size, slide, NOW
    ).awaitTermination()
    panes = stream.read_panes(shop.spark, f"{folder}/panes")
    return ads.ad_click_sliding(panes, size, slide)


@query
def ad_click_sliding(shop: Shop) -> DataFrame:
    return _sliding(shop, 3600, 600)


@query
def ad_click_sliding_10s(shop: Shop) -> DataFrame:
    """Windows of 60 minutes every 10 seconds: each click is in 360 of them."""
    return _sliding(shop, 3600, 10)


# Scalar functions


@query
def scalar_datetime(shop: Shop) -> DataFrame:
    time, day = F.col("action_time"), F.concat("date", F.lit(" 12:00:00"))
    ts = datetimes.parse_time(time)
    key = datetimes.format_time_minute(ts)
    millis = F.unix_millis(ts) + 1
    gap = F.datediff(
        F.to_date(datetimes.today_date()), F.to_date(datetimes.yesterday_date())
    )
    return shop.all_actions.select(
        "event_id",
        datetimes.before(time, day).alias("is_before"),
        datetimes.after(time, day).alias("is_after"),
        datetimes.before(F.col("search_keyword"), day).alias("bad_is_before"),
        datetimes.minus(time, day).alias("minus_seconds"),
        datetimes.minus(F.col("search_keyword"), day).alias("bad_minus"),
        datetimes.date_hour(time).alias("date_hour"),
        gap.cast("long").alias("yesterday_gap"),
        datetimes.format_date(ts).alias("date_text"),
        datetimes.format_time(ts).alias("time_text"),
        datetimes.format_date_key(ts).alias("date_key"),
        datetimes.format_date(
            datetimes.parse_date_key(datetimes.format_date_key(ts))
        ).alias("date_back"),
        key.alias("minute_key"),
        datetimes.minute_key_date(key).alias("key_date"),
        datetimes.minute_key_hour(key).alias("key_hour"),
        datetimes.minute_key_minute(key).alias("key_minute"),
        datetimes.format_time(
            datetimes.millis_to_timestamp(millis.cast("string"))
        ).alias("millis_time"),
        datetimes.seconds_between(ts, datetimes.parse_time(day)).alias("visit_seconds"),
    )


@query
def scalar_strings(shop: Shop) -> DataFrame:
    ids = F.col("order_category_ids")
    word = F.col("search_keyword")
    padded = F.concat(F.lit(","), ids, F.lit(",,"))
    prefixed = strings.random_prefix(F.concat(F.lit("a_"), word), F.lit(5))
    drawn = F.split(prefixed, "_").getItem(0).try_cast("long")
    return shop.all_actions.select(
        "event_id",
        strings.is_empty(word).alias("no_word"),
        strings.is_not_empty(word).alias("has_word"),
        strings.trim_comma(padded).alias("trimmed"),
        strings.zero_pad(F.col("page_id").cast("string")).alias("padded"),
        F.element_at(strings.split_ids(ids), 1).alias("first_id"),
        F.element_at(strings.split_ids(ids), 2).alias("second_id"),
        strings.concat_long_string(F.col("city_id"), word, F.lit(":")).alias("city_word"),
        strings.remove_random_prefix(prefixed).alias("unprefixed"),
        drawn.between(0, 4).alias("prefix_in_range"),
        predicates.flag(predicates.any_in(ids, ["1", "7", "33"])).alias("in_list"),
        predicates.flag(predicates.between(F.col("page_id"), 2, 5)).alias("in_range"),
        predicates.flag(predicates.between(F.col("page_id"), 2, None)).alias("open_range"),
        predicates.flag(predicates.equal(word, "kw3")).alias("is_kw3"),
    )


@query
def scalar_json(shop: Shop) -> DataFrame:
    info = F.col("extend_info")
    return shop.products.select(
        "product_id",
        json.get_json_field(info, "product_status").alias("flag"),
        json.get_json_field(info, "missing").alias("missing"),
        products.product_status(info).alias("product_status"),
    )


@query
def scalar_round(shop: Shop) -> DataFrame:
    events = warehouse.events(shop.spark, shop.sf_dir)
    return events.select(
        "event_id",
        numbers.ratio(F.col("event_id"), F.col("user_id")).alias("id_ratio"),
        numbers.format_double(F.col("value"), 1).alias("one_decimal"),
        numbers.format_double(-F.col("value") / 7, 2).alias("two_decimals"),
        numbers.format_double(F.col("event_id") / F.lit(200.0), 2).alias("half_steps"),
        numbers.format_double(F.col("value"), 4).alias("four_decimals"),
    )
