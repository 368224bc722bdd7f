"""Category popularity and the most active sessions per category."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrail import constants as C
from shoptrail import schemas
from shoptrail.functions.strings import split_ids


def _click(column: str = "click_category_id") -> Column:
    return F.array_compact(F.array(F.col(column)))


def _listed(column: str) -> Column:
    ids = F.array_compact(split_ids(F.col(column)))
    return F.coalesce(ids, F.array().cast("array<bigint>"))


def _count_per_category(ids: DataFrame, name: str) -> DataFrame:
    return ids.groupBy("category_id").agg(F.count("*").alias(name))


def category_click_count(detail: DataFrame) -> DataFrame:
    clicks = detail.where(F.col("click_category_id").isNotNull())
    return _count_per_category(
        clicks.select(F.col("click_category_id").alias("category_id")), "click_count"
    )


def category_order_count(detail: DataFrame) -> DataFrame:
    orders = detail.where(F.col("order_category_ids").isNotNull())
    return _count_per_category(
        orders.select(F.explode(_listed("order_category_ids")).alias("category_id")),
        "order_count",
    )


def category_pay_count(detail: DataFrame) -> DataFrame:
    pays = detail.where(F.col("pay_category_ids").isNotNull())
    return _count_per_category(
        pays.select(F.explode(_listed("pay_category_ids")).alias("category_id")), "pay_count"
    )


def distinct_categories(detail: DataFrame) -> DataFrame:
    """Categories that were clicked, ordered or paid."""
    ids = F.concat(_click(), _listed("order_category_ids"), _listed("pay_category_ids"))
    return detail.select(F.explode(ids).alias("category_id")).distinct()


def category_counts(detail: DataFrame) -> DataFrame:
    """Click, order and pay counts of every category, in one pass and one shuffle."""

    def tagged(ids: Column, kind: str) -> Column:
        return F.transform(
            ids, lambda i: F.struct(i.alias("category_id"), F.lit(kind).alias("kind"))
        )

    uses = F.concat(
        tagged(_click(), "click"),
        tagged(_listed("order_category_ids"), "order"),
        tagged(_listed("pay_category_ids"), "pay"),
    )
    kind = F.col("kind")
    return (
        detail.select(F.inline(uses))
        .groupBy("category_id")
        .agg(
            F.count_if(kind == "click").alias("click_count"),
            F.count_if(kind == "order").alias("order_count"),
            F.count_if(kind == "pay").alias("pay_count"),
        )
    )


def top10_category(counts: DataFrame, task_id: int, n: int = C.TOP_CATEGORIES) -> DataFrame:
    """The ``n`` categories with most clicks, then orders, then pays."""
    return (
        counts.orderBy(
            F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id"
        )
        .limit(n)
        .withColumn("task_id", F.lit(task_id).cast("long"))
        .select(*schemas.TOP10_CATEGORY)
    )


def category_session_counts(detail: DataFrame) -> DataFrame:
    """Clicks per category and session."""
    return (
        detail.where(F.col("click_category_id").isNotNull())
        .groupBy(F.col("click_category_id").alias("category_id"), "session_id")
        .agg(F.count("*").alias("click_count"))
    )


def top10_category_session(
    detail: DataFrame, top_categories: DataFrame, task_id: int,
    n: int = C.TOP_SESSIONS_PER_CATEGORY,
) -> DataFrame:
    """The ``n`` sessions with most clicks in each top category.

    The top categories are a report of fixed length, so they are broadcast to thin out the
    actions before the shuffle; the rank limit then applies map-side as well.
    """
    wanted = F.broadcast(
        top_categories.select(F.col("category_id").alias("click_category_id"))
    )
    counts = category_session_counts(detail.join(wanted, "click_category_id", "left_semi"))
    by_clicks = Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    return (
        counts.withColumn("rank", F.row_number().over(by_clicks))
        .where(F.col("rank") <= n)
        .withColumn("task_id", F.lit(task_id).cast("long"))
        .select(*schemas.TOP10_CATEGORY_SESSION)
    )


def top10_session_detail(top_sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions of the top sessions, once per category a session leads.

    The sessions are a report of fixed length (categories x sessions), so they are broadcast onto
    the action table, which need not be narrowed to kept sessions.
    """
    return actions.join(F.broadcast(top_sessions.select("session_id")), "session_id")
