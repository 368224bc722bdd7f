"""Page-to-page conversion along a page flow."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrail import schemas
from shoptrail.functions.datetimes import parse_time
from shoptrail.functions.numbers import ratio

PIECE_SECONDS = 600


def flow_splits(flow: Sequence[int]) -> list[str]:
    """Consecutive pairs of a page flow as ``prev_cur``, in step order."""
    return [f"{a}_{b}" for a, b in zip(flow, flow[1:], strict=False)]


def start_page_pv(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    return actions.where(F.col("page_id") == flow[0]).agg(F.count("*").alias("start_page_pv"))


def page_views(
    actions: DataFrame, tie: Sequence[str] = ("page_id",), piece_seconds: int = PIECE_SECONDS
) -> DataFrame:
    """Every action with the page seen just before it in its session (NULL for the first).

    Sessions are cut into pieces of time, so that one of any length, and the actions of no session
    at all, spread over many tasks. Inside a piece the previous page is a lag; the first view of a
    piece takes the last page of the session's piece before, found among the end rows only. The
    log is shuffled once; only end rows are shuffled again.
    """
    ties = list(dict.fromkeys([*tie, "page_id"]))
    order = ["action_ts", *ties]
    views = actions.select(
        "session_id", "action_time", *ties, parse_time(F.col("action_time")).alias("action_ts")
    ).withColumn("piece", F.floor(F.unix_seconds("action_ts") / piece_seconds))
    wanted = ["session_id", "action_time", "page_id", "prev_page"]
    in_session = Window.partitionBy("session_id").orderBy(*order)
    in_piece = Window.partitionBy("session_id", "piece").orderBy(*order)
    paired = views.withColumns(
        {
            "is_first": F.row_number().over(in_piece) == 1,
            "prev_page": F.lag("page_id").over(in_piece),
            "is_last": F.lead(F.lit(True)).over(in_piece).isNull(),
        }
    )
    starts = (
        paired.where(F.col("is_first") | F.col("is_last"))
        .withColumn("prev_page", F.lag("page_id").over(in_session))
        .where("is_first")
    )
    return paired.where("NOT is_first").select(*wanted).unionByName(starts.select(*wanted))


def page_split_match(views: DataFrame, flow: Sequence[int]) -> DataFrame:
    """Page views whose step from the previous page is a step of the flow."""
    split = F.concat_ws("_", "prev_page", "page_id")
    return (
        views.where(F.col("prev_page").isNotNull())
        .select("session_id", split.alias("page_split"))
        .where(F.col("page_split").isin(flow_splits(flow)))
    )


def page_split_pv(views: DataFrame, flow: Sequence[int]) -> DataFrame:
    return page_split_match(views, flow).groupBy("page_split").agg(F.count("*").alias("pv"))


def page_convert_rate(views: DataFrame, flow: Sequence[int]) -> DataFrame:
    """One row per step of the flow: its views relative to the step before, two decimals.

    The first step is relative to the views of the start page. All counts come from one
    aggregation; a missing pair counts 0 and a step after a 0 has a NULL rate.
    """
    splits = flow_splits(flow)
    split = F.when(
        F.col("prev_page").isNotNull(), F.concat_ws("_", "prev_page", "page_id")
    )
    counts = views.select("page_id", split.alias("page_split")).agg(
        F.count_if(F.col("page_id") == flow[0]).alias("pv_0"),
        *[
            F.count_if(F.col("page_split") == text).alias(f"pv_{step}")
            for step, text in enumerate(splits, 1)
        ],
    )
    steps = [
        F.struct(
            F.lit(step).cast("long").alias("step"),
            F.lit(text).alias("page_split"),
            F.col(f"pv_{step}").alias("pv"),
            ratio(F.col(f"pv_{step}"), F.col(f"pv_{step - 1}")).alias("convert_rate"),
        )
        for step, text in enumerate(splits, 1)
    ]
    return counts.select(F.inline(F.array(*steps)))


def page_split_convert_rate(rates: DataFrame, task_id: int) -> DataFrame:
    """The rates as one text ``1_2=0.5|2_3=0.25`` in step order."""
    text = F.concat(
        "page_split", F.lit("="), F.coalesce(F.col("convert_rate").cast("string"), F.lit("null"))
    )
    # One element per step of the flow.
    entries = F.array_sort(F.collect_list(F.struct("step", text.alias("text"))))
    return rates.agg(F.array_join(entries.getField("text"), "|").alias("convert_rate")).select(
        F.lit(task_id).cast("long").alias("task_id"), "convert_rate"
    ).select(*schemas.PAGE_SPLIT_CONVERT_RATE)
