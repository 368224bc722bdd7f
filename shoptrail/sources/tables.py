"""Reading and narrowing the catalog tables."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrail import constants as C
from shoptrail.functions.json import get_param, get_variant_param, parse_param
from shoptrail.functions.predicates import all_of
from shoptrail.params import TaskParams


def table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or temporary view."""
    return spark.table(name)


def register_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def _in_dates(params: TaskParams) -> Column:
    """The bounds that the task gives; a missing one leaves that end open."""
    start, end = params.start_date, params.end_date
    return all_of(
        None if start is None else F.col("date") >= start,
        None if end is None else F.col("date") <= end,
    )


def actions_by_date_range(actions: DataFrame, params: TaskParams) -> DataFrame:
    """Actions between the task's dates, both included.

    On a table partitioned by ``date`` only the partitions in the range are read.
    """
    return actions.where(_in_dates(params))


def click_actions_by_date(actions: DataFrame, params: TaskParams) -> DataFrame:
    """City and product of the product clicks between the task's dates."""
    return actions.where(F.col("click_product_id").isNotNull() & _in_dates(params)).select(
        "city_id", F.col("click_product_id").alias("product_id")
    )


_PARAM_COLUMNS = {
    "start_date": C.PARAM_START_DATE,
    "end_date": C.PARAM_END_DATE,
    "start_age": C.PARAM_START_AGE,
    "end_age": C.PARAM_END_AGE,
    "professionals": C.PARAM_PROFESSIONALS,
    "cities": C.PARAM_CITIES,
    "sex": C.PARAM_SEX,
    "keywords": C.PARAM_KEYWORDS,
    "category_ids": C.PARAM_CATEGORY_IDS,
    "target_page_flow": C.PARAM_TARGET_PAGE_FLOW,
}


def task_params(tasks: DataFrame) -> DataFrame:
    """The parameters of every task as columns."""
    param = F.col("task_param")
    return tasks.select(
        "task_id", "task_name", "task_type",
        *[get_param(param, key).alias(name) for name, key in _PARAM_COLUMNS.items()],
    )


def task_params_variant(tasks: DataFrame) -> DataFrame:
    """The same, with the JSON text of a task parsed once into a VARIANT that all fields are read
    from. A parameter that is not JSON has no fields."""
    # Not collapsed into one projection: the parse is an own column of the step below.
    parsed = tasks.select(
        "task_id", "task_name", "task_type", parse_param(F.col("task_param")).alias("param")
    )
    return parsed.select(
        "task_id", "task_name", "task_type",
        *[get_variant_param(F.col("param"), key).alias(name)
          for name, key in _PARAM_COLUMNS.items()],
    )


def find_task(tasks: DataFrame, task_id: int) -> TaskParams:
    """Parameters of one task; LookupError if there is no such task."""
    row = tasks.where(F.col("task_id") == task_id).select("task_param").first()
    if row is None:
        raise LookupError(f"no task with id {task_id}")
    return TaskParams.from_json(row["task_param"])
