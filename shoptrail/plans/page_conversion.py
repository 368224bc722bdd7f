"""Page conversion along the page flow of one task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shoptrail.operators import pages
from shoptrail.sinks.tables import replace_task
from shoptrail.sources.tables import actions_by_date_range, find_task


def run(
    actions: DataFrame, tasks: DataFrame, task_id: int, output: str,
    tie: Sequence[str] = ("page_id",),
) -> None:
    """Write page_split_convert_rate below ``output``, replacing the task's earlier row."""
    params = find_task(tasks, task_id)
    if len(params.target_page_flow) < 2:
        raise ValueError(f"task {task_id} names no page flow")
    views = pages.page_views(actions_by_date_range(actions, params), tie)
    rates = pages.page_convert_rate(views, params.target_page_flow)
    replace_task(
        pages.page_split_convert_rate(rates, task_id), f"{output}/page_split_convert_rate", task_id
    )
