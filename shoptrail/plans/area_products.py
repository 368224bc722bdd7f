"""Most clicked products per area for one task."""

from pyspark.sql import DataFrame

from shoptrail.operators import products
from shoptrail.sinks.tables import replace_task
from shoptrail.sources.tables import click_actions_by_date, find_task


def run(
    actions: DataFrame, city_info: DataFrame, product_info: DataFrame, tasks: DataFrame,
    task_id: int, output: str,
) -> None:
    """Write area_top3_product below ``output``, replacing the task's earlier rows."""
    clicks = click_actions_by_date(actions, find_task(tasks, task_id))
    counts = products.area_product_click_count(clicks, city_info)
    top3 = products.area_top3_product(
        products.area_full_product(counts, product_info), task_id
    )
    replace_task(top3, f"{output}/area_top3_product", task_id)
