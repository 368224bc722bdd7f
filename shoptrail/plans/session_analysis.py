"""Session analysis of one task: statistics, random extract, top categories and sessions."""

from pyspark.sql import DataFrame

from shoptrail.operators import categories, sampling, sessions
from shoptrail.session import materialize, scratch
from shoptrail.sinks.tables import replace_task
from shoptrail.sources.tables import actions_by_date_range, find_task


def run(
    actions: DataFrame, user_info: DataFrame, tasks: DataFrame, task_id: int, output: str,
    seed: int = 0,
) -> None:
    """Write the five result tables below ``output``, replacing earlier rows of the task.

    The filtered sessions and the categories of their actions feed several reports, so they are
    written once and read back; they are deleted when the job ends, however it ends.
    """
    params = find_task(tasks, task_id)
    in_range = actions_by_date_range(actions, params)
    with scratch(actions.sparkSession, "session-analysis") as folder:
        full = sessions.session_full_aggr(sessions.session_aggregate(in_range), user_info)
        # The statistics are counted while the sessions are written.
        watched, seen = sessions.observe_session_counts(sessions.session_filter(full, params))
        kept = materialize(watched, "sessions", folder)
        counts = sessions.observed_counts(actions.sparkSession, seen)
        extracted = materialize(
            sampling.random_extract_session(kept, task_id, seed), "random-extract", folder
        )
        # The counts need these columns only; details are read from the action table.
        acted = in_range.select(
            "session_id", "click_category_id", "order_category_ids", "pay_category_ids"
        )
        detail = materialize(sessions.session_detail(acted, kept), "session-detail", folder)
        top_categories = materialize(
            categories.top10_category(categories.category_counts(detail), task_id),
            "top-categories", folder,
        )
        top_sessions = materialize(
            categories.top10_category_session(detail, top_categories, task_id),
            "top-sessions", folder,
        )
        extract_detail = sampling.random_extract_detail(extracted, in_range)
        top_detail = categories.top10_session_detail(top_sessions, in_range)

        reports = {
            "session_aggr_stat": sessions.aggr_stat_of(counts, task_id),
            "session_random_extract": extracted,
            "session_detail": sessions.as_session_detail(
                extract_detail.unionByName(top_detail), task_id
            ),
            "top10_category": top_categories,
            "top10_category_session": top_sessions,
        }
        for name, report in reports.items():
            replace_task(report, f"{output}/{name}", task_id)
