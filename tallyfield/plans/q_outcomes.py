"""Task and case tables, and first looks at them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.plans import views as V
from tallyfield.plans.registry import query

ROUNDED = 6


def rounded(df, digits: int = ROUNDED):
    """Round every double: engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


COVERAGE = ["original_target_count", "surviving_target_count", "reached_original_by_deadline", "reached_original_by_end",
            "reached_surviving_by_deadline", "reached_surviving_by_end", "s100_original_by_deadline",
            "s100_surviving_by_deadline", "s100_surviving_by_end", "t100_surviving_censored"]


@query("A19_coverage_s100", f"""
SELECT region, task_id, {", ".join(COVERAGE)}, round(surviving_coverage_deadline_percent, 6) AS surviving_coverage_deadline_percent,
       round(original_coverage_end_percent, 6) AS original_coverage_end_percent, round(t100_surviving_min, 6) AS t100_surviving_min
FROM v_task_metrics""")
def coverage_s100(spark, sf_dir):
    return rounded(V.task_metrics(spark, sf_dir).select(
        "region", "task_id", *COVERAGE, "surviving_coverage_deadline_percent", "original_coverage_end_percent", "t100_surviving_min"))


@query("F19_failure_class", """
SELECT failure_class, priority_class, count(*) AS n_tasks FROM v_task_metrics GROUP BY ALL""")
def failure_classes(spark, sf_dir):
    return V.task_metrics(spark, sf_dir).groupBy("failure_class", "priority_class").agg(F.count("*").alias("n_tasks"))


CASE_COLUMNS = ["status", "family", "n_tasks", "geometry_failure_count", "communication_failure_count",
                "routing_or_timing_failure_count", "t100_completed_count", "t100_censored_count", "n_transfer_events",
                "max_hops_seen"]
CASE_NUMBERS = ["mean_original_coverage_deadline_percent", "mean_surviving_coverage_deadline_percent",
                "s100_original_by_deadline_percent", "s100_surviving_by_deadline_percent", "observation_success_percent",
                "p100_t100_surviving_min", "transferred_mbits"]
