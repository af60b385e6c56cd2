"""Watching changes: a run when they have been quiet for a while, as session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_sessions(changes: DataFrame, project: str, at: str, path: str, change_id: str, quiet: str, late: str) -> DataFrame:
    """``project, began, ended, n_changes, n_paths``: bursts of changes with no gap of ``quiet`` in them; a run follows each.

    ``changes`` is a stream. A change that is told twice counts once: its id stays in
    the state for ``late``, which is also how late a change may come. Null times and
    rows without a project (ticks of the clock, which only move the time on) begin no burst.
    """
    once = changes.withWatermark(at, late).dropDuplicatesWithinWatermark([change_id])
    burst = F.session_window(at, quiet)
    each = once.groupBy(project, burst).agg(F.count(F.lit(1)).alias("n_changes"), F.size(F.collect_set(path)).cast("long").alias("n_paths"))
    return each.where(F.col(project).isNotNull()).select(project, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n_changes", "n_paths")
