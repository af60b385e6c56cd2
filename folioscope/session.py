"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "folioscope", **more: str) -> SparkSession:
    """Get or create a session; ``more`` adds settings. The master is left to the launcher unless there is none."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    if "spark.master" not in more and not os.environ.get("MASTER"):
        builder = builder.config("spark.master", f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    return builder.getOrCreate()
