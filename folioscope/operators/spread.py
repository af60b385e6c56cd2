"""Rows dealt to as many tasks as there are cores, where the source has fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` for work that is heavy by row.

    A source of few splits (a small file is one, whatever its rows cost) is dealt
    by rows, or by ``keys``, which needs no sort; one that has more splits than twice the cores stays as it is, so
    that a large table isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, *keys) if df.rdd.getNumPartitions() <= 2 * cores else df
