"""Tables that queries derive from the given ones, by one statement that Spark and other engines read alike."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_TABLE = re.compile(r"\{([a-z]+)\}")


@dataclass(frozen=True)
class Derived:
    """``sql`` names given tables in braces; quotes, braces and line feeds inside texts are written as ``chr``."""

    name: str
    sql: str

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(self.sql))}
        return spark.sql(self.sql, **tables)

    def cte(self) -> str:
        """``name AS (SELECT ...)`` for a WITH clause."""
        return f"{self.name} AS ({_TABLE.sub(lambda m: m[1], self.sql)})"
