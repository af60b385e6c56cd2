"""Small literal tables, the same for Spark and for SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Inline:
    name: str
    schema: str  # "a string, b long"
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def cte(self) -> str:
        """``name(columns) AS (VALUES ...)`` for a WITH clause."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        literal = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(columns)}) AS (VALUES {values})"
