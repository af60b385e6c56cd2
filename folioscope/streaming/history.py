"""Score history as a stream: rows are appended, and read again as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

HISTORY = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("commit", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("status", T.StringType())])


def load(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; broken ones and those without a score are left out."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where(F.col("score").isNotNull())


def watched(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files."""
    return spark.readStream.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where(F.col("score").isNotNull())


def appended(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows, each commit once, to a table of Parquet files."""
    once = rows.withWatermark("timestamp", "7 days").dropDuplicatesWithinWatermark(["commit"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
