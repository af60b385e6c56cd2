"""Runs over what changed give what a run over everything gives; bursts of changes are told once."""

import datetime as dt

from pyspark.sql import functions as F

from folioscope.sources.shared import stored, work_folder
from folioscope.streaming import incremental, watch

KIND = "id int, version int, text string"


def test_only_new_contents_are_evaluated(spark):
    folder = work_folder(spark, "test")
    batches = [[(1, 0, "a b"), (2, 0, "c"), (3, 0, None), (4, 0, "c")], [(1, 1, "a b c d")], [(1, 2, "a b"), (5, 2, "c"), (2, 2, "e f g")], []]
    measured = lambda df: df.select("digest", F.size(F.split("text", " ")).alias("n"), F.length("text").alias("size"))
    sizes, schema = [], spark.createDataFrame([], KIND).schema
    for came in batches:
        spark.createDataFrame(came, KIND).write.mode("append").parquet(f"{folder}/arrived")
        incremental.run_changed(spark, f"{folder}/arrived", schema, "text", measured, folder)
        sizes.append(spark.read.parquet(f"{folder}/results").count())
    assert sizes == [3, 4, 5, 5]
    everything = spark.read.parquet(f"{folder}/arrived")
    got = incremental.merged(everything, spark.read.parquet(f"{folder}/results"), "id", "version", "text")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 3), (2, 3, 5), (3, 1, 0), (4, 1, 1), (5, 1, 1)]


def test_bursts(spark):
    folder = work_folder(spark, "test")
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, "p", "a.md", at(0)), (1, "p", "a.md", at(0)), (2, "p", "b.md", at(8)), (3, "p", "a.md", at(30)), (4, "q", "a.md", at(5)), (5, "p", "a.md", at(38)), (6, "q", None, None)]
    kind = "change int, project string, path string, at timestamp"
    for n, came in enumerate((rows, [(9, None, None, at(10_000))])):
        stored(spark.createDataFrame(came, kind), f"{folder}/arrived/{n}")
        stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).option("recursiveFileLookup", "true").parquet(f"{folder}/arrived")
        bursts = watch.quiet_sessions(stream, "project", "at", "path", "change", "10 seconds", "1 minute")
        bursts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.project, r.began, r.ended, r.n_changes, r.n_paths) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("p", at(0), at(18), 2, 2), ("p", at(30), at(48), 2, 1), ("q", at(5), at(15), 1, 1)]
