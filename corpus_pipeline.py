"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, written as Parquet and read again:
toxic documents go, then exact copies, then all but one document of each group
of near copies, then documents with a benchmark item, and the rest is packed.
All stages but the last return the columns of ``documents``.

Defined results: a null text is empty, which no stage drops but as a copy of another
empty one (empty texts are linked with nothing, and hold no item); without labels of
both classes no document is toxic; documents without a label, and labels that are null
or no class, count for nothing in the fit; of rows with one id that are equal one
stays, others are judged each by its text; ties go to the smallest id; columns beside
``doc_id`` and ``text`` are carried whatever they are called; very long texts are
judged whole; an empty table passes every stage and packs nothing.

A stage sets that rows go to Python workers a thousand at a time, which must hold
while its result is written; ``run`` puts the setting back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from folioscope.llm.rows import batches_as_before, small_batches, work_dir, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifier, the components or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = small_batches(spark)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"{base}/{name}")
    finally:
        batches_as_before(spark, before)
    return docs
