"""Work folders, written tables and row keys shared by the operators here."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import pickle
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the row key column.
ROW_KEY = "_row_key"
#: Row keys that are sent to all tasks at most: some 64 MB.
BROADCAST_ROWS = 1_000_000
#: Keys that ``spread_join`` treats apart at most, and the least rows of one.
HOT_KEYS, LEAST_HOT = 10_000, 256


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder that the driver and all executors
    share. Only where it is unset in local mode (tests) a temporary one is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_before.get() if set_before.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/folioscope-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a worker keeps between tasks, by the operator that it is for.
KEPT: dict[str, dict] = {}


def trimmed(batches: Iterator[pa.RecordBatch], own: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end memory that was freed goes back to the system, so that idle workers stay small.

    What the worker keeps for other operators than ``own`` is given up first.
    """
    for name, cache in KEPT.items():
        if name != own:
            cache.clear()
    try:
        yield from batches
    finally:
        trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


_APART = "import pickle, sys; work, a = pickle.load(sys.stdin.buffer); pickle.dump(work(*a), sys.stdout.buffer)"


def apart(work: Callable, *arguments: object) -> object:
    """What ``work``, a function of a module, gives in a fresh process, whose memory is gone afterwards."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    done = subprocess.run([sys.executable, "-c", _APART], input=pickle.dumps((work, arguments)), stdout=subprocess.PIPE, env=env, check=True)
    return pickle.loads(done.stdout)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> str | None:
    """From now on rows go to Python workers a thousand at a time, so that batches of texts stay small there and in the executor; the setting as it was."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, "1024")
    return before


def batches_as_before(spark: SparkSession, before: str | None) -> None:
    spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``_row_key``, which tells rows apart even if their ids repeat.

    For file sources that know it, the key is the file (64 bits of a hash of its
    path) and the row's place in it, stable under re-execution. Any other input
    is written to the shared folder first, so that it has such places. Of other
    columns none may have the name of the key; ``numbered`` makes sure of that.
    """
    if ROW_KEY in df.columns:
        raise ValueError(f"column {ROW_KEY} is reserved")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    hidden = df._jdf.queryExecution().analyzed().metadataOutput().mkString(" ")
    if "_metadata" in df.columns or not hidden.startswith("_metadata#"):
        plain, names = numbered(df)
        kept = written(plain, work_dir(df.sparkSession, "rows"))
        return kept.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], place.alias(ROW_KEY))
    return df.select("*", place.alias(ROW_KEY))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by number, and their names: no name clashes with one of ours."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """The numbered columns alone, under their names again."""
    return df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def carried(df: DataFrame, carry: list[str] | None, taken: Iterable[str]) -> list[str]:
    """The columns to carry (all by default) but those named like one of ``taken``, in whatever case."""
    names = {t.lower() for t in taken}
    return [c for c in (df.columns if carry is None else carry) if c.lower() not in names]


def without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among ``dropped``, a written table.

    Up to BROADCAST_ROWS keys are sent to the rows, which then need no shuffle;
    beyond that both sides are shuffled.
    """
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(dropped) if few else dropped, ROW_KEY, "left_anti")


def among(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` joined with a written table of unique row keys, which is sent to the rows while it is small."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(keys) if few else keys, ROW_KEY)


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, by: str, how: str = "inner", least: int = LEAST_HOT) -> DataFrame:
    """Join on a key that is unique in ``right``, without one task for a frequent key.

    ``sizes`` (``key, n``, a written table) has the rows of ``left`` by key. Frequent
    keys, at most HOT_KEYS of them at any size of the input, are broadcast; their
    rows are dealt by ``by`` over copies of the right row. Null keys are dealt too.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = max(least, total // HOT_KEYS)
    hot = F.broadcast(sizes.where(F.col("n") >= each).select(key, F.ceil(F.col("n") / each).cast("int").alias("_copies")))
    copy = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(1024))).otherwise(F.coalesce(F.pmod(F.xxhash64(by), "_copies"), F.lit(0)))
    dealt = left.join(hot, key, "left").withColumn("_copy", copy.cast("int")).drop("_copies")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    copied = right.join(hot, key, "left").withColumn("_copy", copies).drop("_copies")
    return dealt.join(copied, [key, "_copy"], how).drop("_copy")
