"""Exact deduplication by a keyed streaming state, DataFrame operations only.

A first scan writes the digest, identifier and place of each row. A stream
over that table keeps one state entry a digest in a disk-backed store, with no
expiry: the smallest identifier, where its content lies, and a count. Texts whose
digest was hit more than once are then fetched by their place and checked by
their full bytes; texts that differ under one digest are grouped by their bytes
instead. Frequent digests are dealt over several tasks.

Defined results: a null text counts as empty; a null id is larger than any
other; among repeated rows with one id the first by file (its hash) and place
stays; a text may be as long as a row may; an empty table gives an empty result;
other columns, whatever their names, are ignored, and kept by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import ROW_KEY, among, named, numbered, spread_join, with_row_key, without, work_dir, written

#: A run of these becomes one space before texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Members of one digest that are compared with one copy of the kept text.
MEMBERS_A_COPY = 256
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _first(doc_id: str) -> Column:
    """What the smallest of keeps the row with the smallest id, nulls last."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(ROW_KEY).alias("at"))


def _states(keys: DataFrame, source: str, base: str) -> DataFrame:
    """One row a digest: the entry that stays and the number of rows seen."""
    spark = keys.sparkSession
    out = f"{base}/state"
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(keys.schema).parquet(source)
        seen = stream.groupBy("digest").agg(F.min("entry").alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/of={number}")

        query = (
            seen.writeStream.outputMode("update")
            .foreachBatch(save)
            .option("checkpointLocation", f"{base}/stream")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = seen.schema.add("batch", T.IntegerType())
    try:
        saved = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    except Exception as e:  # an empty input starts no batch, so nothing was saved
        if "PATH_NOT_FOUND" not in str(e):
            raise
        saved = spark.createDataFrame([], schema)
    last = F.max_by(F.struct("keep", "group_size"), "batch").alias("s")
    return saved.groupBy("digest").agg(last).select("digest", "s.keep", "s.group_size")


def _differing(keyed: DataFrame, grouped: DataFrame, states: DataFrame, base: str) -> DataFrame:
    """Digests under which texts differ byte by byte from the kept one.

    Texts are fetched by their place, and only those whose digest was hit.
    """
    hits = written(grouped.where("group_size > 1").select(F.col("entry.at").alias(ROW_KEY), "digest"), f"{base}/hits")
    keepers = states.where("group_size > 1").select(F.col("keep.at").alias(ROW_KEY), "digest")
    keepers = written(keepers, f"{base}/keepers")
    own = F.col("norm")
    members = among(keyed.select(ROW_KEY, normalised(F.col("text")).alias("norm")), hits)
    kept = among(keyed.select(ROW_KEY, normalised(F.col("text")).alias("kept")), keepers).drop(ROW_KEY)
    sizes = states.where("group_size > 1").select("digest", F.col("group_size").alias("n"))
    both = spread_join(members, kept, "digest", sizes, ROW_KEY, least=MEMBERS_A_COPY)
    return written(both.where(own != F.col("kept")).select("digest").distinct(), f"{base}/odd")


def _groups(keyed: DataFrame) -> DataFrame:
    base = work_dir(keyed.sparkSession, "exact-dedup")
    keys = keyed.select(_first("doc_id").alias("entry"), _digest(normalised(F.col("text"))).alias("digest"))
    keys = written(keys, f"{base}/keys")
    states = written(_states(keys, f"{base}/keys", base), f"{base}/states")
    sizes = states.select("digest", F.col("group_size").alias("n"))
    grouped = written(spread_join(keys, states, "digest", sizes, "entry"), f"{base}/grouped")
    odd = _differing(keyed, grouped, states, base)
    if not odd.isEmpty():  # one digest of different texts: their bytes are the key
        sound = grouped.join(odd, "digest", "left_anti")
        texts = keyed.select(_first("doc_id").alias("entry"), normalised(F.col("text")).alias("norm"))
        apart = texts.withColumn("digest", _digest(F.col("norm"))).join(odd, "digest")
        groups = apart.groupBy("digest", "norm").agg(F.min("entry").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        grouped = sound.unionByName(apart.join(groups, ["digest", "norm"]).drop("norm"))
    return grouped.select(
        F.col("entry.at").alias(ROW_KEY),
        F.col("entry.id").alias("doc_id"),
        "digest",
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("entry") == F.col("keep")).alias("kept"),
    )


def keyed_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key with its group: ``_row_key, doc_id, digest, keep_id, group_size, kept``."""
    return _groups(with_row_key(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return keyed_groups(df, doc_id, text).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Texts aren't shuffled for it: the keys of those that go are looked up."""
    plain, names = numbered(df)
    keyed = with_row_key(plain)
    own = {n: F.col(f"_c{i}") for i, n in enumerate(names)}
    found = _groups(keyed.select(ROW_KEY, own[doc_id].alias("doc_id"), own[text].alias("text")))
    gone = written(found.where(~F.col("kept")).select(ROW_KEY), f"{work_dir(df.sparkSession, 'exact-dedup')}/gone")
    return named(without(keyed, gone), names)
