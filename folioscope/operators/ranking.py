"""Term statistics and TF-IDF cosine ranking over long-format term tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.shared import stored, work_folder
from .spread import spread


def term_frequency(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, n``: how often each word stands in each row."""
    return df.select(key, F.explode(t.words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def token_sets(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, size``: each token of a row once, with the number of its tokens."""
    sets = df.select(key, t.tokens(F.col(text)).alias("tokens"))
    return sets.select(key, F.size("tokens").cast("long").alias("size"), F.explode("tokens").alias("term"))


def smoothed_idf(terms: DataFrame, documents: int) -> DataFrame:
    """``term, df, idf`` of rows in which each term stands once."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(F.lit(float(documents)) / (1 + F.col("df"))) + 1)


def _token_arrays(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens``, written to the shared folder: tokens are costly, and the plans here read them several times."""
    return stored(spread(df.select(key, text)).select(key, t.tokens(F.col(text)).alias("tokens")), f"{work_folder(df.sparkSession, 'tokens')}/sets")


def _terms(arrays: DataFrame, key: str) -> DataFrame:
    return arrays.select(key, F.explode("tokens").alias("term"))


def cosine_topk(queries: DataFrame, documents: DataFrame, query_key: str, doc_key: str, text: str = "text", k: int = 3) -> DataFrame:
    """The ``k`` most similar documents of each query; ties go to the smaller key.

    A query's weights come from it and the documents alone, so its scores don't
    depend on other queries: ``N`` is one more than the documents, and a term of
    the query counts as one document more. That changes the norm of a document
    only by the terms it shares with the query, so norms are summed once and
    corrected after the join, which is by term.
    """
    d_sets = _token_arrays(documents, doc_key, text)
    q, d = _terms(_token_arrays(queries, query_key, text), query_key), _terms(d_sets, doc_key)
    total = F.broadcast(d_sets.agg((F.count(F.lit(1)) + 1).cast("double").alias("total")))  # one row
    df = d.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weigh = lambda more: F.pow(F.log(F.col("total") / (F.lit(more) + F.coalesce("df", F.lit(0)))) + 1, F.lit(2.0))
    q = q.join(df, "term", "left").crossJoin(total).select(query_key, "term", weigh(2).alias("own"), weigh(1).alias("plain"))
    plain = df.crossJoin(total).select("term", weigh(1).alias("plain"))
    d_norm = d.join(plain, "term").groupBy(doc_key).agg(F.sum("plain").alias("d_norm"))
    q_norm = q.groupBy(query_key).agg(F.sum("own").alias("q_norm"))
    shared = q.join(d, "term").groupBy(query_key, doc_key).agg(F.sum("own").alias("dot"), F.sum(F.col("own") - F.col("plain")).alias("change"))
    scored = shared.join(q_norm, query_key).join(d_norm, doc_key)
    score = F.round(F.col("dot") / (F.sqrt("q_norm") * F.sqrt(F.col("d_norm") + F.col("change"))), 6)
    ranked = scored.select(query_key, doc_key, score.alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key))
    return ranked.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: int, text: str = "text") -> DataFrame:
    """Pairs that share ``least`` tokens or more, met by token."""
    a, b = _terms(_token_arrays(left, left_key, text), left_key), _terms(_token_arrays(right, right_key, text), right_key)
    return a.join(b, "term").groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
