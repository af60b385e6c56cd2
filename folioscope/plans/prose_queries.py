"""Queries over the prose of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import prose

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_Q = lambda pattern: pattern.replace("'", "''")

PROSE_SQL = rf"""
p AS (
    SELECT doc_id, lang, array_to_string(list_filter(list_transform(
        list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')),
            lambda x: NOT regexp_matches(x, '^(\||#|!|[-*_]{{3,}}[ \t]*$|[|:\- \t]+$|<!--.*-->$|<[^>]+>|$)')),
        lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\*{{1,3}}([^*]+)\*{{1,3}}', '\1', 'g'), '_{{1,3}}([^_]+)_{{1,3}}', '\1', 'g'), '^[-*+][ \t]+', ''), '^[0-9]+\.[ \t]+', '')),
        lambda x: length(x) >= 15 AND length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) / length(x) >= 0.55 AND len(regexp_split_to_array(x, '[ \t\r\n\f\v]+')) >= 5), chr(10)) AS prose
    FROM documents
), s AS (
    SELECT doc_id, lang, prose,
        list_filter(list_transform(regexp_split_to_array(
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(prose, '(?i)\b({t.ABBREVIATIONS})\.', '\1≈', 'g'), '(?i)\be\.g\.', 'e≈g≈', 'g'), '(?i)\bi\.e\.', 'i≈e≈', 'g'),
                '(https?://[^ \t\r\n\f)]*)\.([ \t\r\n\f]|$)', '\1≈\2', 'g'),
            '[.!?]+(?:[ \t\r\n\f\v]+|$)'), lambda x: regexp_replace(replace(x, '≈', '.'), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')),
            lambda x: length(x) >= 10 AND len(regexp_split_to_array(x, '[ \t\r\n\f\v]+')) >= 3) AS sentences,
        list_filter(regexp_split_to_array(regexp_replace(lower(prose), '[^a-z0-9 \t\r\n\f''-]', ' ', 'g'), '[ \t\r\n\f\v]+'), lambda x: x <> '') AS words
    FROM p
), y AS (
    SELECT doc_id, sum(CASE
        WHEN length(w) <= 2 THEN 1
        WHEN w IN ({_LIST(t.TECH_VOCABULARY)}) THEN 2
        {" ".join(f"WHEN w = '{w}' THEN {n}" for w, n in t.SYLLABLES.items())}
        ELSE greatest(1, greatest(len(regexp_extract_all(w, '[aeiouy]+')), CASE WHEN regexp_matches(w, '[aeiouy]') THEN 0 ELSE 1 END)
            - CASE WHEN w LIKE '%e' AND NOT regexp_matches(w, '(le|ce|ge)$') THEN 1 ELSE 0 END
            - CASE WHEN w LIKE '%ed' AND NOT regexp_matches(w, '(ted|ded)$') THEN 1 ELSE 0 END) END) AS n_syllables
    FROM (SELECT doc_id, regexp_replace(unnest(words), '[^a-z]', '', 'g') AS w FROM s) GROUP BY doc_id
), c AS (
    SELECT s.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(len(sentences) AS BIGINT) AS n_sentences, CAST(coalesce(n_syllables, 0) AS BIGINT) AS n_syllables,
        sentences, words, len(words) >= 50 AND len(sentences) >= 3 AS scored
    FROM s LEFT JOIN y USING (doc_id)
), m AS (
    SELECT doc_id, lang, n_words, n_sentences, n_syllables,
        CASE WHEN scored THEN len(list_filter(sentences, lambda x: regexp_matches(x, '(?i)\b{t.PASSIVE}\b'))) / n_sentences END AS passive_ratio,
        CASE WHEN scored THEN len(list_filter(words, lambda x: x IN ({_LIST(t.PRONOUNS)}))) / n_words END AS pronoun_ratio,
        CASE WHEN scored THEN len(list_filter(sentences, lambda x: regexp_matches(x, '(?i)\b{t.COMPOUND}\b') OR len(regexp_extract_all(x, '(?i)\band\b')) >= 2)) / n_sentences END AS compound_ratio,
        CASE WHEN scored THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor((206.835::DOUBLE - 1.015::DOUBLE * (n_words / n_sentences) - 84.6::DOUBLE * (n_syllables / n_words)) * 10 + 0.5::DOUBLE) / 10)) END AS flesch_ease,
        CASE WHEN scored THEN greatest(0.0::DOUBLE, floor((0.39::DOUBLE * (n_words / n_sentences) + 11.8::DOUBLE * (n_syllables / n_words) - 15.59::DOUBLE) * 10 + 0.5::DOUBLE) / 10) END AS fk_grade,
        CASE WHEN scored THEN floor((n_words / n_sentences) * 10 + 0.5::DOUBLE) / 10 END AS sentence_length,
        CASE WHEN scored THEN len(list_filter(sentences, lambda x: regexp_matches(x, '(?i)\b{_Q(t.NEGATION)}\b'))) / n_sentences END AS negation_ratio,
        CASE WHEN scored THEN len(list_filter(sentences, lambda x: regexp_matches(x, '(?i)\b{t.CONDITIONAL}\b'))) / n_sentences END AS conditional_ratio
    FROM c
)
"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.metrics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")).drop("text")


def doc_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)


def doc_quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.findings(_measured(spark, sf_dir))


def readability_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.labels(_measured(spark, sf_dir))


def prose_totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_sentences", "n_syllables")]
    return m.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count("flesch_ease").alias("scored"), *sums)


QUERIES = {f.__name__: f for f in (doc_quality_metrics, doc_quality_findings, readability_labels, prose_totals_by_lang)}
ORACLE_SQL = {
    "doc_quality_metrics": f"WITH {PROSE_SQL} SELECT * FROM m",
    "doc_quality_findings": f"WITH {PROSE_SQL} "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{code}' AS code, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM m WHERE {m} {'>' if side == 'above' else '<'} {limit}" for m, (code, limit, side) in prose.LIMITS.items()
    ),
    "readability_labels": f"""WITH {PROSE_SQL} SELECT doc_id, flesch_ease,
        CASE WHEN flesch_ease >= 90 THEN 'Very Easy' WHEN flesch_ease >= 70 THEN 'Easy' WHEN flesch_ease >= 60 THEN 'Standard' WHEN flesch_ease >= 50 THEN 'Fairly Difficult'
             WHEN flesch_ease >= 30 THEN 'Difficult' WHEN flesch_ease >= 15 THEN 'Hard — Technical' ELSE 'Very Confusing' END AS ease,
        CASE WHEN fk_grade <= 6 THEN '6th grade' WHEN fk_grade <= 8 THEN '8th grade' WHEN fk_grade <= 10 THEN '10th grade' WHEN fk_grade <= 12 THEN 'high school'
             WHEN fk_grade <= 16 THEN 'college' ELSE 'graduate+' END AS grade
        FROM m WHERE flesch_ease IS NOT NULL""",
    "prose_totals_by_lang": f"""WITH {PROSE_SQL} SELECT lang, count(*) AS docs, count(flesch_ease) AS scored, CAST(sum(n_words) AS BIGINT) AS n_words,
        CAST(sum(n_sentences) AS BIGINT) AS n_sentences, CAST(sum(n_syllables) AS BIGINT) AS n_syllables FROM m GROUP BY lang""",
}
