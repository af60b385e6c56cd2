"""Readability and load metrics of prose, one row per document.

All metrics come from arrays within the row: nothing is exploded, and rows are
shuffled only where a small source has fewer splits than there are cores.
Texts of under 50 words or three sentences aren't scored (null metrics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .spread import spread

#: metric -> (finding code, limit, above or below which it warns)
LIMITS = {
    "passive_ratio": ("DQ001", 0.25, "above"), "pronoun_ratio": ("DQ002", 0.15, "above"), "compound_ratio": ("DQ003", 0.35, "above"),
    "flesch_ease": ("DQ004", 5.0, "below"), "fk_grade": ("DQ005", 22.0, "above"), "sentence_length": ("DQ006", 30.0, "above"),
    "negation_ratio": ("DQ007", 0.20, "above"), "conditional_ratio": ("DQ008", 0.30, "above"),
}
LEAST_WORDS, LEAST_SENTENCES = 50, 3


def _share(array: str, test) -> Column:
    return F.size(F.filter(array, test)) / F.size(array)


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, n_sentences, n_syllables`` and the eight metrics."""
    out = spread(df).withColumn("_prose", t.prose(F.col(text)))
    out = out.withColumns({"_sentences": t.sentences(F.col("_prose")), "_words": t.words(F.col("_prose"))})
    total = F.aggregate("_words", F.lit(0).cast("long"), lambda acc, w: acc + t.syllables(w))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "n_sentences": F.size("_sentences").cast("long"), "n_syllables": total})
    per_sentence, per_word = F.col("n_words") / F.col("n_sentences"), F.col("n_syllables") / F.col("n_words")

    def compound(s: Column) -> Column:
        return s.rlike(t.bounded(t.COMPOUND)) | (F.regexp_count(s, F.lit(t.bounded("and"))) >= 2)

    found = {
        "passive_ratio": _share("_sentences", lambda s: s.rlike(t.bounded(t.PASSIVE))),
        "pronoun_ratio": _share("_words", lambda w: w.isin(*t.PRONOUNS)),
        "compound_ratio": _share("_sentences", compound),
        "flesch_ease": F.greatest(F.lit(0.0), F.least(F.lit(100.0), t.rounded(206.835 - 1.015 * per_sentence - 84.6 * per_word))),
        "fk_grade": F.greatest(F.lit(0.0), t.rounded(0.39 * per_sentence + 11.8 * per_word - 15.59)),
        "sentence_length": t.rounded(per_sentence),
        "negation_ratio": _share("_sentences", lambda s: s.rlike(t.bounded(t.NEGATION))),
        "conditional_ratio": _share("_sentences", lambda s: s.rlike(t.bounded(t.CONDITIONAL))),
    }
    scored = (F.col("n_words") >= LEAST_WORDS) & (F.col("n_sentences") >= LEAST_SENTENCES)
    return out.withColumns({k: F.when(scored, v) for k, v in found.items()}).drop("_prose", "_sentences", "_words")


def findings(measured: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each metric beyond its limit: ``key, code, metric, value``."""
    rows = [
        F.struct(F.lit(code).alias("code"), F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(m) > limit if side == "above" else F.col(m) < limit).alias("warn"))
        for m, (code, limit, side) in LIMITS.items()
    ]
    return measured.select(key, F.explode(F.array(*rows)).alias("x")).where("x.warn").select(key, "x.code", "x.metric", "x.value")


def labels(measured: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, flesch_ease, ease, grade`` of scored documents.

    Others are left out by an empty array: a filter would be pushed below the metrics, which would then be worked out for it once more.
    """
    row = F.struct(F.col("flesch_ease"), F.col("fk_grade"))
    scored = measured.select(key, F.inline(F.when(F.col("flesch_ease").isNotNull(), F.array(row))))
    return scored.select(key, "flesch_ease", ease_label(F.col("flesch_ease")).alias("ease"), grade_label(F.col("fk_grade")).alias("grade"))


def ease_label(ease: Column) -> Column:
    return (
        F.when(ease >= 90, "Very Easy").when(ease >= 70, "Easy").when(ease >= 60, "Standard").when(ease >= 50, "Fairly Difficult")
        .when(ease >= 30, "Difficult").when(ease >= 15, "Hard — Technical").otherwise("Very Confusing")
    )


def grade_label(grade: Column) -> Column:
    return (
        F.when(grade <= 6, "6th grade").when(grade <= 8, "8th grade").when(grade <= 10, "10th grade")
        .when(grade <= 12, "high school").when(grade <= 16, "college").otherwise("graduate+")
    )
