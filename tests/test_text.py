from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import findings, prose


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "The getUserById function", t.tokens) == ["getuserbyid", "get", "user"]
    assert one(spark, "user user user", t.tokens) == ["user"]
    assert one(spark, None, t.tokens) == []


def test_slugs(spark):
    assert one(spark, "## Setup & Run!", t.slug) == "setup--run"
    assert one(spark, "## ⚡ Quick Start", t.slug) == "-quick-start"


def test_prose_leaves_markup_out(spark):
    text = "# Title\n```\ncode that is not prose at all here\n```\nThis is a [link](x) to some **bold** prose text.\n<!-- a\ncomment that runs on for some words\n-->\n| a | b |\n- A list item with quite enough words in it"
    assert one(spark, text, t.prose).split("\n") == ["This is a link to some bold prose text.", "A list item with quite enough words in it"]


def test_sentences(spark):
    text = "See e.g. the docs here. It uses v1.2.3 of the tool etc. and more! Go to https://x.org/a. now please? No."
    assert one(spark, text, t.sentences) == ["See e.g. the docs here", "It uses v1.2.3 of the tool etc. and more", "Go to https://x.org/a. now please"]


def test_syllables(spark):
    for word, n in {"the": 1, "kubernetes": 2, "everything": 4, "banana": 3, "table": 2, "jumped": 1, "created": 2, "ab": 1, "xyz": 1, "rhythms": 1}.items():
        assert one(spark, word, t.syllables) == n, word


def test_metrics_need_enough_text(spark):
    df = spark.createDataFrame([(1, "Too short to be scored at all."), (2, None)], "doc_id long, text string")
    assert all(r.flesch_ease is None for r in prose.metrics(df).collect())


def test_classification(spark):
    rows = [(0, 0, 0, 0, True), (0, 0, 5, 5, False), (0, 0, 5, 5, True), (0, 0, 2, 5, True), (0, 1, 4, 5, True), (1, 0, 4, 5, True), (0, 0, 5, 5, None)]
    got = findings.classified(spark.createDataFrame(rows, "errors long, warnings long, passed long, total long, applicable boolean")).collect()
    assert [(r.status, r.quality) for r in got] == [("na", None), ("na", None), ("pass", "HIGH"), ("pass", "MEDIUM"), ("warn", "MEDIUM"), ("fail", "LOW"), ("pass", "HIGH")]
