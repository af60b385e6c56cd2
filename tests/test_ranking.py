from folioscope.operators import ranking

DOCS = [("auth", "login with a password, session token and user authentication"), ("billing", "invoice payment and currency amounts"), ("utils", "format date strings and helper functions")]
SCHEMA = "id string, text string"


def scores(spark, queries):
    found = ranking.cosine_topk(spark.createDataFrame(queries, "q string, text string"), spark.createDataFrame(DOCS, SCHEMA), "q", "id")
    return {(r.q, r.id): (r.score, r["rank"]) for r in found.collect()}


def test_the_document_about_it_is_first(spark):
    got = scores(spark, [("one", "the user can login with a password"), ("two", "zebra migration")])
    assert got["one", "auth"][1] == 1 and got["one", "auth"][0] > 0.1
    assert all(got.get(("one", x), (0, 0))[0] < got["one", "auth"][0] for x in ("billing", "utils"))
    assert not any(q == "two" for q, _ in got)


def test_scores_dont_depend_on_other_queries(spark):
    one = ("one", "the user can login with a password and a date")
    alone, both = scores(spark, [one]), scores(spark, [one, ("two", "login password invoice"), ("three", "password")])
    assert alone == {k: v for k, v in both.items() if k[0] == "one"}
