from folioscope.streaming import history

LINES = """{"timestamp":"2024-01-01T00:00:00Z","commit":"a","score":71.5,"status":"warn"}
{"timestamp":"2024-01-02T00:00:00Z","commit":"b","score":80,"status":"pass"}
not json
{"timestamp":"2024-01-03T00:00:00Z","commit":"c","status":"pass"}
{"timestamp":"2024-01-02T00:00:00Z","commit":"b","score":80,"status":"pass"}
"""


def test_history(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/h.jsonl").write_text(LINES)
    source = f"file://{tmp_path}/in"
    assert sorted(r.commit for r in history.load(spark, source).collect()) == ["a", "b", "b"]
    history.appended(history.watched(spark, source), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert sorted(r.commit for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]
