import random

import corpus_pipeline
from folioscope.llm.tokens import default_path, tokens


def test_each_stage_takes_effect(spark, tmp_path):
    r = random.Random(9)
    N = 1500  # noqa: N806
    vocabulary = ["".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randint(20, 40)), "en", "s", 0) for i in range(N)]
    toxic = {i for i in range(N) if i % 5 == 0}
    docs = [(i, f"{t} vilegrumk {text(3)}" if i in toxic else t, *x) for i, t, *x in docs]
    items = [(k, text(25) + ". " + text(6)) for k in range(12)]
    copy, near = docs[41][1], docs[43][1].split()
    docs.append((9400, copy.replace(" ", "  "), "en", "s", 0))
    near[-1] = "edited"
    docs.append((9401, " ".join(near * 1), "en", "s", 0))
    docs.append((9402, f"{text(40)} {items[5][1]} {text(40)}", "en", "s", 0))
    docs.append((9403, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(N)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {x.doc_id for x in rows}
    assert len(kept & toxic) <= 6 and not kept & {9400, 9401, 9402}
    assert len((set(range(N)) - toxic) - kept) <= 15, "clean documents stay"
    of = tokens(default_path())
    by = {}
    for x in rows:
        by[x.doc_id] = by.get(x.doc_id, 0) + x.length
    texts = {d[0]: d[1] or "" for d in docs}
    assert all(n == len(of.encode([texts[i]])[0]) // 4 + 1 for i, n in by.items())


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    long = text(30_000)
    docs = [(1, text(30), None), (2, text(25), "x"), (2, text(25), "y"), (3, None, None), (4, "", "z"), (5, long, None), (6, long + " end", None), (None, text(20), None), (7, text(9), None), (7, None, None)]
    docs.append(docs[0])
    kind = "doc_id long, text string, Contaminated string"
    items, labels = [("q-1", text(30)), ("q-2", docs[1][1]), (None, None)], [(1, None, None), (2, 1, 0), (2, 1, 0), (99, 1, 1), (None, 0, 1)]

    def ran(name, rows):
        base = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, kind).repartition(2).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        got = corpus_pipeline.run(spark, base).collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
        return got

    got = ran("odd", docs)
    whole = {x.doc_id: 0 for x in got}
    for x in got:
        whole[x.doc_id] += x.length
    # an exact copy, a near copy and one of the rows with a benchmark item go; of three empty texts one stays
    assert sorted(whole, key=repr) == sorted([1, 2, 3, 5, 7, None], key=repr)
    assert whole[5] > 20_000 and sum(1 for x in got if x.doc_id == 2 and x.piece == 0) == 1
    assert ran("none", []) == []
