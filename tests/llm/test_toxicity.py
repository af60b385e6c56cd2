import random

import numpy as np

from folioscope.llm import toxicity

SMALL = toxicity.Settings(buckets=1 << 12, positives=200, negatives=300, epochs=8)


def made(n=700, seed=1):
    r = random.Random(seed)
    plain = ["the", "of", "stone", "river", "house", "and", "green", "walk", "light", "to"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(3, 60))]
        toxic = int(r.random() < 0.3)
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["grumk", "grumko", "Grumkas,", "zzvile"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "the river"), (9002, "a " * 50_000 + "grumk")], "doc_id long, text string").repartition(3)
    model = toxicity.trained(docs, spark.createDataFrame([*labels, (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int"), SMALL)
    got = {r.doc_id: r for r in toxicity.scored(docs, model, carry=["doc_id"]).withColumn("held_out", toxicity.held_out("doc_id")).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    right = sum((got[i].score >= toxicity.CUT) == bool(truth[i]) for i in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[9002].score >= toxicity.CUT and got[9000].score == got[9001].score < toxicity.CUT


def test_score_is_of_the_text_alone(spark):
    rows, labels = made(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), SMALL)
    pair = spark.createDataFrame([(1, "xx grumk", "de"), (77, "xx grumk", "en")], "doc_id long, text string, lang string")
    got = toxicity.scored(pair, model).collect()
    assert got[0].score == got[1].score and got[0].lang == "de"


def test_without_both_classes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels, SMALL)
    assert model is None
    assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.0]
    assert toxicity.scored(docs.where("doc_id > 5"), model).count() == 0


def test_pooling_by_table_equals_direct_convolution():
    rows, labels = made(80)
    model = toxicity.fit([t for _, t in rows], np.array([x[2] for x in labels]), SMALL)
    text = rows[5][1]
    got = toxicity.logits([rows[4][1], text], model, toxicity.Words(model))[0][1]
    vectors = np.array([model.embedding[list(toxicity.features(w, len(model.embedding)))].sum(0) for w in text.lower().split()])
    vectors = np.concatenate([vectors, np.zeros((2 * toxicity.PAD, model.embedding.shape[1]))])
    pooled = []
    for k, width in enumerate(toxicity.WIDTHS):
        taps = [t for t, (kk, _) in enumerate(toxicity.TAPS) if kk == k]
        windows = [sum(vectors[i + j] @ model.kernels[t] for j, t in enumerate(taps)) for i in range(len(vectors) - 2 * toxicity.PAD)]
        pooled.append(np.max(windows, axis=0))
    want = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
    assert abs(got - want) < 1e-3


def test_merged_models_give_the_mean():
    r = np.random.default_rng(3)
    make = lambda: toxicity.Model(r.normal(size=(64, 4)).astype(np.float32), r.normal(size=(len(toxicity.TAPS), 4, 3)).astype(np.float32), r.normal(size=9).astype(np.float32), r.normal(size=9).astype(np.float32), 0.5, np.zeros(5))
    members, texts = [make() for _ in range(3)], ["", None, "a b c d", "the the x", "y " * 500]
    each = [toxicity.logits(texts, m, toxicity.Words(m))[0] for m in members]
    whole = toxicity.merged(members)
    assert np.allclose(toxicity.logits(texts, whole, toxicity.Words(whole))[0], np.mean(each, 0), atol=1e-3)


def test_few_toxic_rows_are_enough_for_a_word():
    r = np.random.default_rng(5)
    text = lambda bad: " ".join([*(f"w{k}" for k in r.integers(0, 300, 60)), *(["scoundrel", "villain"] if bad else [])])
    y = np.array([1] * 30 + [0] * 200)
    model = toxicity.fit([text(b) for b in y], y, toxicity.Settings(few_epochs=20))
    got = toxicity.scores([text(b) for b in [1] * 40 + [0] * 100], model, toxicity.Words(model)) >= toxicity.CUT
    assert got[:40].sum() >= 36 and got[40:].sum() <= 2


def test_repeated_ids_count_once_and_names_clash_in_any_case(spark):
    df = spark.createDataFrame([(k % 40, f"text {k}", "x") for k in range(400)], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(40)] * 2, "doc_id long, toxic int")
    sample = toxicity.training_sample(df, labels, toxicity.Settings())
    assert sample.count() == len({k for k in range(40)} - {r.doc_id for r in df.where(toxicity.held_out("doc_id")).select("doc_id").distinct().collect()})
    out = toxicity.scored(df, None)
    assert out.columns == ["doc_id", "text", "score"] and out.agg({"score": "max"}).first()[0] == 0


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """More rows than one task fits alone are dealt over tasks, none is left out."""
    monkeypatch.setattr(toxicity, "PORTION", 64)
    rows, labels = made(1500, 4)
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    s = toxicity.Settings(buckets=1 << 12, positives=40, negatives=60)
    held = {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()}
    assert toxicity.training_sample(docs, marked, s).count() == len(rows) - len(held)
    model = toxicity.trained(docs, marked, s)
    texts, truth = [t for i, t in rows if i in held], np.array([y for i, _, y in labels if i in held])
    got = toxicity.scores(texts, model, toxicity.Words(model)) >= toxicity.CUT
    assert (got == (truth == 1)).mean() > 0.95
    again = toxicity.trained(docs.repartition(5), marked, s)
    assert np.allclose(again.thresholds, model.thresholds, atol=1e-2) and np.allclose(again.out, model.out, atol=1e-3)


def test_cuts_from_counts_are_those_from_rows():
    r = np.random.default_rng(2)
    y, lang, toxic = np.round(r.normal(size=600), 1), r.integers(0, 5, 600), r.integers(0, 2, 600)
    each, n = np.unique(np.stack([y, lang, toxic]), axis=1, return_counts=True)
    assert np.isfinite(toxicity.calibrated(each[0], each[1].astype(int), each[2].astype(int), n)).all()
    assert np.allclose(toxicity.calibrated(y, lang, toxic), toxicity.calibrated(y, lang, toxic, np.ones(600, int)))


def test_words_hashed_side_by_side_have_the_same_features():
    words = ["a", "...", "été!", "«ñandú»", "straße", "q" * 32, "q" * 33, "日本語", "€uro", "x\x00", "\x00", "\ud800", "𝄞clef", "ı", "abc", "abcd", "abcdefg", "߿", "ࠀ"]
    for buckets in (1 << 14, 1 << 16, 1 << 31):
        assert toxicity.features_of(words, buckets).tolist() == [list(toxicity.features(w, buckets)) for w in words]
    assert toxicity.features_of([], 8).shape == (0, toxicity.N_FEATURES)


def test_a_full_table_keeps_the_words_that_are_met_again():
    s = toxicity.Settings(buckets=64, width=4, filters=2)
    model = toxicity._model(toxicity._started(s, np.random.default_rng(3)))
    known, fresh = toxicity.Words(model, most=40), []
    learnt = toxicity.features_of
    try:
        toxicity.features_of = lambda words, buckets: (fresh.extend(words), learnt(words, buckets))[1]
        for k in range(30):
            texts = [" ".join(["the", "and", "der", "das", "und", *[f"w{k}x{i}" for i in range(10)]]), "die der el", None, f"x{k}"]
            y, lang = toxicity.logits(texts, model, known)
            want, guessed = toxicity.logits(texts, model, toxicity.Words(model))
            assert np.allclose(y, want, atol=1e-5) and lang.tolist() == guessed.tolist() == [0, 0, 4, 4]
            assert len(known) <= 40
    finally:
        toxicity.features_of = learnt
    assert fresh.count("the") == 31  # once in the small table, and in each new one
