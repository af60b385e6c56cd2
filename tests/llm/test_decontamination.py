import random

import numpy as np

from folioscope.llm import decontamination as d

SMALL = d.Settings(buckets=1 << 12, dimensions=24, common=2, oversample=8, sample=200)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randint(1, 90))] for _ in "ab")
        assert d.common_subsequence(a, b) == longest(a, b)


def made(seed=3):
    r = random.Random(seed)
    words = ["the", "of", "and"] * 60 + ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    sentence = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, " ".join(sentence(r.randint(15, 30))) + ". " + " ".join(sentence(8))) for k in range(20)]
    rows, truth = [], {}
    for i in range(300):
        own = sentence(r.choice([0, 1, 40, 200, 900]))
        if i % 6 == 0:
            item = items[r.randrange(20)]
            copy = item[1].split()
            if i % 12 == 0:  # a paraphrase: some words differ
                for _ in range(len(copy) // 6):
                    copy[r.randrange(len(copy))] = r.choice(words)
            at = r.randint(0, len(own))
            own[at:at] = copy
            truth[i] = item[0]
        rows.append((i, " ".join(own)))
    return rows, items, truth


def test_recall_and_precision(spark):
    rows, items, truth = made()
    docs = spark.createDataFrame([*rows, (900, None), (None, items[3][1].upper())], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (3, items[3][1]), (None, "x")], "item_id long, text string")
    got = {r.doc_id: r for r in d.searched(docs, bench, SMALL).collect()}
    found = {i for i, r in got.items() if r.contaminated and i is not None}
    assert len(found & set(truth)) >= 0.95 * len(truth) and not found - set(truth)
    assert all(got[i].item_id == truth[i] for i in found)
    assert got[None].item_id == 3 and not got[900].contaminated


def test_blocks_of_items_give_the_same(spark):
    rows, items, _ = made(5)
    docs, bench = spark.createDataFrame(rows[:80], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: r.item_id for r in d.searched(docs, bench, SMALL).collect() if r.contaminated}
    split = {r.doc_id: r.item_id for r in d.searched(docs, bench, d.Settings(**{**SMALL.__dict__, "block_items": 7})).collect() if r.contaminated}
    assert len(whole) >= 12 and len(set(whole.items()) ^ set(split.items())) <= 1


def planted(sizes, replaced, copies, seed=8):
    """Documents with one item each, a share of its words replaced: rows, items, and the ids that a search of every window finds."""
    r = random.Random(seed)
    words = ["the", "of", "and", "to"] * 150 + ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate(sizes)]
    rows = []
    for k, text in items * copies:
        copy = text.split()
        for at in r.sample(range(len(copy)), int(replaced * len(copy))):
            copy[at] = r.choice(words)
        own = [r.choice(words) for _ in range(r.randint(100, 700))]
        at = r.randint(0, len(own))
        own[at:at] = copy
        rows.append((len(rows), " ".join(own)))
    s, truth = d.Settings(), set()
    for i, text in rows:
        k, text = items[i % len(items)][0], text.split()
        item = d.Item(k, items[k][1].split(), d.answer_of(items[k][1].split()))
        shares = [d.checked(item, text, at, s) for at in range(0, len(text), s.step)]
        if any(a >= s.copied or (a >= s.copied_with_answer and b >= s.answer) for a, b in shares):
            truth.add(i)
    return rows, items, truth


def test_production_settings_against_every_window(spark):
    for sizes, replaced in (([6, 8, 12, 16] * 50, 0.0), ([200, 300] * 100, 0.3)):  # more items than dimensions
        rows, items, truth = planted(sizes, replaced, 1)
        docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        found = {r.doc_id for r in d.searched(docs, bench).collect() if r.contaminated}
        assert len(truth) >= 0.8 * len(rows) and len(found & truth) >= 0.95 * len(truth)


def test_items_after_the_first_block_are_found(spark):
    rows, items, truth = planted([8, 12, 24] * 40, 0.2, 1, seed=9)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id for r in d.searched(docs, bench, d.Settings(block_items=20, sample=16)).collect() if r.contaminated}
    later = {i for i in truth if i >= 20}
    assert len(later) >= 80 and len(found & later) >= 0.95 * len(later), (len(found & later), len(later))


def test_clean_keeps_columns_and_empty_tables(spark):
    rows, items, truth = made(6)
    docs = spark.createDataFrame([(i, t, True) for i, t in rows[:60]], "doc_id long, text string, contaminated boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.clean(docs, bench, SMALL)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows[:60]} - set(truth)
    assert d.clean(docs, bench.where("item_id > 99"), SMALL).count() == 60
    assert d.searched(docs.where("doc_id > 99999"), bench, SMALL).count() == 0


def test_singular_vectors_match_the_dense_ones(spark):
    _, items, _ = made(7)
    s = d.Settings(buckets=64, dimensions=6, common=0, oversample=10, powers=4)
    idf = np.ones(64, np.float32)
    got = d.randomised_svd(spark.createDataFrame([(t,) for _, t in items], "text string"), idf, s, d.work_dir(spark, "svd"))
    a = np.zeros((20, 64))
    for k, (_, t) in enumerate(items):
        ids, x = d._weighted(t, idf)
        a[k, ids] = x
    want = np.linalg.svd(a)[1][:6]
    assert np.allclose(1 / np.linalg.norm(got, axis=0), want, rtol=0.05)


def test_short_items_null_ids_and_long_texts(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(5)) for k in range(20)] + [(None, "alpha beta gamma"), (None, text(25)), (50, "  "), (51, "zeta")]
    rows = [(k, f"{text(60)} {items[k][1].upper()}, {text(60)}") for k in range(20)]
    rows += [(30, f"{text(9)} Alpha beta «gamma». {text(4)}"), (31, "alpha gamma beta"), (32, f"{text(50)} {items[21][1]} {text(30)}"), (33, text(90_000) + " " + items[21][1]), (34, text(40)), (35, "zeta")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in d.searched(docs, bench, carry=["doc_id", "item_id"]).collect()}
    assert all(got[k].contaminated and got[k].item_id == k for k in range(20))
    assert [(k, got[k].contaminated, got[k].item_id) for k in (30, 32, 33)] == [(k, True, None) for k in (30, 32, 33)], got[33]
    assert not got[31].contaminated and not got[34].contaminated and got[35].item_id == 51
    again = {x.doc_id: (x.contaminated, x.item_id) for x in d.searched(docs, bench, d.Settings(block_items=5)).collect()}
    assert again == {k: (x.contaminated, x.item_id) for k, x in got.items()}


def test_ids_of_any_type_and_names_in_any_case(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    item = text(20)
    docs = [(1, f"lead in {item} and out", "c"), (2, "nothing of it " * 9, "d"), (3, None, "e")] + [(k, text(60), None) for k in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id int, text string, Contaminated string")
    items = spark.createDataFrame([("b", item), ("a", item), (None, item)] + [(f"x{k}", text(20)) for k in range(30)], "item_id string, text string")
    out = d.searched(df, items, carry=["doc_id", "Contaminated"])
    assert out.columns == ["doc_id", *d.NAMES]
    assert [(x.doc_id, x.item_id) for x in out.where("contaminated").collect()] == [(1, "a")]
    blocks = d.searched(df, items, d.Settings(block_items=7))
    assert [(x.doc_id, x.item_id) for x in blocks.where("contaminated").collect()] == [(1, "a")]


def test_orthonormal_basis():
    r = np.random.default_rng(2)
    a = (r.normal(size=(3000, 12)) @ np.diag(10.0 ** -np.arange(12)) @ r.normal(size=(12, 12))).astype(np.float32)
    q = d.orthonormal(a)
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-4
    assert np.abs(a - q @ (q.T @ a)).max() < 1e-3 * np.abs(a).max()


def test_space_is_fitted_on_every_word(spark):
    """What only stands in the middle of long texts is in the space, wherever in the table they are."""
    r = random.Random(15)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(k, f"{text(96)} rare{k} {text(95)}") for k in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(0, text(20))], "item_id long, text string")
    s = d.Settings(buckets=1 << 14, sample=16)
    _, space, _ = d._fitted(docs.select("text"), items, s, "item_id", "text")
    got = [np.abs(space[d.bucket(f"rare{k}", s.buckets)]).max() for k in range(300)]
    assert min(got) > 0


def test_windows_of_buckets_are_those_of_words():
    r = np.random.default_rng(4)
    space, step = r.normal(size=(1 << 12, 5)).astype(np.float32), 16
    texts = [[f"w{k}" for k in r.integers(0, 900, n)] for n in (1, 15, 16, 17, 40, 5000, 32, 1)]
    vectors, begin = d._vectors([np.array([d.bucket(w, len(space)) for w in words], np.uint16) for words in texts], space, step)
    for k, words in enumerate(texts):
        assert np.allclose(vectors[begin[k] : begin[k + 1]], d.windows(words, d.Vectors(space), step), atol=1e-4)


def test_products_of_passages_need_no_sorting(monkeypatch):
    """The product over passages is that of their dense matrix, and buckets are gathered without a sort."""
    r = np.random.default_rng(4)
    sizes = r.integers(1, 40, 200)
    starts, ids = np.append(0, np.cumsum(sizes)[:-1]), r.integers(0, 500, sizes.sum())
    weight, idf, own = r.random(200).astype(np.float32), r.random(512).astype(np.float32) + 0.1, r.normal(size=(512, 9)).astype(np.float32)
    x = np.zeros((200, 512))
    np.add.at(x, (np.repeat(np.arange(200), sizes), ids), 1)
    x *= idf
    x *= weight[:, None] / np.linalg.norm(x, axis=1)[:, None]

    def sorts(*a, **k):
        raise AssertionError("sorted")

    monkeypatch.setattr(np, "unique", sorts)
    out = np.zeros((512, 9), np.float32)
    d._add_product(out, ids, starts, weight, idf, own)
    assert np.allclose(out, x.T @ (x @ own), atol=1e-4)
