import hashlib
import random
import re

from folioscope.llm import personal_data as p

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return kind == "email" or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15)


def base(text):
    out = [(m.start(), p.KINDS.index(k), m.end(), k) for k in p.KINDS for m in re.finditer(RAW[k], text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def texts(seed=1, n=250):
    r = random.Random(seed)
    fixed = ["a@b.c_d@e.f", "a@b@c.d x@y", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "+1 (555) 010-9999 tel: +49.30.123456-7", "4111 1111-1111 1111 4111111111111112", "é😀 joe@x.org,1.1.1.1", None, "", "+", "@", "1" * 30_000, "a" * 60_000, "1-" * 9000 + "1", "x@y.z " * 3000, "a.b@" * 4000]
    alphabet = "ab@.+-_ 0123456789()é%"
    return fixed + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_base_spans_match_the_patterns(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in p.summarised(p.personal_spans(df)).collect()}
    for i, t in rows:
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in p.KINDS] == [want.count(f"{k}:") for k in p.KINDS]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_trees_add_what_looks_like_confirmed_spans(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        plain = f"{r.randint(1, 9)}{r.randint(10**8, 10**9 - 1)}" if i % 2 else "no number"
        rows.append((i, f"call me +1 (555) 01{r.randint(0, 9)}-{r.randint(1000, 9999)} or mail joe{i}@mail.org then id {plain}"))
    rows.append((1000, "call me joe(at)mail.org"))
    found = {x.doc_id: x.spans for x in p.summarised(p.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(found[i].count(",") == 1 for i in range(0, 600, 2)), "bare numbers aren't added"
    assert found[1000] == "email:8:23"


def test_forms_beyond_the_base_patterns(spark):
    right = ["ask rob(at)club.org", "mail eva [at] haus.de", "Tel. 040 765 43 21", "call 555-010-4444", "at (617) 555-0111 now", "card 4000.0566.5566.5556"]
    wrong = ["sat (at) table. Then", "order 9876543210 came", "ISBN 978-1-86197-876-9", "in 2021-05-06 11", "trace 8007782375593431", "card 4000.0566.5566.5557", "1 234 567 890 of them", "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""]
    df = spark.createDataFrame(list(enumerate(right + wrong)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in p.summarised(p.personal_spans(df)).collect()}
    assert [t for i, t in enumerate(right) if not got[i]] == []
    assert [t for i, t in enumerate(wrong) if got[i + len(right)]] == []


def test_boosting_separates():
    rows = [{**dict.fromkeys(p.BINS, 0), "plus": a, "digits": b, "n": 50, "y": 50 * (a ^ (b > 2))} for a in (0, 1) for b in range(7)]
    start, trees = p.boosted(rows, p.Settings())
    assert all((start + 0.3 * sum(p._value(t, r) for t in trees) > 0) == bool(r["y"]) for r in rows)


def test_redaction_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é joe@x.org, 1.2.3.4!"), (1, None)], "doc_id long, text string")
    assert sorted(r.text for r in p.redacted(df).collect()) == ["", "é [email], [ip]!"]
    assert p.personal_spans(df.where("doc_id > 3")).count() == 0
