import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import chat
from folioscope.llm.template import Lit, Out, TemplateError, compiled, fold, parse

ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("\\<>[]/s")), max_size=20)
TEXT = st.lists(st.one_of(ODD, st.sampled_from(chat.CONTROL)), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=6), st.integers(1, 30))
def test_round_trip_in_parts(turns, part_chars):
    run = compiled(chat.TEMPLATE, {"escape": chat.escape})
    whole, chat.PART_CHARS = chat.PART_CHARS, part_chars
    try:
        reader, text = chat.Reader(), ""
        for part in chat.parts_of(run(messages=iter([{"role": r, "text": t} for r, t in turns]))):
            reader.feed(*part)
            text += part[0]
    finally:
        chat.PART_CHARS = whole
    said = "".join(t for r, t in turns if r == "assistant")
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert reader.result() == (len(turns), want, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text))


def test_frame(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "user", "n"), (3, None, "user", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\na\nassistant\nb</s>\n") and got[1].loss_sha256 == digest("b</s>") and got[1].loss_chars == 5
    assert got[2].turns_sha256 == digest("\n\n") and got[3].n_turns == 2 and got[None].n_turns == 1
    assert chat.read_back(chat.formatted(df.where("turn > 9"))).count() == 0


def said(source, **variables):
    return "".join(t for t, _ in compiled(source)(**variables))


def test_language():
    assert said("a {#- no -#} b") == "a  b"
    assert said("{% for x in xs %}{{ loop.index }}{{ x.n }}{% if not loop.last %},{% endif %}{% endfor %}", xs=iter([{"n": 1}, {"n": 2}])) == "11,22"
    assert said("{% set a = 2 * 3 + 1 %}{{ a ~ 'x' | upper }}{{ 'q' in 'pq' and b['k'] | default('d') }}", b={}) == "7Xd"
    assert list(compiled("a{% generation %}b{{ x }}{% endgeneration %}c")(x=1)) == [("a", False), ("b", True), ("1", True), ("c", False)]


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}x{% elif 'q' %}d{% else %}{{ y }}{% endif %}")) == (Out(Lit("abcd")),)
    assert fold(parse("{{ 1 + 1 | length }}"))[0].value.name == "+"


@pytest.mark.parametrize("source", ["{% if x %}", "{{ 1 + }}", "{{ x | nothing }}", "{% endfor %}", "{{ x.y() }}", "{% what %}"])
def test_bad_sources(source):
    with pytest.raises(TemplateError):
        said(source, x={})


def test_sandbox():
    assert said("{{ x.__class__ }}{{ x['__class__'] }}{{ 'a'.upper }}", x={}) == ""
    with pytest.raises(TemplateError):
        said("{{ x + 1 }}", x="a")
