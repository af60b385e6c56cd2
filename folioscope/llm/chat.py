"""Chat formatting: conversations rendered by a template, with a loss mask.

Turns are dealt by conversation and sorted; each conversation streams through
the compiled template, and comes out in parts of bounded length with the spans
that the template marks as generated. Texts and roles are escaped so that no
control string can appear in them: ``\\`` becomes ``\\\\`` and a control string
gets a ``\\`` after its first character; a ``\\`` before any character is dropped
when reading back.

Defined results: a null text or role is empty; turns are ordered by number
(nulls first), role and text; repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .template import compiled

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[GEN]", "[ROLE]", "[/ROLE]")
TEMPLATE = """
{%- for m in messages -%}
    {%- if m.role == 'user' -%}
        {{ '<s>[INST] ' }}{{ m.text | escape }}{{ ' [/INST]' }}
    {%- elif m.role == 'assistant' -%}
        {{ '<s>[GEN]' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
    {%- elif m.role == 'system' -%}
        {{ '<s><<SYS>>' }}{{ m.text | escape }}{{ '<</SYS>>' }}
    {%- else -%}
        {{ '<s>[ROLE]' }}{{ m.role | escape }}{{ '[/ROLE]' }}{{ m.text | escape }}{{ '</s>' }}
    {%- endif -%}
{%- endfor -%}
"""
#: A whole turn as the template writes it.
_TURN = re.compile(
    r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[GEN\](?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>)",
    re.S,
)
_ENDS = ("[/INST]", "</s>", "<</SYS>>")
#: Code points of output in one row.
PART_CHARS = 1 << 20


def escape(text: str | None) -> str:
    text = (text or "").replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parts_of(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Rendered pieces as parts: text, and starts and ends of its generated spans."""
    texts, starts, ends, n = [], [], [], 0
    for piece, generated in pieces:
        for at in range(0, len(piece), PART_CHARS):
            text = piece[at : at + PART_CHARS]
            if n and n + len(text) > PART_CHARS:
                yield "".join(texts), starts, ends
                texts, starts, ends, n = [], [], [], 0
            if generated:
                starts.append(n)
                ends.append(n + len(text))
            texts.append(text)
            n += len(text)
    yield "".join(texts), starts, ends


_PARTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("mask_starts", T.ArrayType(T.IntegerType())),
        T.StructField("mask_ends", T.ArrayType(T.IntegerType())),
    ]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def formatted(df: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, part, formatted, mask_starts, mask_ends``; parts of a conversation follow each other."""
    key = df.schema[conv_id].dataType
    schema = T.StructType([T.StructField("conv_id", key), *_PARTS.fields])
    dealt = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compiled(template, {"escape": escape})
        out: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            types = [None, pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            ids = pa.array([r[0] for r in out], kind)
            return pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in out], types[k]) for k in range(1, 5)]], names=schema.names)

        kind = None
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type
        for conv, turns in itertools.groupby(_rows(itertools.chain([first], batches)), lambda r: r[0]):
            messages = ({"role": r[1] or "", "text": r[2] or ""} for r in turns)
            for part, (text, starts, ends) in enumerate(parts_of(run(messages=messages))):
                out.append((conv, part, text, starts, ends))
                size += len(text)
                if size > PART_CHARS:
                    yield batch_of()
                    out, size = [], 0
        if out:
            yield batch_of()

    return dealt.mapInArrow(render, schema)


class Reader:
    """Reads a formatted conversation back, part by part, holding one turn at a time."""

    def __init__(self) -> None:
        self.turns = hashlib.sha256()
        self.loss = hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.left: list[str] = []
        self.pending = ""  # an escape cut in two
        self.tail = ""

    def feed(self, text: str, starts: list[int], ends: list[int]) -> None:
        self.chars += len(text)
        for a, b in zip(starts, ends, strict=True):
            masked = self.pending + text[a:b]
            odd = len(masked) - len(masked.rstrip("\\"))
            self.pending = "\\" if odd % 2 else ""
            plain = unescape(masked[: len(masked) - len(self.pending)])
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(plain)
        self.left.append(text)
        self.tail = (self.tail + text)[-(len(text) + 8) :]  # an end can be cut in two
        if any(e in self.tail for e in _ENDS):
            self.drain()
        self.tail = self.tail[-8:]

    def drain(self) -> None:
        text, at = "".join(self.left), 0
        while m := _TURN.match(text, at):
            role = m.lastgroup if m["role"] is None else unescape(m["role"])
            body = unescape(m["text"] if m["role"] is not None else m[m.lastgroup])
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            at = m.end()
        self.left = [text[at:]]

    def result(self) -> tuple:
        self.drain()
        if self.left[0]:
            raise ValueError(f"not a formatted conversation: {self.left[0][:80]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, from the output of ``formatted`` alone."""
    schema = T.StructType(
        [
            parts.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names=schema.names)

        for conv, rows in itertools.groupby(_rows(itertools.chain([first], batches)), lambda r: r[0]):
            reader = Reader()
            for _, _, text, starts, ends in rows:
                reader.feed(text, starts, ends)
            out.append((conv, *reader.result()))
            if len(out) == 4096:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return parts.mapInArrow(read, schema)
