"""A small sandboxed template language for chat formatting.

Source is parsed into a syntax tree, constants are folded, and the tree becomes
Python closures. Output is a stream of ``(text, generated)`` pieces, so loops may
run over iterators and a rendering need not fit in memory.

``{{ expression }}``, ``{% for x in xs %}``, ``{% if %} {% elif %} {% else %}``,
``{% set x = expression %}``, ``{% generation %}`` (what is generated by the
model), ``{# comment #}``; ``-`` next to a delimiter trims white space there.
Expressions have literals, names, ``a.b`` and ``a['b']`` on mappings and lists
only, ``not and or``, comparisons, ``in``, ``+ - * // %``, ``~`` and filters.
There are no calls and no attributes of Python objects, so a template can reach
nothing that it wasn't given.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

Piece = tuple[str, bool]
Scope = dict[str, Any]


class TemplateError(ValueError):
    """The source isn't a template, or an expression has no value."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class If:
    tests: tuple  # of (expression, body)


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "//": operator.floordiv, "%": operator.mod,
    "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b, "not": operator.not_, "neg": operator.neg,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, a, b: _text(x).replace(a, b),
}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-<>+*%~|.,()\[\]]))")
_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_MOST_LITERAL = 1 << 16


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(next((k, x) for k, x in enumerate(m.groups()) if x is not None))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == 1:
            return None
        return self.tokens[self.at][1]

    def next(self) -> tuple[int, str]:
        if self.at >= len(self.tokens):
            raise TemplateError(f"unfinished expression {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, token: str) -> None:
        if self.peek() != token:
            raise TemplateError(f"{token!r} is missing in {self.source!r}")
        self.at += 1

    def whole(self) -> Any:
        x = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over in {self.source!r}")
        return x

    def either(self) -> Any:
        x = self.both()
        while self.peek() == "or":
            self.at += 1
            x = Op("or", (x, self.both()))
        return x

    def both(self) -> Any:
        x = self.negated()
        while self.peek() == "and":
            self.at += 1
            x = Op("and", (x, self.negated()))
        return x

    def negated(self) -> Any:
        if self.peek() == "not":
            self.at += 1
            return Op("not", (self.negated(),))
        return self.compared()

    def compared(self) -> Any:
        x = self.level(("~", "+", "-"), lambda: self.level(("*", "//", "%"), self.filtered))
        op = self.peek()
        if op in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            return Op(op, (x, self.level(("~", "+", "-"), lambda: self.level(("*", "//", "%"), self.filtered))))
        if op == "not":
            self.at += 1
            self.expect("in")
            return Op("not", (Op("in", (x, self.compared())),))
        return x

    def level(self, ops: tuple[str, ...], below: Callable) -> Any:
        x = below()
        while (op := self.peek()) in ops:
            self.at += 1
            x = Op(op, (x, below()))
        return x

    def filtered(self) -> Any:
        x = self.atom()
        while (t := self.peek()) in (".", "[", "|"):
            self.at += 1
            if t == "[":
                x = Get(x, self.either())
                self.expect("]")
                continue
            kind, name = self.next()
            if t == "." and kind in (0, 2):
                x = Get(x, Lit(int(name) if kind == 0 else name))
            elif t == "|" and kind == 2:
                args = []
                if self.peek() == "(":
                    self.at += 1
                    while self.peek() != ")":
                        args.append(self.either())
                        if self.peek() != ")":
                            self.expect(",")
                    self.at += 1
                x = Filter(x, name, tuple(args))
            else:
                raise TemplateError(f"a name is missing in {self.source!r}")
        return x

    def atom(self) -> Any:
        kind, token = self.next()
        if kind == 0:
            return Lit(int(token))
        if kind == 1:
            return Lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == 2:
            fixed = {"true": True, "false": False, "none": None}
            return Lit(fixed[token.lower()]) if token.lower() in fixed else Name(token)
        if token == "(":
            x = self.either()
            self.expect(")")
            return x
        if token == "-":
            return Op("neg", (self.filtered(),))
        raise TemplateError(f"unexpected {token!r} in {self.source!r}")


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of statements."""
    parts = _PARTS.split(source)
    for k in range(1, len(parts), 2):
        if parts[k].startswith(("{{-", "{%-")):
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k].endswith(("-}}", "-%}")):
            parts[k + 1] = parts[k + 1].lstrip()
    stack: list[list] = [["root", None, []]]
    for k, part in enumerate(parts):
        body = stack[-1][2]
        if k % 2 == 0:
            if part:
                body.append(Out(Lit(part)))
        elif part.startswith("{{"):
            body.append(Out(_Expression(part[2:-2].strip("-")).whole()))
        elif part.startswith("{%"):
            _statement(stack, part[2:-2].strip("-").strip())
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return tuple(stack[0][2])


def _statement(stack: list[list], code: str) -> None:
    word, _, rest = code.partition(" ")
    if word == "for":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"can't read {code!r}")
        stack.append(["for", (m[1], _Expression(m[2]).whole()), []])
    elif word == "if":
        stack.append(["if", [[_Expression(rest).whole(), None]], []])
    elif word in ("elif", "else"):
        kind, tests, body = stack[-1]
        if kind != "if":
            raise TemplateError(f"{word} outside an if")
        tests[-1][1] = tuple(body)
        tests.append([_Expression(rest).whole() if word == "elif" else Lit(True), None])
        stack[-1][2] = []
    elif word == "set":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"can't read {code!r}")
        stack[-1][2].append(Set(m[1], _Expression(m[2]).whole()))
    elif word == "generation":
        stack.append(["generation", None, []])
    elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
        kind, extra, body = stack.pop()
        if kind == "for":
            node: Any = For(*extra, tuple(body))
        elif kind == "if":
            extra[-1][1] = tuple(body)
            node = If(tuple(map(tuple, extra)))
        else:
            node = Generation(tuple(body))
        stack[-1][2].append(node)
    else:
        raise TemplateError(f"unknown statement {code!r}")


def fold(node: Any, filters: dict[str, Callable] = FILTERS) -> Any:
    """Constants computed ahead: operators and filters of literals, decided ifs, adjacent texts."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x, filters)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Out) and isinstance(y.value, Lit):
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Lit):
                        out[-1] = Out(Lit(_text(out[-1].value.value) + _text(y.value.value)))
                        continue
                    y = Out(Lit(_text(y.value.value)))
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.name in ("and", "or") and isinstance(args[0], Lit):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        return _known(Op(node.name, args), args, OPS.get(node.name))
    if isinstance(node, Filter):
        args = tuple(fold(a, filters) for a in (node.of, *node.args))
        return _known(Filter(args[0], node.name, args[1:]), args, filters.get(node.name))
    if isinstance(node, Get):
        return Get(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Out):
        return Out(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.of, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        tests = []
        for test, body in node.tests:
            test = fold(test, filters)
            if isinstance(test, Lit) and not test.value:
                continue
            tests.append((test, fold(body, filters)))
            if isinstance(test, Lit):
                break
        if not tests:
            return ()
        return tests[0][1] if isinstance(tests[0][0], Lit) else If(tuple(tests))
    return node


def _known(node: Any, args: tuple, f: Callable | None) -> Any:
    if f is None or not all(isinstance(a, Lit) for a in args):
        return node
    try:
        value = f(*(a.value for a in args))
    except Exception:  # it fails when, and only if, it is rendered
        return node
    return node if isinstance(value, str) and len(value) > _MOST_LITERAL else Lit(value)


def _expression(node: Any, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    if isinstance(node, Lit):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Get):
        of, key = _expression(node.of, filters), _expression(node.key, filters)

        def get(scope: Scope) -> Any:
            x, k = of(scope), key(scope)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int):
                return x[k] if -len(x) <= k < len(x) else None
            return None

        return get
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        f, args = filters[node.name], [_expression(a, filters) for a in (node.of, *node.args)]
        return _guarded(lambda scope: f(*(a(scope) for a in args)), node.name)
    args = [_expression(a, filters) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    op = OPS[node.name]
    return _guarded(lambda scope: op(*(a(scope) for a in args)), node.name)


def _guarded(f: Callable[[Scope], Any], name: str) -> Callable[[Scope], Any]:
    def run(scope: Scope) -> Any:
        try:
            return f(scope)
        except TypeError as e:
            raise TemplateError(f"{name}: {e}") from None

    return run


def _body(nodes: tuple, filters: dict[str, Callable], generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    runs = [_run(n, filters, generated) for n in nodes]

    def body(scope: Scope) -> Iterator[Piece]:
        for run in runs:
            yield from run(scope)

    return body


def _run(node: Any, filters: dict[str, Callable], generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    if isinstance(node, Out):
        value = _expression(node.value, filters)

        def out(scope: Scope) -> Iterator[Piece]:
            if text := _text(value(scope)):
                yield text, generated

        return out
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value, filters)

        def put(scope: Scope) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        tests = [(_expression(t, filters), _body(b, filters, generated)) for t, b in node.tests]

        def choose(scope: Scope) -> Iterator[Piece]:
            for test, body in tests:
                if test(scope):
                    return body(scope)
            return iter(())

        return choose
    of, body, name = _expression(node.of, filters), _body(node.body, filters, generated), node.name

    def loop(scope: Scope) -> Iterator[Piece]:
        items, outer, index, end = iter(of(scope) or ()), {k: scope.get(k) for k in (name, "loop")}, 0, object()
        item = next(items, end)
        while item is not end:
            after = next(items, end)
            scope[name] = item
            scope["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": after is end}
            yield from body(scope)
            item, index = after, index + 1
        scope.update(outer)

    return loop


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function from the template's variables to its pieces of output."""
    known = FILTERS | (filters or {})
    body = _body(fold(parse(source), known), known, False)
    return lambda **variables: body(dict(variables))
