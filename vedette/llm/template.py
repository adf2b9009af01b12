"""A small sandboxed template language compiled to Python closures.

Syntax: `{{ expression }}`, `{% if e %} {% elif e %} {% else %} {% endif %}`, `{% for x in e %} {% endfor %}`,
`{% set x = e %}`, `{% generation %} {% endgeneration %}` and `{# comment #}`; a `-` inside a delimiter trims the
white space on its side. Expressions: string and whole-number literals, true, false, none, names, `.name` and `[e]`
(of dictionaries and lists only), `+`, `==`, `!=`, `<`, `<=`, `>`, `>=`, `and`, `or`, `not`, `in`, parentheses and
the filters in FILTERS. There are no calls and no attributes of Python objects, so a template can reach its
variables and nothing else. Inside a loop, `loop` has index, index0, first and last.

Compilation: source -> tokens -> syntax tree (tuples) -> constants folded -> closures. Rendering is lazy: it yields
(text, in_generation) pieces and takes a loop's items one at a time (one ahead, for `loop.last`), so a conversation
of any length needs the memory of two turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Node = tuple
Scope = dict[str, Any]

_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+<>=.|()\[\],]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """What is wrong with a template, or with the use of a value in it."""


def _string(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.S)


def _as_text(value: Any) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _as_text(v).strip(),
    "upper": lambda v: _as_text(v).upper(),
    "lower": lambda v: _as_text(v).lower(),
    "capitalize": lambda v: _as_text(v)[:1].upper() + _as_text(v)[1:],
    "length": lambda v: len(v),
    "string": _as_text,
}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str, filters: dict[str, Callable]) -> None:
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.filters = 0, filters

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.inverse()
        while self.take("and"):
            node = ("and", node, self.inverse())
        return node

    def inverse(self) -> Node:
        return ("not", self.inverse()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = ("compare", sign, node, self.added())
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def reached(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("value", self.name()))
            elif self.take("["):
                node = ("item", node, self.either())
                self.need("]")
            else:
                return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("value", _string(text))
        if kind == "number":
            return ("value", int(text))
        if kind == "name":
            return ("value", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str, filters: dict[str, Callable] | None = None) -> Node:
    """The syntax tree: ("block", [nodes])."""
    filters = FILTERS | (filters or {})
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m and m[0].endswith("-") else text))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        # strings inside a tag may hold the closing sign
        end, i = -1, m.end()
        while i < len(source):
            if source.startswith(close, i):
                end = i
                break
            if m[0][:2] != "{#" and source[i] in "'\"":
                q = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", re.S).match(source, i)
                i = q.end() if q else i + 1
            else:
                i += 1
        if end < 0:
            raise TemplateError(f"{m[0]!r} is never closed")
        inner = source[m.end() : end]
        trim = inner.endswith("-")
        parts.append((m[0][:2], inner.removesuffix("-").strip()))
        at = end + 2
    root: list[Node] = []
    stack: list[tuple[str, list[Node], Any]] = [("", root, None)]
    for kind, inner in parts:
        body = stack[-1][1]
        if kind == "text":
            if inner:
                body.append(("out", ("value", inner)))
        elif kind == "{{":
            body.append(("out", _Expression(inner, filters).whole()))
        elif kind == "{%":
            word, _, rest = inner.partition(" ")
            if word == "if":
                arms: list[tuple[Node, list[Node]]] = [(_Expression(rest, filters).whole(), [])]
                body.append(("if", arms))
                stack.append(("if", arms[0][1], arms))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                arms = stack.pop()[2]
                arms.append((("value", True) if word == "else" else _Expression(rest, filters).whole(), []))
                stack.append(("if", arms[-1][1], arms))
            elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                inside: list[Node] = []
                body.append(("for", m[1], _Expression(m[2], filters).whole(), inside))
                stack.append(("for", inside, None))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)):
                body.append(("set", m[1], _Expression(m[2], filters).whole()))
            elif word == "generation":
                inside = []
                body.append(("generation", inside))
                stack.append(("generation", inside, None))
            elif word.startswith("end") and word[3:] == stack[-1][0] and len(stack) > 1:
                stack.pop()
            else:
                raise TemplateError(f"unexpected tag {inner!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is never ended")
    return ("block", root)


def fold(node: Any, filters: dict[str, Callable] | None = None) -> Any:
    """The same tree with constant expressions worked out, dead branches gone and neighbouring texts joined."""
    filters = FILTERS | (filters or {})

    def body(nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in map(go, nodes):
            for x in n[1] if n[0] == "block" else [n]:
                if out and x[0] == "out" == out[-1][0] and x[1][0] == "value" == out[-1][1][0]:
                    out[-1] = ("out", ("value", _as_text(out[-1][1][1]) + _as_text(x[1][1])))
                elif not (x[0] == "out" and x[1] == ("value", "")):
                    out.append(x)
        return out

    def go(n: Node) -> Node:
        kind = n[0]
        if kind in ("value", "name"):
            return n
        if kind == "block":
            return ("block", body(n[1]))
        if kind == "generation":
            return ("generation", body(n[1]))
        if kind == "for":
            return ("for", n[1], go(n[2]), body(n[3]))
        if kind == "set":
            return ("set", n[1], go(n[2]))
        if kind == "out":
            x = go(n[1])
            return ("out", ("value", _as_text(x[1])) if x[0] == "value" else x)
        if kind == "if":
            arms = []
            for test, inside in n[1]:
                test = go(test)
                if test[0] == "value" and not test[1]:
                    continue
                arms.append((test, body(inside)))
                if test[0] == "value":
                    break
            if not arms:
                return ("block", [])
            return ("block", arms[0][1]) if arms[0][0][0] == "value" else ("if", arms)
        parts = tuple(go(x) if isinstance(x, tuple) else x for x in n[1:])
        if all(x[0] == "value" for x in parts if isinstance(x, tuple)):
            try:
                return ("value", _value((kind, *parts), filters)({}))
            except TemplateError:
                pass  # it fails where and if it is reached
        return (kind, *parts)

    return go(node)


def _value(n: Node, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    """A closure that gives an expression's value."""
    kind = n[0]
    if kind == "value":
        constant = n[1]
        return lambda scope: constant
    if kind == "name":
        name = n[1]
        return lambda scope: scope.get(name)
    if kind == "not":
        inner = _value(n[1], filters)
        return lambda scope: not inner(scope)
    if kind == "filter":
        inner, use = _value(n[2], filters), filters[n[1]]
        return lambda scope: use(inner(scope))
    if kind == "compare":
        sign, a, b = n[1], _value(n[2], filters), _value(n[3], filters)
        tests = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "in": lambda x, y: x in y}
        test = tests[sign]

        def compared(scope: Scope) -> bool:
            try:
                return test(a(scope), b(scope))
            except TypeError as e:
                raise TemplateError(str(e)) from None

        return compared
    a, b = _value(n[1], filters), _value(n[2], filters)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "add":

        def added(scope: Scope) -> Any:
            x, y = a(scope), b(scope)
            return x + y if isinstance(x, int) and isinstance(y, int) else _as_text(x) + _as_text(y)

        return added

    def item(scope: Scope) -> Any:
        x, key = a(scope), b(scope)
        if isinstance(x, dict):
            return x.get(key)
        if isinstance(x, list) and isinstance(key, int):
            return x[key] if -len(x) <= key < len(x) else None
        raise TemplateError(f"no item {key!r}")

    return item


Piece = tuple[str, bool]


def _statement(n: Node, filters: dict[str, Callable]) -> Callable[[Scope, bool], Iterator[Piece]]:
    kind = n[0]
    if kind == "out":
        value = _value(n[1], filters)

        def out(scope: Scope, made: bool) -> Iterator[Piece]:
            yield _as_text(value(scope)), made

        return out
    if kind == "set":
        name, value = n[1], _value(n[2], filters)

        def put(scope: Scope, made: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return put
    if kind == "if":
        arms = [(_value(test, filters), _body(inside, filters)) for test, inside in n[1]]

        def chosen(scope: Scope, made: bool) -> Iterator[Piece]:
            for test, inside in arms:
                if test(scope):
                    yield from inside(scope, made)
                    return

        return chosen
    if kind == "generation":
        inside = _body(n[1], filters)
        return lambda scope, made: inside(scope, True)
    name, items, inside = n[1], _value(n[2], filters), _body(n[3], filters)

    def each(scope: Scope, made: bool) -> Iterator[Piece]:
        coming = items(scope)
        if coming is None:
            return
        if isinstance(coming, (str, dict)) or not isinstance(coming, Iterable):
            raise TemplateError("a loop needs a list")
        outer = {k: scope[k] for k in (name, "loop") if k in scope}
        source, k, end = iter(coming), 0, object()
        now = next(source, end)
        while now is not end:
            after = next(source, end)
            scope[name], scope["loop"] = now, {"index": k + 1, "index0": k, "first": k == 0, "last": after is end}
            yield from inside(scope, made)
            now, k = after, k + 1
        for x in (name, "loop"):
            scope.pop(x, None)
        scope.update(outer)

    return each


def _body(nodes: list[Node], filters: dict[str, Callable]) -> Callable[[Scope, bool], Iterator[Piece]]:
    made_of = [_statement(n, filters) for n in nodes]

    def run(scope: Scope, made: bool) -> Iterator[Piece]:
        for statement in made_of:
            yield from statement(scope, made)

    return run


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, in_generation) pieces."""
    known = FILTERS | (filters or {})
    run = _body(fold(parse(source, known), known)[1], known)
    return lambda **variables: run(dict(variables), False)
