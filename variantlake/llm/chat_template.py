"""A sandboxed template language for conversations, compiled to Python closures.

Text stands for itself. ``{{ expression }}`` prints a value, ``{# ... #}`` is a comment,
and tags are ``{% for x in list %} ... {% endfor %}``, ``{% if a %} ... {% elif b %} ...
{% else %} ... {% endif %}``, ``{% set x = a %}`` and ``{% generation %} ...
{% endgeneration %}``, which marks what a model is to learn. A ``-`` inside a bracket
removes white space on its side. Expressions have strings, integers, ``true``, ``false``,
``none``, lists, names, ``a.b`` and ``a['b']``, ``not and or``, comparisons, ``in``, ``+ - %``,
``~`` (joins as text), ``a if b else c`` and the filters of ``FILTERS``. A loop has
``loop.index, index0, first, last``.

Sandbox: a name or a dot reaches keys of mappings only, never a Python attribute; there
are no calls, imports, products or ranges, so work and memory follow the template and its
values. A wrong template raises ``TemplateError`` before anything is rendered.

A template becomes a syntax tree of tuples, its constant parts are folded, and each node
becomes a closure. Rendering is a generator of ``(text, is generation)``, so a loop over
an iterator holds one item at a time (and the next, for ``loop.last``).

Defined cases: a missing key and an unknown name are none; none prints as nothing; a
text that is no template is itself; an empty template renders nothing.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

OPEN = re.compile(r"\{\{-?|\{%-?|\{#-?")
TOKEN = re.compile(
    r"\s*(?:(?P<close>-?\}\}|-?%\})|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>[0-9]+)"
    r"|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign>==|!=|<=|>=|[-<>+%~|.,\[\]()=]))",
    re.DOTALL,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
MAX_DEPTH = 50

Node = tuple
Piece = tuple[str, bool]


class TemplateError(ValueError):
    """A template that cannot be compiled, or a value that it cannot use."""


def text_of(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a value of type {type(value).__name__} cannot be printed")


class Escape:
    r"""Makes control strings harmless, reversibly: a backslash becomes two, the k-th
    control string a backslash and the k-th digit or letter. Control strings hold no
    backslash, so none is left in an escaped text or comes up at its seams."""

    CODES = "0123456789abcdefghijklmnopqrstuvwxyz"

    def __init__(self, control: tuple[str, ...]):
        if len(control) > len(self.CODES) or any("\\" in c or not c for c in control):
            raise TemplateError("control strings are not empty and have no backslash")
        self.control = control
        codes = {c: "\\" + k for c, k in zip(control, self.CODES)} | {"\\": "\\\\"}
        back = {v: k for k, v in codes.items()}
        found = re.compile("|".join(re.escape(c) for c in sorted(codes, key=len, reverse=True)))
        coded = re.compile(r"\\[\\" + self.CODES[: len(control)] + "]")
        self.escape: Callable[[str], str] = lambda s: found.sub(lambda m: codes[m[0]], s)
        self.unescape: Callable[[str], str] = lambda s: coded.sub(lambda m: back[m[0]], s)


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "default": lambda x, y: y if x is None else x,
    "replace": lambda x, a, b: text_of(x).replace(text_of(a), text_of(b)),
}


def _added(a: Any, b: Any) -> Any:
    if type(a) is type(b) and isinstance(a, (str, int, list)):
        return a + b
    raise TemplateError("only two texts, numbers or lists can be added")


def _numbers(f: Callable[[int, int], int]) -> Callable[[Any, Any], int]:
    def checked(a: Any, b: Any) -> int:
        if isinstance(a, int) and isinstance(b, int) and not (f is operator.mod and b == 0):
            return f(a, b)
        raise TemplateError("a number was expected")

    return checked


def _ordered(f: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    return lambda a, b: type(a) is type(b) and isinstance(a, (str, int)) and f(a, b)


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": _ordered(operator.lt),
    "<=": _ordered(operator.le),
    ">": _ordered(operator.gt),
    ">=": _ordered(operator.ge),
    "in": lambda a, b: isinstance(b, (str, list, tuple, dict)) and (not isinstance(b, str) or isinstance(a, str)) and a in b,
    "+": _added,
    "-": _numbers(operator.sub),
    "%": _numbers(operator.mod),
    "~": lambda a, b: text_of(a) + text_of(b),
}


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _lexed(source: str) -> Iterator[tuple[str, Any]]:
    """``("text", s)``, ``("out", tokens)`` and ``("tag", tokens)`` in order."""
    at, strip = 0, False
    while at <= len(source):
        m = OPEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m and m[0].endswith("-") else text
        if not m:
            return
        at = m.end()
        if m[0].startswith("{#"):
            end = source.find("#}", at)
            if end < 0:
                raise TemplateError("a comment is not closed")
            at, strip = end + 2, source[end - 1] == "-"
            continue
        tokens: list[tuple[str, Any]] = []
        while True:
            t = TOKEN.match(source, at)
            if not t:
                raise TemplateError(f"unexpected text at {source[at : at + 20]!r}")
            at = t.end()
            kind, value = t.lastgroup, t[t.lastgroup]
            if kind == "close":
                break
            if kind == "string":
                value = re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.DOTALL)
            tokens.append((kind, int(value) if kind == "number" else value))
        if value[-2:] != ("}}" if m[0].startswith("{{") else "%}"):
            raise TemplateError("a bracket is closed by the other kind")
        strip = value.startswith("-")
        yield ("out" if m[0].startswith("{{") else "tag"), tokens


class _Expression:
    """Recursive descent over the tokens of one bracket."""

    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("%",))

    def __init__(self, tokens: list[tuple[str, Any]], filters: dict[str, Callable[..., Any]]):
        self.tokens, self.at, self.depth, self.filters = tokens, 0, 0, filters

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def taken(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("word", "sign") and value in values:
            self.at += 1
            return value
        return None

    def needed(self, value: str) -> None:
        if not self.taken(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self) -> Node:
        node = self.choice()
        self.end()
        return node

    def choice(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("an expression is nested too deep")
        node = self.either()
        if self.taken("if"):
            test = self.either()
            node = ("choice", test, node, self.choice() if self.taken("else") else ("constant", None))
        self.depth -= 1
        return node

    def either(self) -> Node:
        node = self.both()
        while self.taken("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.taken("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        n = 0
        while self.taken("not"):
            n += 1
        node = self.binary(0)
        return node if not n else ("not", node) if n % 2 else ("not", ("not", node))

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.filtered()
        node = self.binary(level + 1)
        while True:
            at = self.at
            no = level == 0 and self.taken("not")
            sign = self.taken("in") if no else self.taken(*self.LEVELS[level])
            if not sign:
                self.at = at
                return node
            node = ("binary", sign, node, self.binary(level + 1))
            node = ("not", node) if no else node

    def filtered(self) -> Node:
        node = self.reached()
        while self.taken("|"):
            name, given = self.name(), []
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            if self.taken("("):
                given = self.listed(")")
            node = ("filter", name, node, *given)
        return node

    def reached(self) -> Node:
        node = self.atom()
        while True:
            if self.taken("."):
                node = ("item", node, ("constant", self.name()))
            elif self.taken("["):
                node = ("item", node, self.choice())
                self.needed("]")
            else:
                return node

    def listed(self, close: str) -> list[Node]:
        out: list[Node] = []
        while not self.taken(close):
            if out:
                self.needed(",")
            out.append(self.choice())
        return out

    def atom(self) -> Node:
        kind, value = self.peek()
        if kind in ("string", "number"):
            self.at += 1
            return ("constant", value)
        if self.taken("("):
            node = self.choice()
            self.needed(")")
            return node
        if self.taken("["):
            return ("list", *self.listed("]"))
        if self.taken("-"):
            return ("binary", "-", ("constant", 0), self.reached())
        word = self.name()
        known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
        return ("constant", known[word]) if word in known else ("name", word)


def parsed(source: str, filters: dict[str, Callable[..., Any]] | None = None) -> list[Node]:
    """The syntax tree of a template: a list of nodes, nested as the tags are."""
    known = FILTERS if filters is None else filters
    body: list[Node] = []
    open_tags: list[tuple[str, Any, list[Node]]] = []  # tag, what it holds, the body around it
    for kind, value in _lexed(source):
        if kind == "text":
            if value:
                body.append(("text", value))
            continue
        e = _Expression(value, known)
        if kind == "out":
            body.append(("out", e.whole()))
            continue
        tag = e.name()
        if len(open_tags) > MAX_DEPTH:
            raise TemplateError("tags are nested too deep")
        if tag == "for":
            name = e.name()
            e.needed("in")
            open_tags.append(("for", (name, e.whole()), body))
            body = []
        elif tag == "if":
            open_tags.append(("if", [(e.whole(), [])], body))
            body = open_tags[-1][1][-1][1]
        elif tag in ("elif", "else"):
            if not open_tags or open_tags[-1][0] != "if" or open_tags[-1][1][-1][0] == ("constant", True, "else"):
                raise TemplateError(f"{tag!r} stands outside an if")
            test = e.choice() if tag == "elif" else ("constant", True, "else")
            e.end()
            open_tags[-1][1].append((test, []))
            body = open_tags[-1][1][-1][1]
        elif tag == "set":
            name = e.name()
            e.needed("=")
            body.append(("set", name, e.whole()))
        elif tag == "generation":
            e.end()
            open_tags.append(("generation", None, body))
            body = []
        elif tag in ("endfor", "endif", "endgeneration"):
            e.end()
            if not open_tags or open_tags[-1][0] != tag[3:]:
                raise TemplateError(f"{tag!r} closes nothing")
            what, held, outer = open_tags.pop()
            outer.append(("for", *held, body) if what == "for" else ("if", held) if what == "if" else ("generation", body))
            body = outer
        else:
            raise TemplateError(f"unknown tag {tag!r}")
    if open_tags:
        raise TemplateError(f"{open_tags[-1][0]!r} is not closed")
    return body


def _is_constant(*nodes: Node) -> bool:
    return all(n[0] == "constant" for n in nodes)


def _folded_value(node: Node, filters: dict[str, Callable[..., Any]]) -> Node:
    kind = node[0]
    if kind in ("constant", "name"):
        return node[:2]
    head = 2 if kind in ("binary", "filter") else 1
    parts = [_folded_value(x, filters) for x in node[head:]]
    node = (*node[:head], *parts)
    if kind in ("and", "or", "choice") and _is_constant(parts[0]):
        first = parts[0][1]
        return (parts[1] if first else parts[2]) if kind == "choice" else parts[1] if bool(first) == (kind == "and") else parts[0]
    if kind != "choice" and _is_constant(*parts):
        return ("constant", _value(node, filters)({}))
    return node


def folded(body: list[Node], filters: dict[str, Callable[..., Any]] | None = None) -> list[Node]:
    """The tree with its constant parts computed: constant values and branches, printed
    constants, neighbouring texts."""
    known = FILTERS if filters is None else filters
    out: list[Node] = []

    def add(node: Node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node[0] != "text" or node[1]:
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "out":
            value = _folded_value(node[1], known)
            add(("text", text_of(value[1])) if _is_constant(value) else ("out", value))
        elif kind == "set":
            add(("set", node[1], _folded_value(node[2], known)))
        elif kind == "for":
            add(("for", node[1], _folded_value(node[2], known), folded(node[3], known)))
        elif kind == "generation":
            inner = folded(node[1], known)
            if inner:
                add(("generation", inner))
        elif kind == "if":
            branches: list[Node] = []
            for test, inner in node[1]:
                test = _folded_value(test, known)
                if not _is_constant(test):
                    branches.append((test, folded(inner, known)))
                elif test[1]:
                    branches.append((test, folded(inner, known)))
                    break
            if branches and _is_constant(branches[0][0]):
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def _value(node: Node, filters: dict[str, Callable[..., Any]]) -> Callable[[dict], Any]:
    """The closure of an expression; it takes the values of names."""
    kind = node[0]
    if kind == "constant":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "binary":
        f, a, b = BINARY[node[1]], _value(node[2], filters), _value(node[3], filters)
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, parts = filters[node[1]], [_value(x, filters) for x in node[2:]]
        if len(parts) == 1:
            a = parts[0]
            return lambda env: f(a(env))
        return lambda env: f(*[x(env) for x in parts])
    parts = [_value(x, filters) for x in node[1:]]
    if kind == "list":
        return lambda env: [x(env) for x in parts]
    if kind == "not":
        a = parts[0]
        return lambda env: not a(env)
    if kind == "choice":
        test, a, b = parts
        return lambda env: a(env) if test(env) else b(env)
    a, b = parts
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _item(a(env), b(env))


Run = Callable[[dict, bool], Iterator[Piece]]


def _statement(node: Node, filters: dict[str, Callable[..., Any]]) -> Run:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def run(env: dict, mask: bool) -> Iterator[Piece]:
            yield text, mask

    elif kind == "out":
        value = _value(node[1], filters)

        def run(env: dict, mask: bool) -> Iterator[Piece]:
            yield text_of(value(env)), mask

    elif kind == "set":
        name, value = node[1], _value(node[2], filters)

        def run(env: dict, mask: bool) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

    elif kind == "generation":
        inner = _body(node[1], filters)

        def run(env: dict, mask: bool) -> Iterator[Piece]:
            return inner(env, True)

    elif kind == "if":
        branches = [(_value(test, filters), _body(b, filters)) for test, b in node[1]]

        def run(env: dict, mask: bool) -> Iterator[Piece]:
            for test, body in branches:
                if test(env):
                    return body(env, mask)
            return iter(())

    else:
        name, value, body = node[1], _value(node[2], filters), _body(node[3], filters)

        def run(env: dict, mask: bool) -> Iterator[Piece]:
            items = value(env)
            if items is None or isinstance(items, (str, int, dict)):
                raise TemplateError("a loop needs a list")
            own = dict(env)  # what a loop sets ends with it
            rest = iter(items)
            at, item = 0, next(rest, _END)
            while item is not _END:
                following = next(rest, _END)
                own[name] = item
                own["loop"] = {"index": at + 1, "index0": at, "first": at == 0, "last": following is _END}
                yield from body(own, mask)
                at, item = at + 1, following

    return run


_END = object()


def _body(nodes: list[Node], filters: dict[str, Callable[..., Any]]) -> Run:
    runs = [_statement(x, filters) for x in nodes]

    def run(env: dict, mask: bool) -> Iterator[Piece]:
        for x in runs:
            yield from x(env, mask)

    return run


def compiled(source: str, control: tuple[str, ...] = ()) -> Callable[[dict], Iterator[Piece]]:
    """A function from the values of names to the rendered pieces in order. The filter
    ``escape`` makes ``control`` strings harmless."""
    filters = FILTERS | {"escape": lambda x, f=Escape(control).escape: f(text_of(x))}
    run = _body(folded(parsed(source, filters), filters), filters)
    return lambda values: run(dict(values), False)
