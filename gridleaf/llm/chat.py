"""Chat formatting with compiled templates.

A template is text with ``{{ expression }}``, ``{% if %} / {% elif %} / {% else %} / {% endif %}``, ``{% for turn in
turns %} ... {% endfor %}`` and ``{% generation %} ... {% endgeneration %}``, which marks what bears loss. It is parsed
into a tree, constants are folded, and each node becomes a Python closure; nothing of a template is ever evaluated as
Python. Expressions know strings, whole numbers, ``turn.role``, ``turn.text``, ``turn.index``, ``turn.first``, ``==``,
``!=``, ``and``, ``or``, ``not``, ``+``, parentheses and the filters of ``FILTERS``.

Rendering is a stream over turns and emits (text, bears loss) fragments, so a conversation of any length passes through
one task turn by turn. ``escape`` makes control strings inside texts harmless and ``Reader`` undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

OPEN, CLOSE = "<turn>", "</turn>"

#: Marks turns; the assistant's own text is what bears loss.
TEMPLATE = (
    "{% for turn in turns %}" + OPEN + "{{ turn.role | name }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    + CLOSE + "\n{% endfor %}"
)


class Turn(NamedTuple):
    role: str
    text: str
    index: int = 0
    first: bool = True


# --- escapes ---------------------------------------------------------------


def escape(text: str) -> str:
    """Backslashes doubled, and one before each turn marker."""
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)


def name(role: str) -> str:
    """``escape`` on one line."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": name, "upper": str.upper, "lower": str.lower, "trim": str.strip}


# --- parsing ---------------------------------------------------------------


class TemplateError(ValueError):
    """What is wrong with a template, and where."""


@dataclass
class Node:
    """``kind`` and parts: text, put, if, for, generation, seq; const, field, not, and, or, ==, !=, +, filter."""

    kind: str
    parts: list


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_][\w.]*)|(==|!=|[()+|]))")
_FIELDS = {"turn.role": 0, "turn.text": 1, "turn.index": 2, "turn.first": 3}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def next(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.next() is not None and (not wanted or self.next() in wanted):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def whole(self) -> Node:
        node = self.either()
        if self.next() is not None:
            raise TemplateError(f"unexpected {self.next()!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", [node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.sum()
        while sign := self.take("==", "!="):
            node = Node(sign, [node, self.sum()])
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("+", [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.value()
        while self.take("|"):
            if self.next() not in FILTERS:
                raise TemplateError(f"no filter {self.next()!r}")
            node = Node("filter", [self.take(), node])
        return node

    def value(self) -> Node:
        token = self.take()
        if token is None:
            raise TemplateError("an expression ends early")
        if token == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis stays open")
            return node
        if token[0] in "'\"":
            return Node("const", [unescape(token[1:-1])])
        if token.isdigit():
            return Node("const", [int(token)])
        if token in ("true", "false"):
            return Node("const", [token == "true"])
        if token in _FIELDS:
            return Node("field", [_FIELDS[token]])
        raise TemplateError(f"no value {token!r}")


def parse(template: str) -> Node:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            pieces.append(("text", template[at : m.start()]))
        pieces.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        pieces.append(("text", template[at:]))
    place = 0

    def block(ends: tuple[str, ...], inside: frozenset) -> tuple[Node, str]:
        nonlocal place
        out = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                out.append(Node("text", [value]))
                continue
            if kind == "put":
                out.append(Node("put", [_Expression(value).whole()]))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return Node("seq", out), value
            if word == "if":
                arms, test = [], rest
                while True:
                    body, end = block(("elif", "else", "endif"), inside)
                    arms.append([_Expression(test).whole() if test is not None else Node("const", [True]), body])
                    if end == "endif":
                        break
                    if test is None:
                        raise TemplateError(f"{end!r} after else")
                    test = end.partition(" ")[2] if end.startswith("elif") else None
                out.append(Node("if", arms))
            elif word == "for" and rest.split() == ["turn", "in", "turns"] and "for" not in inside:
                out.append(Node("for", [block(("endfor",), inside | {"for"})[0]]))
            elif word == "generation" and "generation" not in inside:
                out.append(Node("generation", [block(("endgeneration",), inside | {"generation"})[0]]))
            else:
                raise TemplateError(f"no tag {value!r} here")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("seq", out), ""

    return block((), frozenset())[0]


def fold(node: Node) -> Node:
    """The same tree with constant expressions evaluated, decided arms removed and neighbouring texts joined."""
    kind = node.kind
    if kind in ("text", "const", "field"):
        return node
    if kind == "if":
        arms = []
        for test, body in node.parts:
            test = fold(test)
            if test.kind == "const" and not test.parts[0]:
                continue
            arms.append([test, fold(body)])
            if test.kind == "const":
                break
        if arms and arms[0][0].kind == "const":
            return arms[0][1]
        return Node("if", arms) if arms else Node("seq", [])
    if kind == "seq":
        out: list[Node] = []
        for part in map(fold, node.parts):
            for p in part.parts if part.kind == "seq" else [part]:
                if p.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", [out[-1].parts[0] + p.parts[0]])
                elif p.kind != "text" or p.parts[0]:
                    out.append(p)
        return Node("seq", out)
    parts = [fold(p) if isinstance(p, Node) else p for p in node.parts]
    if kind == "put" and parts[0].kind == "const":
        return Node("text", [_shown(parts[0].parts[0])])
    out_node = Node(kind, parts)
    if kind in ("not", "and", "or", "==", "!=", "+", "filter") and all(p.kind == "const" for p in parts if isinstance(p, Node)):
        return Node("const", [_expression(out_node)(None)])
    return out_node


# --- closures --------------------------------------------------------------


def _shown(value) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _expression(node: Node) -> Callable:
    kind = node.kind
    if kind == "const":
        value = node.parts[0]
        return lambda turn: value
    if kind == "field":
        at = node.parts[0]
        return lambda turn: turn[at] if turn is not None else ""
    if kind == "filter":
        work, inner = FILTERS[node.parts[0]], _expression(node.parts[1])
        return lambda turn: work(_shown(inner(turn)))
    if kind == "not":
        inner = _expression(node.parts[0])
        return lambda turn: not inner(turn)
    a, b = map(_expression, node.parts)
    return {
        "and": lambda turn: a(turn) and b(turn), "or": lambda turn: a(turn) or b(turn), "==": lambda turn: a(turn) == b(turn),
        "!=": lambda turn: a(turn) != b(turn), "+": lambda turn: _shown(a(turn)) + _shown(b(turn)),
    }[kind]


Fragment = tuple[str, bool]


def _closure(node: Node) -> Callable[[Turn | None, Iterator[Turn], bool], Iterator[Fragment]]:
    kind = node.kind
    if kind == "text":
        text = node.parts[0]
        return lambda turn, turns, loss: iter([(text, loss)])
    if kind == "put":
        value = _expression(node.parts[0])
        return lambda turn, turns, loss: iter([(_shown(value(turn)), loss)])
    if kind == "generation":
        inner = _closure(node.parts[0])
        return lambda turn, turns, loss: inner(turn, turns, True)
    if kind == "for":
        inner = _closure(node.parts[0])

        def loop(turn, turns, loss):
            for t in turns:
                yield from inner(t, turns, loss)

        return loop
    if kind == "if":
        arms = [(_expression(test), _closure(body)) for test, body in node.parts]

        def choose(turn, turns, loss):
            for test, body in arms:
                if test(turn):
                    return body(turn, turns, loss)
            return iter(())

        return choose
    parts = [_closure(p) for p in node.parts]

    def sequence(turn, turns, loss):
        for part in parts:
            yield from part(turn, turns, loss)

    return sequence


def compile_template(template: str) -> Callable[[Iterable[Turn]], Iterator[Fragment]]:
    """A renderer: turns in, (text, bears loss) fragments out."""
    work = _closure(fold(parse(template)))
    return lambda turns: work(None, iter(turns), False)


# --- reading back ----------------------------------------------------------

_STEP = re.compile(r"\\.|</turn>\n|[^\\<]+|<", re.S)


class Reader:
    """Reads formatted fragments of ``TEMPLATE`` back, turn by turn: ``feed`` fragments, ``take`` (role, text) of whole turns."""

    def __init__(self):
        self.parts: list[str] = []

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.parts.append(text)
        if text.endswith(CLOSE + "\n") or text.startswith(CLOSE + "\n"):
            yield from self._whole()

    def _whole(self) -> Iterator[tuple[str, str]]:
        held, self.parts = "".join(self.parts), []
        begin = 0
        while begin < len(held):
            if not held.startswith(OPEN, begin):
                raise ValueError("a turn doesn't start with its marker")
            at, out = begin + len(OPEN), []
            while at < len(held):
                m = _STEP.match(held, at)
                if m is None:
                    at = len(held)
                    break
                at = m.end()
                if m[0] == CLOSE + "\n":
                    role, _, text = "".join(out).partition("\n")
                    yield unescape(role), unescape(text)
                    begin = at
                    break
                out.append(m[0])
            else:
                break
            if begin != at:
                break
        if begin < len(held):
            self.parts = [held[begin:]]


# --- conversations ---------------------------------------------------------


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, text, loss``: the fragments of every formatted conversation in order; see ``digests`` for rules."""
    render = TEMPLATE

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        make = compile_template(render)
        for conv_id, turns in _conversations(rows):
            for part, (text, loss) in enumerate(make(turns)):
                yield conv_id, part, text, loss

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return map_rows(_ordered(conversations), work, f"conv_id {kind}, part bigint, text string, loss boolean")


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the formatted output.

    Rows of a conversation go by turn (nulls first; equal turns by role and text). Null roles and texts count as empty;
    rows with a null ``conv_id`` are one conversation; repeated rows are turns of their own; an empty table gives no
    rows; other columns are not read. A conversation passes through one task, a turn at a time.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        make = compile_template(template)
        for conv_id, turns in _conversations(rows):
            everything, learnt = hashlib.sha256(), hashlib.sha256()
            n = chars = loss_chars = 0
            reader = Reader()
            for text, loss in make(turns):
                chars += len(text)
                if loss:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    learnt.update(plain.encode("utf-8", "surrogatepass"))
                for role, said in reader.feed(text):
                    n += 1
                    everything.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            yield conv_id, n, everything.hexdigest(), loss_chars, learnt.hexdigest(), chars

    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_rows(_ordered(conversations), work, schema)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, its key hashed so that all of it meets in one task."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[Turn]]]:
    """Conversations as streams of turns; each has to be read to its end before the next one starts."""
    waiting = next(rows, None)
    while waiting is not None:
        conv_id, ended = waiting[0], []

        def turns(first: tuple) -> Iterator[Turn]:
            row, index = first, 0
            while row is not None and row[0] == conv_id:
                yield Turn(row[1], row[2], index, index == 0)
                row, index = next(rows, None), index + 1
            ended.append(row)

        stream = turns(waiting)
        yield conv_id, stream
        for _ in stream:  # whatever the reader left
            pass
        waiting = ended[0]
