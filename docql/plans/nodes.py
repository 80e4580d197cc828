"""Syntax tree of query programs. All front ends produce it; the planners and the interpreter read it."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


class Node:
    __slots__ = ()

    def children(self) -> list[Node]:
        out: list[Node] = []
        todo = [getattr(self, f.name) for f in fields(self)]
        while todo:
            v = todo.pop(0)
            if isinstance(v, Node):
                out.append(v)
            elif isinstance(v, (list, tuple)):
                todo = [*v, *todo]
        return out


def node(cls):
    return dataclass(frozen=True, slots=True)(cls)


@node
class Identity(Node):
    pass


@node
class RecurseAll(Node):
    pass


@node
class Literal(Node):
    value: Any


@node
class Field(Node):
    base: Node
    name: str


@node
class Index(Node):
    base: Node
    key: Node


@node
class Slice(Node):
    base: Node
    start: Node | None
    end: Node | None


@node
class Iterate(Node):
    base: Node


@node
class Pipe(Node):
    left: Node
    right: Node


@node
class Comma(Node):
    left: Node
    right: Node


@node
class Collect(Node):
    body: Node | None


@node
class Build(Node):
    entries: tuple[tuple[Node, Node], ...]


@node
class Interpolate(Node):
    format: str | None
    parts: tuple[str | Node, ...]


@node
class Negate(Node):
    body: Node


@node
class Arithmetic(Node):
    op: str
    left: Node
    right: Node


@node
class Compare(Node):
    op: str
    left: Node
    right: Node


@node
class Logic(Node):
    op: str
    left: Node
    right: Node


@node
class Alternative(Node):
    left: Node
    right: Node


@node
class If(Node):
    test: Node
    then: Node
    other: Node


@node
class Try(Node):
    body: Node
    handler: Node | None


@node
class Reduce(Node):
    source: Node
    pattern: Any
    start: Node
    update: Node


@node
class Foreach(Node):
    source: Node
    pattern: Any
    start: Node
    update: Node
    extract: Node | None


@node
class Define(Node):
    name: str
    params: tuple[str, ...]
    body: Node
    rest: Node


@node
class Call(Node):
    name: str
    args: tuple[Node, ...]


@node
class Bind(Node):
    source: Node
    patterns: tuple[Any, ...]
    body: Node


@node
class Variable(Node):
    name: str


@node
class Assign(Node):
    """op: "=", "|=", or an arithmetic sign or "//" followed by "="."""

    op: str
    target: Node
    value: Node


@node
class Label(Node):
    name: str
    body: Node


@node
class Break(Node):
    name: str


@node
class Format(Node):
    name: str


@node
class VarPattern(Node):
    name: str


@node
class ArrayPattern(Node):
    items: tuple[Any, ...]


@node
class ObjectPattern(Node):
    """entries: (key, variable that gets the key's value or None, pattern or None)."""

    entries: tuple[tuple[Node, str | None, Any], ...]


def pattern_names(pattern: Any) -> list[str]:
    if isinstance(pattern, VarPattern):
        return [pattern.name]
    if isinstance(pattern, ArrayPattern):
        return [n for p in pattern.items for n in pattern_names(p)]
    return [n for _, var, p in pattern.entries for n in ([var] if var else []) + (pattern_names(p) if p else [])]
