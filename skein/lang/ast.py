"""The syntax tree. Nodes are frozen, so equal expressions are equal values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    """Expression or clause."""


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negate(Node):
    value: Node


@dataclass(frozen=True)
class Range(Node):
    first: Node
    last: Node


@dataclass(frozen=True)
class Record(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Items(Node):
    """A comma list in parentheses; no items is the empty sequence."""

    items: tuple[Node, ...]


@dataclass(frozen=True)
class If(Node):
    test: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Cast(Node):
    value: Node
    type: str


@dataclass(frozen=True)
class For(Node):
    var: str
    source: Node


@dataclass(frozen=True)
class Let(Node):
    var: str
    value: Node


@dataclass(frozen=True)
class Where(Node):
    test: Node


@dataclass(frozen=True)
class GroupBy(Node):
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Order(Node):
    key: Node
    descending: bool = False
    empty_greatest: bool = False
    collation: str | None = None


@dataclass(frozen=True)
class OrderBy(Node):
    specs: tuple[Order, ...]


@dataclass(frozen=True)
class Flwor(Node):
    clauses: tuple[Node, ...]
    result: Node


@dataclass(frozen=True)
class Function(Node):
    name: str
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class SchemaImport(Node):
    prefix: str
    uri: str
    location: str


@dataclass(frozen=True)
class Collection(Node):
    name: str
    annotations: tuple[tuple[str, str], ...]
    type: str | None


@dataclass(frozen=True)
class Module(Node):
    imports: tuple[SchemaImport, ...]
    collections: tuple[Collection, ...]
    options: tuple[tuple[str, str], ...]
    functions: tuple[Function, ...]
    body: Node


def rebuild(node: Node, change) -> Node:
    """node with change() applied to each of its direct child nodes."""

    def value(x):
        if isinstance(x, Node):
            return change(x)
        if isinstance(x, tuple):
            return tuple(value(y) for y in x)
        return x

    found = {f.name: value(getattr(node, f.name)) for f in fields(node)}
    return replace(node, **found) if any(found[k] is not getattr(node, k) for k in found) else node


def children(node: Node) -> list[Node]:
    out: list[Node] = []

    def value(x):
        if isinstance(x, Node):
            out.append(x)
        elif isinstance(x, tuple):
            for y in x:
                value(y)

    for f in fields(node):
        value(getattr(node, f.name))
    return out


def free_vars(node: Node) -> set[str]:
    """Variables that a node uses and does not bind itself."""
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, Flwor):
        bound: set[str] = set()
        free: set[str] = set()
        for c in node.clauses:
            if isinstance(c, For | Let):
                free |= free_vars(c.source if isinstance(c, For) else c.value) - bound
                bound.add(c.var)
            elif isinstance(c, GroupBy):
                free |= set(c.keys) - bound
            else:
                free |= free_vars(c) - bound
        return free | free_vars(node.result) - bound
    return set().union(*map(free_vars, children(node))) if children(node) else set()


def substitute(node: Node, values: dict[str, Node]) -> Node:
    """node with free variables replaced; a variable that a clause binds anew is left from there on."""
    if not values:
        return node
    if isinstance(node, Var):
        return values.get(node.name, node)
    if isinstance(node, Flwor):
        clauses = []
        for c in node.clauses:
            clauses.append(rebuild(c, lambda x, v=values: substitute(x, v)))
            if isinstance(c, For | Let):
                values = {k: v for k, v in values.items() if k != c.var}
        return Flwor(tuple(clauses), substitute(node.result, values))
    return rebuild(node, lambda x: substitute(x, values))
