"""A fluent builder of queries. It makes the same tree as the parser.

>>> l = var("l")
>>> q = for_("l", collection("lineitem")).where(l.quantity > 5).return_(record(key=l.orderkey))
>>> Engine(spark).lower(q)
"""

from __future__ import annotations

from decimal import Decimal

from skein.lang import ast as A


def _node(x) -> A.Node:
    if isinstance(x, E):
        return x.node
    if isinstance(x, A.Node):
        return x
    if isinstance(x, bool):
        return A.Call("true" if x else "false", ())
    if isinstance(x, int | float | str | Decimal):
        return A.Literal(x)
    raise TypeError(f"{type(x).__name__} is not an expression")


def _binary(op: str):
    return lambda self, other: E(A.Binary(op, self.node, _node(other)))


def _reversed(op: str):
    return lambda self, other: E(A.Binary(op, _node(other), self.node))


class E:
    """An expression. Attributes and [] are fields of a record; operators are those of the language."""

    def __init__(self, node: A.Node):
        self.node = node

    def __getattr__(self, name: str) -> E:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> E:
        return E(A.Field(self.node, name))

    __add__, __sub__, __mul__, __truediv__, __floordiv__, __mod__ = (_binary(op) for op in ("+", "-", "*", "div", "idiv", "mod"))
    __radd__, __rsub__, __rmul__, __rtruediv__ = (_reversed(op) for op in ("+", "-", "*", "div"))
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = (_binary(op) for op in ("=", "!=", "<", "<=", ">", ">="))
    __and__, __or__ = _binary("and"), _binary("or")
    __hash__ = None

    def __neg__(self) -> E:
        return E(A.Negate(self.node))


def var(name: str) -> E:
    return E(A.Var(name))


def lit(value) -> E:
    return E(_node(value))


def collection(name: str) -> E:
    return E(A.Call("collection", (A.Literal(name),)))


def range_(first, last) -> E:
    return E(A.Range(_node(first), _node(last)))


def call(name: str, *args) -> E:
    return E(A.Call(name, tuple(map(_node, args))))


def record(**items) -> E:
    return E(A.Record(tuple((k, _node(v)) for k, v in items.items())))


class Clauses:
    """Clauses so far; return_() ends them."""

    def __init__(self, clauses: tuple[A.Node, ...] = ()):
        self.clauses = clauses

    def _with(self, *more: A.Node) -> Clauses:
        return Clauses((*self.clauses, *more))

    def for_(self, name: str, source) -> Clauses:
        return self._with(A.For(name, _node(source)))

    def let(self, **values) -> Clauses:
        return self._with(*(A.Let(k, _node(v)) for k, v in values.items()))

    def where(self, test) -> Clauses:
        return self._with(A.Where(_node(test)))

    def group_by(self, *keys: str) -> Clauses:
        return self._with(A.GroupBy(keys))

    def order_by(self, *keys, descending: bool = False, empty_greatest: bool = False) -> Clauses:
        return self._with(A.OrderBy(tuple(A.Order(_node(k), descending, empty_greatest) for k in keys)))

    def return_(self, result) -> A.Flwor:
        return A.Flwor(self.clauses, _node(result))


def for_(name: str, source) -> Clauses:
    return Clauses().for_(name, source)


def let(**values) -> Clauses:
    return Clauses().let(**values)
