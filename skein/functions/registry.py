"""Functions of queries: name -> builder of a Column from argument Columns. Null stands for the empty sequence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.errors import AnalysisProblem

#: Functions of a sequence that become Spark aggregates over groups and nested queries.
AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Function:
    build: Callable[..., Column]
    least: int
    most: int


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions p with start <= p < start + length, both rounded, counted from 1; positions before 1 shorten the result."""
    whole = lambda x: F.floor(x.cast("double") + 0.5).cast("int")  # noqa: E731  halves go up
    s, start = s.cast("string"), whole(start)
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substr(s, first)
    rest = start + whole(length) - first
    return F.when(rest > 0, F.substr(s, first, F.greatest(rest, F.lit(0)))).when(rest.isNotNull() & s.isNotNull(), F.lit(""))


def random(low: Column, high: Column, seed: int | None = None) -> Column:
    return low + F.rand(seed) * (high - low)


def concat(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _text(f):
    return lambda a, b: f(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit("")))


class Registry:
    """The built-in functions and those that a host adds."""

    def __init__(self) -> None:
        self._found: dict[str, Function] = {}
        add = self.add
        add("substring", substring, 2, 3)
        add("string", lambda a: a.cast("string"), 1)
        add("string-length", lambda a: F.coalesce(F.char_length(a.cast("string")), F.lit(0)), 1)
        add("upper-case", F.upper, 1)
        add("lower-case", F.lower, 1)
        add("normalize-space", lambda a: F.trim(F.regexp_replace(a, r"\s+", " ")), 1)
        add("contains", _text(F.contains), 2)
        add("starts-with", _text(F.startswith), 2)
        add("ends-with", _text(F.endswith), 2)
        add("matches", lambda a, b: F.rlike(a, b), 2)
        add("concat", concat, 2, 99)
        add("round", F.round, 1)
        add("abs", F.abs, 1)
        add("floor", F.floor, 1)
        add("ceiling", F.ceil, 1)
        add("not", lambda a: ~F.coalesce(a.cast("boolean"), F.lit(False)), 1)
        add("true", lambda: F.lit(True), 0)
        add("false", lambda: F.lit(False), 0)
        add("empty", lambda a: a.isNull(), 1)
        add("exists", lambda a: a.isNotNull(), 1)
        add("number", lambda a: a.try_cast("double"), 1)
        for part in ("year", "month", "day"):
            add(f"{part}-from-date", getattr(F, part), 1)
        for name in ("sqrt", "exp", "log", "log10", "sin", "cos", "tan", "asin", "acos", "atan"):
            add(f"math:{name}", getattr(F, name), 1)
        add("math:pow", F.pow, 2)
        add("math:pi", F.pi, 0)
        add("bit:random", random, 2)

    def add(self, name: str, build: Callable[..., Column], least: int, most: int | None = None) -> None:
        self._found[name] = Function(build, least, least if most is None else most)

    def has(self, name: str) -> bool:
        return name.removeprefix("fn:") in self._found

    def call(self, name: str, args: list[Column]) -> Column:
        found = self._found.get(name.removeprefix("fn:"))
        if found is None:
            raise AnalysisProblem(f"unknown function {name}()")
        if not found.least <= len(args) <= found.most:
            raise AnalysisProblem(f"{name}() takes {found.least} to {found.most} arguments, not {len(args)}")
        return found.build(*args)

    def copy(self) -> Registry:
        other = Registry()
        other._found = dict(self._found)
        return other
