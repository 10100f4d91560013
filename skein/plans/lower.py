"""A query's tree to one lazy DataFrame.

A tuple stream is a DataFrame with a column for each variable. A variable is of one
item or none (a scalar, or a struct for a record; null is the empty sequence) or of
many (an array). Groups do not gather their items where only aggregates of them are
used: these become Spark aggregates (see _group).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.catalog import Catalog
from skein.errors import AnalysisProblem
from skein.functions.registry import AGGREGATES, Registry
from skein.lang import ast as A
from skein.types import is_number, is_text, spark_type

_OPS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


class UnknownField(UserWarning):
    """A field that a record type does not have reads as empty."""


@dataclass(frozen=True)
class Value:
    """A lowered expression: a column, and if it is a sequence of many items."""

    column: Column
    many: bool = False


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    vars: dict[str, tuple[str, bool]] = field(default_factory=dict)  # name -> (column, many)
    sources: dict[str, A.Node] = field(default_factory=dict)  # let-bound collections and queries, opened where they are used
    made: int = 0

    def bind(self, name: str, value: Value) -> Stream:
        column = f"v{self.made}_{name}".replace(":", "_")
        return replace(self, df=self.df.withColumn(column, value.column), vars=self.vars | {name: (column, value.many)}, sources={k: v for k, v in self.sources.items() if k != name}, made=self.made + 1)


class Lowering:
    def __init__(self, spark: SparkSession, catalog: Catalog, functions: Registry, strict: bool = False, range_partitions: int | None = None):
        self.spark, self.catalog, self.functions, self.strict, self.range_partitions = spark, catalog, functions, strict, range_partitions

    # queries

    def query(self, node: A.Node) -> DataFrame:
        """The result of a whole query."""
        return self.flwor(node if isinstance(node, A.Flwor) else A.Flwor((), node))

    def flwor(self, node: A.Flwor) -> DataFrame:
        if not node.clauses and self._is_source(node.result, Stream(None)):
            return self.items(node.result, Stream(None))[0]
        stream = Stream(self.spark.range(1).select())
        clauses, result = list(node.clauses), node.result
        fresh = True
        while clauses:
            c = clauses.pop(0)
            if isinstance(c, A.For):
                stream = self._for(stream, c, fresh)
                fresh = False
            elif isinstance(c, A.Let):
                if self._is_source(c.value, stream):
                    stream = replace(stream, sources=stream.sources | {c.var: c.value}, vars={k: v for k, v in stream.vars.items() if k != c.var})
                else:
                    stream, value = self.value(c.value, stream)
                    stream = stream.bind(c.var, value)
            elif isinstance(c, A.Where):
                stream, value = self.value(c.test, stream)
                stream = replace(stream, df=stream.df.where(self._truth(value, stream)))
            elif isinstance(c, A.OrderBy):
                stream = self._order(stream, c)
            else:
                stream, clauses, result = self._group(stream, c, clauses, result)
        return self._return(stream, result)

    def _return(self, stream: Stream, node: A.Node) -> DataFrame:
        if isinstance(node, A.Record):
            columns = []
            for key, item in node.items:
                stream, value = self.value(item, stream)
                columns.append(value.column.alias(key))
            return stream.df.select(*columns)
        stream, value = self.value(node, stream)
        out = stream.df.select(value.column.alias("value"))
        if isinstance(out.schema["value"].dataType, T.StructType):
            return out.select("value.*")
        return out

    # clauses

    def _is_source(self, node: A.Node, stream: Stream) -> bool:
        """A collection, a path into one or a query, which has rows of its own."""
        if isinstance(node, A.Var):
            return node.name in stream.sources
        if isinstance(node, A.Field):
            return self._is_source(node.base, stream)
        return isinstance(node, A.Flwor) or isinstance(node, A.Call) and node.name.removeprefix("fn:") == "collection"

    def items(self, node: A.Node, stream: Stream) -> tuple[DataFrame, Column]:
        """The rows of a source or range, and the column of their item. They must not depend on the stream's variables."""
        if isinstance(node, A.Var):
            return self.items(stream.sources[node.name], stream)
        if isinstance(node, A.Call):
            if len(node.args) != 1 or not isinstance(node.args[0], A.Literal) or not isinstance(node.args[0].value, str):
                raise AnalysisProblem("collection() takes the name of a declared collection")
            df = self.catalog.open(self.spark, node.args[0].value)
            return df, F.struct(*[F.col(f"`{c}`") for c in df.columns])
        if isinstance(node, A.Range):
            first, last = self._whole(node.first), self._whole(node.last)
            return self.spark.range(first, max(first, last + 1), 1, self.range_partitions), F.col("id")
        if isinstance(node, A.Field):
            df, item = self.items(node.base, stream)
            df = df.select(item.alias("item"))
            df = df.select(self._get(F.col("item"), df.schema["item"].dataType, node.name).alias("value")).where("value is not null")
            return df, F.col("value")
        if isinstance(node, A.Flwor):
            used = A.free_vars(node)
            if used & set(stream.vars):
                raise AnalysisProblem(f"a nested query that uses ${', $'.join(sorted(used & set(stream.vars)))} of the outer one is not supported; join the collections in one query")
            named = {k: v for k, v in stream.sources.items() if k in used}
            df = self.flwor(A.substitute(node, named) if named else node)
            return df, F.col("value") if df.columns == ["value"] else F.struct(*[F.col(f"`{c}`") for c in df.columns])
        raise AnalysisProblem("for needs a collection, a range, a query or a variable of many items")

    def _whole(self, node: A.Node) -> int:
        """A bound of a range: whole numbers and arithmetic of them."""
        if isinstance(node, A.Literal) and isinstance(node.value, int):
            return node.value
        if isinstance(node, A.Negate):
            return -self._whole(node.value)
        if isinstance(node, A.Binary) and node.op in ("+", "-", "*", "idiv", "mod"):
            a, b = self._whole(node.left), self._whole(node.right)
            if node.op in ("idiv", "mod"):
                if not b:
                    raise AnalysisProblem("a bound of a range divides by zero")
                q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
                return q if node.op == "idiv" else a - q * b
            return {"+": a + b, "-": a - b, "*": a * b}[node.op]
        raise AnalysisProblem("the bounds of a range that for runs over must be whole numbers")

    def _for(self, stream: Stream, c: A.For, fresh: bool) -> Stream:
        if self._is_source(c.source, stream) or isinstance(c.source, A.Range) and not A.free_vars(c.source):
            df, item = self.items(c.source, stream)
            column = f"v{stream.made}_{c.var}".replace(":", "_")
            rows = df.select(item.alias(column))
            # A product, which the conditions that follow turn into joins; the first for has nothing to multiply.
            joined = rows if fresh and not stream.vars else stream.df.crossJoin(rows)
            sources = {k: v for k, v in stream.sources.items() if k != c.var}
            return replace(stream, df=joined, vars=stream.vars | {c.var: (column, False)}, sources=sources, made=stream.made + 1)
        stream, value = self.value(c.source, stream)
        if not value.many:
            return replace(s := stream.bind(c.var, value), df=s.df.where(F.col(s.vars[c.var][0]).isNotNull()))
        return stream.bind(c.var, Value(F.explode(value.column)))

    def _order(self, stream: Stream, c: A.OrderBy) -> Stream:
        keys = []
        for spec in c.specs:
            stream, value = self.value(spec.key, stream)
            if value.many:
                raise AnalysisProblem("a key of order by must be a single item")
            column = F.collate(value.column, spec.collation) if spec.collation else value.column
            last = spec.empty_greatest != spec.descending
            order = (column.desc_nulls_last if last else column.desc_nulls_first) if spec.descending else column.asc_nulls_last if last else column.asc_nulls_first
            keys.append(order())
        return replace(stream, df=stream.df.orderBy(*keys))

    def _group(self, stream: Stream, c: A.GroupBy, rest: list[A.Node], result: A.Node) -> tuple[Stream, list[A.Node], A.Node]:
        """Groups by keys, looking ahead: an aggregate of a path of a grouped variable is computed by
        the group-by itself, and only variables that are used in another way are gathered."""
        for k in c.keys:
            if k not in stream.vars:
                raise AnalysisProblem(f"group by ${k}: there is no such variable")
            if stream.vars[k][1]:
                raise AnalysisProblem(f"group by ${k}: a key must be a single item")
        others = {v: x for v, x in stream.vars.items() if v not in c.keys}
        lifted: dict[A.Call, str] = {}

        def lift(node: A.Node, names: frozenset[str]) -> A.Node:
            if isinstance(node, A.Call) and node.name.removeprefix("fn:") in AGGREGATES and len(node.args) == 1 and _root(node.args[0]) in names:
                plain = A.Call(node.name.removeprefix("fn:"), node.args)
                return A.Var(lifted.setdefault(plain, f"#{stream.made}.{len(lifted)}"))
            if isinstance(node, A.Flwor):
                clauses, result = lift_all(list(node.clauses), node.result, names)
                return A.Flwor(tuple(clauses), result)
            return A.rebuild(node, lambda x: lift(x, names))

        def lift_all(clauses: list[A.Node], result: A.Node, names: frozenset[str]) -> tuple[list[A.Node], A.Node]:
            out = []
            for x in clauses:
                out.append(A.rebuild(x, lambda y, n=names: lift(y, n)))
                if isinstance(x, A.For | A.Let):
                    names = names - {x.var}
            return out, lift(result, names)

        rest, result = lift_all(rest, result, frozenset(others))
        used = A.free_vars(A.Flwor(tuple(rest), result))
        aggregates, vars_ = [], {k: (f"v{stream.made}_{i}", False) for i, k in enumerate(dict.fromkeys(c.keys))}
        keys = [F.col(stream.vars[k][0]).alias(vars_[k][0]) for k in vars_]
        for call, name in lifted.items():
            stream, value = self.value(call.args[0], stream)
            column = f"v{stream.made}_a{len(aggregates)}"
            aggregates.append(_aggregate(call.name, value).alias(column))
            vars_[name] = (column, False)
        for v in sorted(used & set(others)):
            column, many = others[v]
            name = f"v{stream.made}_g{len(aggregates)}"
            gathered = F.collect_list(column)
            aggregates.append((F.flatten(gathered) if many else gathered).alias(name))
            vars_[v] = (name, True)
        grouped = stream.df.groupBy(*keys)
        df = grouped.agg(*aggregates) if aggregates else stream.df.select(*keys).distinct()
        return replace(stream, df=df, vars=vars_, made=stream.made + 1), rest, result

    # expressions

    def value(self, node: A.Node, stream: Stream) -> tuple[Stream, Value]:
        """node as a column of the stream, which gets a column for each nested query's single result."""
        if isinstance(node, A.Literal):
            return stream, Value(F.lit(node.value))
        if isinstance(node, A.Var):
            if node.name in stream.vars:
                column, many = stream.vars[node.name]
                return stream, Value(F.col(column), many)
            if node.name in stream.sources:
                raise AnalysisProblem(f"${node.name} is a whole collection or query; iterate over it with for, or aggregate it")
            raise AnalysisProblem(f"unknown variable ${node.name}")
        if isinstance(node, A.Field):
            stream, base = self.value(node.base, stream)
            kind = self._type(base, stream)
            if base.many:
                inner = kind.elementType
                got = F.transform(base.column, lambda x: self._get(x, inner, node.name))
                return stream, Value(F.filter(got, lambda x: x.isNotNull()), True)
            return stream, Value(self._get(base.column, kind, node.name))
        if isinstance(node, A.Record):
            columns = []
            for key, item in node.items:
                stream, value = self.value(item, stream)
                columns.append(value.column.alias(key))
            return stream, Value(F.struct(*columns) if columns else F.lit(None))
        if isinstance(node, A.Items):
            if not node.items:
                return stream, Value(F.lit(None))
            parts = []
            for item in node.items:
                stream, value = self.value(item, stream)
                parts.append(value.column if value.many else F.array(value.column))
            return stream, Value(F.filter(F.concat(*parts), lambda x: x.isNotNull()), True)
        if isinstance(node, A.Range):
            stream, first = self.value(node.first, stream)
            stream, last = self.value(node.last, stream)
            a, b = first.column.cast("long"), last.column.cast("long")
            return stream, Value(F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>")), True)
        if isinstance(node, A.Negate):
            stream, value = self._single(node.value, stream, "-")
            return stream, Value(-value.column)
        if isinstance(node, A.If):
            stream, test = self.value(node.test, stream)
            stream, then = self.value(node.then, stream)
            stream, other = self.value(node.other, stream)
            if then.many != other.many:
                then, other = (Value(x.column if x.many else F.array_compact(F.array(x.column)), True) for x in (then, other))
            return stream, Value(F.when(self._truth(test, stream), then.column).otherwise(other.column), then.many)
        if isinstance(node, A.Cast):
            stream, value = self._single(node.value, stream, "cast as")
            return stream, Value(value.column.cast(spark_type(node.type)))
        if isinstance(node, A.Binary):
            return self._binary(node, stream)
        if isinstance(node, A.Call):
            return self._call(node, stream)
        if isinstance(node, A.Flwor):
            raise AnalysisProblem("a nested query must be the source of for or the argument of count, sum, avg, min or max")
        raise AnalysisProblem(f"cannot lower {type(node).__name__}")

    def _call(self, node: A.Call, stream: Stream) -> tuple[Stream, Value]:
        name = node.name.removeprefix("fn:")
        if name == "not" and len(node.args) == 1:
            stream, value = self.value(node.args[0], stream)
            return stream, Value(~F.coalesce(self._truth(value, stream), F.lit(False)))
        if name == "round" and len(node.args) == 1:
            stream, value = self.value(node.args[0], stream)
            if not value.many and is_number(self._type(value, stream)):
                # Halves go up, below zero too.
                away = self.functions.call("round", [value.column])
                half = (value.column < 0) & (away - value.column == -0.5)
                return stream, Value(F.when(half, away + 1).otherwise(away).cast(self._type(Value(away), stream)))
        if name in ("exists", "empty") and len(node.args) == 1 and self._is_source(node.args[0], stream):
            stream, count = self._call(replace(node, name="count"), stream)
            return stream, Value(count.column > 0 if name == "exists" else count.column == 0)
        if name in AGGREGATES and len(node.args) == 1:
            arg = node.args[0]
            if self._is_source(arg, stream) or isinstance(arg, A.Range) and not A.free_vars(arg):
                df, item = self.items(arg, stream)
                column = f"v{stream.made}_{name}"
                one = df.agg(_aggregate(name, Value(item)).alias(column))
                # One row, so the product adds a column.
                return replace(stream, df=stream.df.crossJoin(F.broadcast(one)) if stream.vars else one, made=stream.made + 1, vars=stream.vars | {f"#{column}": (column, False)}), Value(F.col(column))
            stream, value = self.value(arg, stream)
            return stream, Value(_of_sequence(name, value, self._type(value, stream)))
        args = []
        for arg in node.args:
            stream, value = self.value(arg, stream)
            if value.many and name in ("empty", "exists"):
                value = Value(F.when(F.size(value.column) > 0, F.lit(True)))
            elif value.many and name == "distinct-values":
                return stream, Value(F.array_distinct(value.column), True)
            elif value.many:
                raise AnalysisProblem(f"{name}() takes single items, not a sequence")
            args.append(value.column)
        return stream, Value(self.functions.call(node.name, args))

    def _single(self, node: A.Node, stream: Stream, what: str) -> tuple[Stream, Value]:
        stream, value = self.value(node, stream)
        if value.many:
            raise AnalysisProblem(f"{what} takes a single item, not a sequence")
        return stream, value

    def _binary(self, node: A.Binary, stream: Stream) -> tuple[Stream, Value]:
        stream, left = self.value(node.left, stream)
        stream, right = self.value(node.right, stream)
        op = node.op
        if op in ("and", "or"):
            a, b = self._truth(left, stream), self._truth(right, stream)
            return stream, Value(a & b if op == "and" else a | b)
        if op in ("+", "-", "*", "div", "idiv", "mod"):
            if left.many or right.many:
                raise AnalysisProblem(f"{op} takes single items, not a sequence")
            a, b = left.column, right.column
            if op == "idiv":
                return stream, Value(F.call_function("div", a.cast("decimal(38,10)"), b.cast("decimal(38,10)")))
            return stream, Value({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: a / b, "mod": lambda: a % b}[op]())
        self._comparable(left, right, stream, node)
        if op in _OPS:
            if left.many or right.many:
                raise AnalysisProblem(f"{op} compares single items, not a sequence; = compares any")
            return stream, Value(_compare(_OPS[op], left.column, right.column))
        if left.many and right.many:
            return stream, Value(F.exists(left.column, lambda x: F.exists(right.column, lambda y: _compare(op, x, y))))
        if left.many:
            return stream, Value(F.exists(left.column, lambda x: _compare(op, x, right.column)))
        if right.many:
            return stream, Value(F.exists(right.column, lambda y: _compare(op, left.column, y)))
        return stream, Value(_compare(op, left.column, right.column))

    def _type(self, value: Value, stream: Stream) -> T.DataType:
        return stream.df.select(value.column.alias("x")).schema["x"].dataType

    def _item_type(self, value: Value, stream: Stream) -> T.DataType:
        kind = self._type(value, stream)
        return kind.elementType if value.many else kind

    def _comparable(self, left: Value, right: Value, stream: Stream, node: A.Binary) -> None:
        a, b = self._item_type(left, stream), self._item_type(right, stream)
        if is_text(a) and is_number(b) or is_number(a) and is_text(b):
            raise AnalysisProblem(f"{node.op} compares {a.simpleString()} with {b.simpleString()}")

    def _truth(self, value: Value, stream: Stream) -> Column:
        """The effective boolean value; the empty sequence is false where it decides."""
        if value.many:
            return F.size(value.column) > 0
        kind = self._type(value, stream)
        if isinstance(kind, T.BooleanType):
            return value.column
        if is_number(kind):
            return value.column != 0
        if is_text(kind):
            return value.column != ""
        if isinstance(kind, T.NullType):
            return F.lit(False)
        return value.column.isNotNull()

    def _get(self, base: Column, kind: T.DataType, name: str) -> Column:
        if not isinstance(kind, T.StructType):
            raise AnalysisProblem(f"=>{name}: not a record but {kind.simpleString()}")
        if name in kind.names:
            return base[name]
        message = f"=>{name}: the record has no such field, only {', '.join(kind.names)}"
        if self.strict:
            raise AnalysisProblem(message)
        warnings.warn(message, UnknownField, stacklevel=2)
        return F.lit(None).cast("string")


def _root(node: A.Node) -> str | None:
    """The variable of a path."""
    while isinstance(node, A.Field):
        node = node.base
    return node.name if isinstance(node, A.Var) else None


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def _aggregate(name: str, value: Value) -> Column:
    """Over the rows of a group; the sum of nothing is 0."""
    c = value.column
    if value.many:
        total = lambda x: F.aggregate(F.transform(x, lambda y: y.cast("double")), F.lit(0.0), lambda s, y: s + y)
        return {
            "count": lambda: F.coalesce(F.sum(F.size(c)), F.lit(0)),
            "sum": lambda: F.coalesce(F.sum(total(c)), F.lit(0)),
            "avg": lambda: F.try_divide(F.sum(total(c)), F.sum(F.size(c))),
            "min": lambda: F.min(F.array_min(c)),
            "max": lambda: F.max(F.array_max(c)),
        }[name]()
    return {"count": lambda: F.count(c), "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "avg": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c)}[name]()


def _of_sequence(name: str, value: Value, kind: T.DataType) -> Column:
    """An aggregate of one row's sequence."""
    c = value.column
    if not value.many:
        return {"count": lambda: F.when(c.isNull(), 0).otherwise(1), "sum": lambda: F.coalesce(c, F.lit(0)), "avg": lambda: c, "min": lambda: c, "max": lambda: c}[name]()
    inner = kind.elementType
    wide = T.DecimalType(38, inner.scale) if isinstance(inner, T.DecimalType) else T.LongType() if isinstance(inner, T.IntegralType) else T.DoubleType()
    total = lambda: F.aggregate(c, F.lit(Decimal(0) if isinstance(wide, T.DecimalType) else 0).cast(wide), lambda s, x: (s + x).cast(wide))
    return {"count": lambda: F.size(c), "sum": total, "avg": lambda: F.try_divide(total(), F.size(c)), "min": lambda: F.array_min(c), "max": lambda: F.array_max(c)}[name]()
