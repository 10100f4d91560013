"""Declared collections and the types they are declared with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skein.errors import AnalysisProblem
from skein.sources import readers


@dataclass(frozen=True)
class Declared:
    format: str
    location: str
    schema: T.StructType | None = None
    options: dict[str, str] = field(default_factory=dict)


class Catalog:
    def __init__(self) -> None:
        self._collections: dict[str, Declared | DataFrame] = {}
        self._types: dict[str, T.StructType] = {}

    def copy(self) -> Catalog:
        other = Catalog()
        other._collections, other._types = dict(self._collections), dict(self._types)
        return other

    def declare(self, name: str, what: Declared | DataFrame) -> None:
        """A declared location, or a DataFrame as it is."""
        self._collections[name] = what

    def declare_types(self, prefix: str, types: dict[str, T.StructType]) -> None:
        self._types |= {f"{prefix}:{k}": v for k, v in types.items()}

    def type(self, name: str) -> T.StructType:
        if name not in self._types:
            raise AnalysisProblem(f"unknown record type {name}; there are {', '.join(sorted(self._types)) or 'none'}")
        return self._types[name]

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        found = self._collections.get(name)
        if found is None:
            raise AnalysisProblem(f"no collection {name!r} is declared; there are {', '.join(sorted(self._collections)) or 'none'}")
        if isinstance(found, DataFrame):
            return found
        return readers.read(spark, found.format, found.location, found.schema, found.options)
