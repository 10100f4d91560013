"""Collection formats: a registry of functions (spark, location, schema, options) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skein.errors import AnalysisProblem

Reader = Callable[[SparkSession, str, T.StructType | None, dict[str, str]], DataFrame]
_READERS: dict[str, Reader] = {}
#: Declared elsewhere under these names, but there is no client for them here.
_WITHOUT_CLIENT = ("hbase", "mongo")
_TRAIL = "_trail"


def register(name: str, reader: Reader) -> None:
    """Adds a format, or replaces one. Names are compared without case."""
    _READERS[name.lower()] = reader


def formats() -> list[str]:
    return sorted(_READERS)


def read(spark: SparkSession, name: str, location: str, schema: T.StructType | None, options: dict[str, str]) -> DataFrame:
    found = _READERS.get(name.lower())
    if found is None:
        why = "needs a client library that is not here" if name.lower() in _WITHOUT_CLIENT else "is unknown"
        raise AnalysisProblem(f"unsupported format {name!r}: it {why}; there are {', '.join(formats())}")
    return found(spark, location, schema, options)


def read_csv(spark: SparkSession, location: str, schema: T.StructType | None, options: dict[str, str]) -> DataFrame:
    """Delimited text, | by default. A delimiter after the last field makes one more, empty, column, which is dropped."""
    reader = spark.read.options(**{"sep": "|", "mode": "PERMISSIVE", **options})
    if schema is None:
        return reader.csv(location)
    wide = T.StructType([*schema.fields, T.StructField(_TRAIL, T.StringType())])
    return reader.schema(wide).csv(location).drop(_TRAIL)


def read_text(spark, location, schema, options):
    return spark.read.options(**options).text(location)


def read_json(spark, location, schema, options):
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).json(location)


def read_parquet(spark, location, schema, options):
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).parquet(location)


def read_orc(spark, location, schema, options):
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).orc(location)


for _name, _reader in (("csv", read_csv), ("txt", read_text), ("text", read_text), ("json", read_json), ("parquet", read_parquet), ("orc", read_orc)):
    register(_name, _reader)
