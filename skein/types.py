"""Type names of schema files and casts, and struct types made of them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from skein.errors import AnalysisProblem

#: Precision and scale of xs:decimal, which a schema file does not give.
DECIMAL = T.DecimalType(15, 2)

_TYPES = {
    "int": T.IntegerType(), "integer": T.LongType(), "long": T.LongType(), "short": T.ShortType(), "byte": T.ByteType(),
    "decimal": DECIMAL, "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "dateTime": T.TimestampNTZType(), "hexBinary": T.BinaryType(),
}


def spark_type(name: str, decimal: T.DecimalType = DECIMAL) -> T.DataType:
    """xs:int and so on, with or without prefix."""
    local = name.rpartition(":")[2]
    if local == "decimal":
        return decimal
    if local not in _TYPES:
        raise AnalysisProblem(f"unknown type {name}")
    return _TYPES[local]


def read_schema_file(spark: SparkSession, location: str, decimal: T.DecimalType = DECIMAL) -> dict[str, T.StructType]:
    """The named record types of a schema file: [{"name": ..., "schema": {field: type}}]. Read through Spark, so any of its stores will do."""
    whole = spark.read.text(location, wholetext=True).head()
    try:
        entries = json.loads(whole[0])
        return {e["name"]: T.StructType([T.StructField(k, spark_type(v, decimal)) for k, v in e["schema"].items()]) for e in entries}
    except (ValueError, KeyError, TypeError, AttributeError) as bad:
        raise AnalysisProblem(f"{location} is not a schema file: {bad}") from bad


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)
