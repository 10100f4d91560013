"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_flat(df: DataFrame) -> bool:
    return not any(isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) for f in df.schema)


def write_text(df: DataFrame, location: str, delimiter: str = "|", delete_existing: bool = False) -> None:
    """A line for each row: fields with a delimiter between them, or JSON if a field holds records or sequences.

    An existing folder is an error unless delete_existing says to replace it.
    """
    mode = "overwrite" if delete_existing else "errorifexists"
    if is_flat(df):
        df.write.mode(mode).option("sep", delimiter).option("emptyValue", "").csv(location)
    else:
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(location)
