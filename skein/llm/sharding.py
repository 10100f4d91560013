"""Operator 2. Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import fresh

#: A null key is placed like this number.
NULL_KEY = -1

#: Rows of a shard are numbered within slices of the key's hash, so that no shard is sorted by one task.
SLICES = 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, from 0 to shards - 1.

    All keys take their jumps together; a key that has jumped past the end drops out,
    after about ln(shards) steps.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[live] = ((at[live] + 1) * scale).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key, shards: int):
    """A Column with the shard of a long key; null is placed like NULL_KEY."""

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return place(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY).cast("long")))


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", slot: str = "slot", grown: str | None = "grown_shard") -> DataFrame:
    """Adds to every row its shard, its slot there (0, 1, ... without gaps) and its shard if one were appended.

    The shard depends on nothing but the key and the number of shards: equal keys share
    a shard, and one more shard takes its part of the rows from the others while all
    else stays. Null keys go together. Rows that repeat get slots of their own. An empty
    table gives an empty table; columns of df that carry a name given here are replaced.
    Slots number slices of a shard's rows side by side and add up the slices before.
    """
    rest = df.drop(*[c for c in df.columns if c.lower() in {x.lower() for x in (shard, slot, grown or "") if x}])
    part, n, before = fresh(rest, "slice"), fresh(rest, "rows_there"), fresh(rest, "rows_before")
    placed = rest.withColumn(shard, shard_of(key, shards))
    if grown:
        placed = placed.withColumn(grown, shard_of(key, shards + 1))
    # A salt that follows the key and not the row order, and repeats deal out by the rest of the row.
    placed = placed.withColumn(part, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rest.columns if "map" not in dict(rest.dtypes)[c]]), F.lit(SLICES)).cast("int"))
    counts = placed.groupBy(shard, part).agg(F.count(F.lit(1)).alias(n))
    # shards x SLICES rows at most, whatever the input.
    running = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, part, F.coalesce(F.sum(n).over(running), F.lit(0)).alias(before))
    numbered = placed.withColumn(slot, F.row_number().over(Window.partitionBy(shard, part).orderBy(F.col(f"`{key}`"))) - 1)
    return numbered.join(F.broadcast(counts), [shard, part]).withColumn(slot, (F.col(slot) + F.col(before)).cast("long")).drop(part, before)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length("text").cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))
    sized = sized.withColumn("size", F.coalesce("size", F.lit(0)) + F.lit(1).cast("long"))
    placed = assign_shards(sized, "doc_id", 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
