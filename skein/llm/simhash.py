"""Operator 5. SimHash near-duplicates with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, components, sized

#: Words of a shingle, seed of its XXH64, and differing bits of a link in the query.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Rows of a bucket up to which one task compares it; larger ones are cut into tiles of this size.
TILE = 1 << 15
#: Rows that a bucket has on average at most; more fingerprints make for longer keys.
BUCKET = 256
#: (row, word of 64 lanes) pairs that are compared at once, and planes between two looks for blocks to abandon.
STRIP, LOOK = 1 << 14, 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as an unsigned integer.

    A-Z become a-z; words are runs without ASCII white space. Fewer words than a shingle
    make one shingle of what there is; no word gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str, keep: list[str], shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """keep and the fingerprint of every row, as a signed long with the same bits."""
    kept = df.select(*keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([fingerprint(t, shingle) for t in part.column(len(keep)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found.view(np.int64))], [*part.schema.names[: len(keep)], name])

    return kept.mapInArrow(work, f"{head}, `{name}` long")


def key_masks(rows: int, radius: int) -> list[int]:
    """Bit masks such that any two fingerprints within radius agree on all bits of one of them.

    The 64 bits are cut into blocks, of which radius may differ; each choice of the
    others is a mask. The number of blocks grows with the rows, so buckets stay small.
    """
    for blocks in range(radius + 1, 64):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(parts, blocks - radius)]
        if rows >> min(m.bit_count() for m in masks) <= BUCKET or blocks >= radius + 6:
            return masks
    return [(1 << 64) - 1]


def planes_of(values: np.ndarray) -> np.ndarray:
    """values: (words, 64) uint64. Plane k of a word holds bit k of its 64 values: (words, 64) uint64."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view(np.uint64).reshape(len(values), 64)


def close_lanes(queries: np.ndarray, planes: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query and a word of 64 values: which pairs have values within radius, and the lanes of these.

    planes: of all words; word: the word of each pair; lanes: bits of the lanes that count.
    A carry-save counter adds a plane to 64 distances at once. A lane that has more than
    radius differing bits is out; a pair whose lanes are all out is abandoned.
    """
    width = radius.bit_length() + 1
    index, alive, held = np.arange(len(queries)), lanes.copy(), planes[word]
    counters = [np.zeros(len(queries), np.uint64) for _ in range(width)]
    for k in range(64):
        carry = held[:, k] ^ np.where((queries >> np.uint64(k)) & np.uint64(1), _ALL, np.uint64(0))
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        alive &= ~carry  # the counter ran over
        if k % LOOK == LOOK - 1:
            alive &= ~_above(counters, radius)
            keep = np.flatnonzero(alive)
            if len(keep) < len(alive):
                index, alive, queries, held = index[keep], alive[keep], queries[keep], held[keep]
                counters = [c[keep] for c in counters]
            if not len(index):
                break
    return index, alive


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than radius."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more


class _Forest:
    """Union-find over row numbers; join() says if two trees became one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(values: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets of sorted rows: every two values of a bucket within radius are linked or connected by links."""
    n = len(values)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    base = np.cumsum(words) - words  # of each bucket's words
    inside = np.arange(n) - np.repeat(starts, sizes)
    own = np.repeat(base, sizes) + inside // 64
    grid, row_at = np.zeros((int(words.sum()), 64), np.uint64), np.zeros((int(words.sum()), 64), np.int64)
    grid[own, inside % 64] = values
    row_at[own, inside % 64] = np.arange(n)
    filled = np.bincount(own, minlength=len(grid)).astype(np.uint64)
    full = np.where(filled == 64, _ALL, (np.uint64(1) << (filled % np.uint64(64))) - np.uint64(1))
    planes = planes_of(grid)
    last = np.repeat(base + words, sizes)  # each row meets the later lanes of its word and the later words of its bucket
    forest, left, right = _Forest(n), [], []
    rows = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    todo = (last - own)[rows]
    ends = np.cumsum(todo)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRIP, "right")))
        part, count = rows[at:stop], todo[at:stop]
        query = np.repeat(part, count)
        step = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        word = own[query] + step
        after = ~((np.uint64(2) << (inside[query] % 64).astype(np.uint64)) - np.uint64(1))
        lanes = full[word] & np.where(step == 0, after, _ALL)
        index, alive = close_lanes(values[query], planes, word, lanes, radius)
        for i, bits in zip(index.tolist(), alive.tolist()):
            a, w = int(query[i]), int(word[i])
            while bits:
                low = bits & -bits
                b = int(row_at[w, low.bit_length() - 1])
                if forest.join(a, b):
                    left.append(a)
                    right.append(b)
                bits ^= low
        at = stop
    return values[left], values[right]


def close_pairs(distinct: DataFrame, radius: int, rows: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between distinct fingerprints (a column fingerprint): all within radius are connected by links within radius."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = key_masks(rows, radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])
    keyed = distinct.select("fingerprint", F.explode(tables).alias("key")).select("fingerprint", F.xxhash64("key.t", "key.k").alias("bucket"), F.lit(0).alias("tile"))
    hot = scratch.write(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE))
    hot_rows = hot.count()
    if hot_rows:
        # A bucket of several tiles: a row goes to every pair of tiles that has its own.
        tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
        spread = keyed.join(sized(hot, 16, hot_rows), "bucket", "left").withColumn("of", F.coalesce(tiles, F.lit(1)))
        spread = spread.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("of")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
        keyed = spread.withColumn("other", other).select("fingerprint", "bucket", (F.least("own", "other") * F.col("of") + F.greatest("own", "other")).alias("tile"))
    dealt = keyed.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "fingerprint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.r_[0, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)])
            a, b = bucket_links(rows[:, 0].view(np.uint64), number, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(map(len, held)) >= 1 << 14:
                rows = np.ascontiguousarray(np.concatenate(held))
                cut = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))
                if len(cut):  # what follows the last change may go on
                    yield done(np.ascontiguousarray(rows[: cut[-1] + 1]))
                    rows = rows[cut[-1] + 1 :]
                held = [rows]
        if held:
            yield done(np.ascontiguousarray(np.concatenate(held)))

    return dealt.mapInArrow(work, "a long, b long")


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """(key, fingerprint, component_id) for every row: component_id is the smallest key reachable over links.

    Fingerprints that differ in at most radius bits are linked; equal ones too. Equal
    fingerprints are one node, so copies cost a row each and no pairs. A null text has
    the fingerprint zero, as have texts without words, and is linked like any other. A
    null key is never the smallest unless a group has no other. Repeated rows stay. An
    empty table gives an empty table; other columns of df are not read.
    """
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    prints = scratch.write(fingerprints(df.select(F.col(key), F.col(text)), text, [key], shingle))
    distinct = scratch.write(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    links = close_pairs(distinct.select("fingerprint"), radius, distinct.count(), scratch)
    found = components(links, scratch)
    roots = found.join(distinct, found["node"] == distinct["fingerprint"]).groupBy("root").agg(F.min("least").alias("component_id"))
    placed = found.join(roots, "root").select(F.col("node").alias("fingerprint"), "component_id")
    placed = scratch.write(distinct.join(placed, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(placed, "fingerprint").select(key, "fingerprint", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
