"""Operator 9. Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Scratch, fresh, others, sized

CAPACITY, END_ID = 4096, 1
#: A worker forgets its words beyond this number; it loses time, not results.
POOL_WORDS = 400_000
#: Pieces of a group, which all its islands pack; islands of a group, packings on each, epochs between which elites
#: migrate, generations of an epoch; how full a bin must be to stay.
ISLAND, DEMES, POPULATION, EPOCHS, GENERATIONS, FULL = 4096, 2, 4, 3, 4, 0.995

_LATIN = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
_SIMPLE = re.compile(f"([{_LATIN}]+)([!-&(-/:-@\\\\[-`{{-~]*)")


class Words(dict):
    """white-space-free word -> its ids as little-endian 32-bit bytes, through the library's own steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = iter(range(256, 512))
        self.letter_of = [chr(b) if b in plain else chr(next(odd)) for b in range(256)]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, word: str) -> bytes:
        """Of a lower-case run that the tokenizer does not split before its merges."""
        found = self.parts.get(word)
        if found is None:
            found = self.old_parts.get(word)
            if found is None:
                tokens = self.tokenizer.model.tokenize("".join([self.letter_of[b] for b in word.encode()]))
                found = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if len(self.parts) > POOL_WORDS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[word] = found
        return found

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            simple = _SIMPLE.fullmatch(word)
            if simple and not any(s in word for s in self.special):
                run, rest = simple.groups()
                found = self.part(run.lower()) + (self.part(rest) if rest else b"")
            else:
                found = self.encode(word)
        if len(self) > POOL_WORDS:  # words in use come back from the older half
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def text(self, text: str) -> bytes:
        """The ids of a whole text. White space parts words and is dropped, so words can be encoded one by one."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def pieces(df: DataFrame, text: str, path: str, keep: list[str], capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Every row's token ids, then end_id, in pieces of at most capacity: keep, piece, start, length, ids_crc32 (and ids).

    Columns in keep named like a new one, in any case, are replaced.
    """
    keep = others(keep, "piece", "start", "length", "ids_crc32", *["ids"] * ids)
    kept = df.select(*keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = words_of(path), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, piece, length, crc, cut = [], [], [], [], []
                for i, value in enumerate(part.column(len(keep)).to_pylist()):
                    data = own.text(value or "") + end
                    for k, start in enumerate(range(0, len(data), size)):
                        one = data[start : start + size]
                        row.append(i)
                        piece.append(k)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if ids:
                            cut.append(np.frombuffer(one, "<i4"))
                there = pa.array(row, pa.int32())
                columns = [*(c.take(there) for c in part.columns[: len(keep)]), pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(cut, pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[: len(keep)], "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return kept.mapInArrow(work, f"{head}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Puts each item, in the order given, into the fullest bin that still takes it, or into a new one."""
    free = sorted((capacity - sum(map(sizes.__getitem__, b)), i) for i, b in enumerate(bins))
    for item in items:
        need = sizes[item]
        at = bisect.bisect_left(free, (need, -1))
        if at < len(free):
            room, i = free.pop(at)
            bins[i].append(item)
        else:
            room, i = capacity, len(bins)
            bins.append([item])
        if room > need:
            bisect.insort(free, (room - need, i))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's sum of squared fills."""
    return -len(bins), sum((sum(map(sizes.__getitem__, b)) / capacity) ** 2 for b in bins)


def settle(sizes: list[int], capacity: int, count: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """The first packings of an island: best fit over falling sizes, then over sizes with noise."""
    order = [np.argsort(-np.array(sizes), kind="stable"), *(np.argsort(-np.array(sizes) * rng.uniform(0.8, 1.25, len(sizes))) for _ in range(count - 1))]
    return [best_fit(o.tolist(), sizes, capacity, []) for o in order]


def evolve(sizes: list[int], capacity: int, deme: list[list[list[int]]], generations: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """A deme of packings after some generations of a grouping genetic algorithm, the fittest first.

    A crossover injects the best-filled bins of one parent whole into the other, removes
    the bins there that hold any of their items and deals the displaced items out by
    best fit. The bound ceil(sum / capacity) ends the search.
    """
    least = -(-sum(sizes) // capacity)
    down = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    fill = lambda b: sum(map(sizes.__getitem__, b))
    fit = lambda bins: fitness(bins, sizes, capacity)

    def child(mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        ranked = sorted(father, key=fill, reverse=True)
        given = [b[:] for b in ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))]]
        inside = {x for b in given for x in b}
        rest = sorted([b for b in mother if inside.isdisjoint(b)], key=fill)
        rest = [b[:] for b in rest[max(1, len(rest) // 20) :]]  # mutation: the emptiest bins are dealt out anew
        placed = inside.union(*rest)
        return best_fit([x for x in down if x not in placed], sizes, capacity, given + rest)

    deme = sorted(deme, key=fit, reverse=True)
    for _ in range(generations if len(deme) > 1 else 0):
        if len(deme[0]) <= least:
            break
        mate = int(rng.integers(1, len(deme)))
        young = child(deme[0], deme[mate]) if rng.random() < 0.5 else child(deme[mate], deme[0])
        if fit(young) > fit(deme[-1]):
            deme[-1] = young
            deme.sort(key=fit, reverse=True)
    return deme


#: What an island holds: a row for each item, with the item's bin in every packing, the fittest first. guest: the
#: elite that came from the island before. met: the fittest meets the bound, so that nothing is left to search for.
_ISLAND_ROWS = "grp long, deme int, guest boolean, no long, size long, bins array<int>, count long, fill double, met boolean"


def _islander(capacity: int, epoch: int):
    """The function that runs an epoch of one island in Spark and sends its elite to the next island of its group."""

    def work(key, table):
        group, home = key[0].as_py(), key[1].as_py()
        table = table.sort_by("no")  # the same search whatever order the rows came in
        guests = table.column("guest").to_numpy()
        own = table.filter(pa.array(~guests))
        sizes = own.column("size").to_pylist()
        if any(x is None or not 1 <= x <= capacity for x in sizes):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        rng = np.random.default_rng([group, home, epoch])
        if epoch:
            packings = [*zip(*own.column("bins").to_pylist())]
            if guests.any():
                packings[-1] = [x[0] for x in table.filter(pa.array(guests)).column("bins").to_pylist()]
            deme = [_bins(p) for p in packings]
        else:
            deme = settle(sizes, capacity, POPULATION, rng) if home else [best_fit(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, capacity, [])]
            if not home and len(deme[0]) > -(-sum(sizes) // capacity):
                deme += settle(sizes, capacity, POPULATION, rng)[1:]
        deme = evolve(sizes, capacity, deme, GENERATIONS if epoch else 0, rng)
        count, fill = fitness(deme[0], sizes, capacity)
        met = -count <= -(-sum(sizes) // capacity)
        places = np.empty((len(sizes), len(deme)), np.int32)
        for d, bins in enumerate(deme):
            for b, items in enumerate(bins):
                places[items, d] = b
        parts = [(home, False, places)]
        if epoch and not met:
            parts.append(((home + 1) % DEMES, True, places[:, :1]))
        out = []
        for to, guest, held in parts:
            n = len(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, held.shape[1]), pa.int32()), pa.array(held.ravel(), pa.int32()))
            same = lambda value, kind: pa.array([value] * n, kind)
            columns = [same(group, pa.int64()), same(to, pa.int32()), same(guest, pa.bool_()), own.column("no").combine_chunks(), own.column("size").combine_chunks(), lists]
            columns += [same(-count, pa.int64()), same(fill, pa.float64()), same(met, pa.bool_())]
            out.append(pa.Table.from_arrays(columns, ["grp", "deme", "guest", "no", "size", "bins", "count", "fill", "met"]))
        return pa.concat_tables(out)

    return work


def _bins(places: list[int]) -> list[list[int]]:
    found: dict[int, list[int]] = {}
    for item, b in enumerate(places):
        found.setdefault(b, []).append(item)
    return list(found.values())


def _packed(items: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(grp, no, size, bin): the fittest packing of every group, evolved on DEMES islands, a Spark task's work each.

    items has grp, no and size. In every epoch but the first an island evolves its deme,
    then its elite migrates to the next island through the written table. A group whose best fit
    meets the bound already has no islands.
    """
    blank = [F.lit(False).alias("guest"), "no", "size", F.lit(None).cast("array<int>").alias("bins"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("fill"), F.lit(None).cast("boolean").alias("met")]
    island = lambda df, epoch: scratch.write(df.groupBy("grp", "deme").applyInArrow(_islander(capacity, epoch), _ISLAND_ROWS))
    first = island(items.select("grp", F.lit(0).alias("deme"), *blank), 0)
    best = lambda df: df.select("grp", "no", "size", F.col("bins")[0].alias("bin"))
    open_ = first.where(~F.col("met"))
    if open_.isEmpty():
        return best(first)
    others = open_.select("grp", F.explode(F.sequence(F.lit(1), F.lit(DEMES - 1))).alias("deme"), *blank) if DEMES > 1 else None
    state = open_.unionAll(island(others, 0)) if DEMES > 1 else open_
    for epoch in range(1, EPOCHS + 1):
        state = island(state, epoch)
    own = state.where(~F.col("guest"))
    fittest = own.groupBy("grp").agg(F.max(F.struct((-F.col("count")).alias("few"), "fill", (-F.col("deme")).alias("back"))).alias("m"))
    fittest = scratch.write(fittest.select("grp", (-F.col("m.back")).cast("int").alias("deme")))
    return best(first.where("met")).unionAll(best(own.join(sized(fittest, 24), ["grp", "deme"])))


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset: rows of the given lengths share sequences of at most capacity, as few as it can.

    Rows are dealt by a hash to groups of about ISLAND rows. Each group is packed by DEMES
    islands that exchange elites. Bins that are at least FULL stay; the rows of the others
    are dealt anew to as few groups of that size as hold them, until one group is left or
    a round fills too few bins to go on (less than a quarter of its rows stay), so no task
    ever holds more than a group. Rows longer than capacity or shorter than 1 are an
    error; nulls too. An empty table gives an empty table. Columns of df named like the new ones are replaced.
    """
    scratch = scratch or Scratch(df.sparkSession, "packing")
    kept = df.drop("sequence_id", "offset")
    no = fresh(kept, "no")
    base = scratch.write(kept.withColumn(no, F.monotonically_increasing_id()))
    items = base.select(F.col(no).alias("no"), F.col(f"`{length}`").cast("long").alias("size"))
    left, out, level = items.count(), None, 0
    while True:
        groups = max(1, -(-left // ISLAND))
        dealt = items.select(F.pmod(F.xxhash64("no", F.lit(level)), F.lit(groups)).alias("grp"), "no", "size")
        packed = _packed(dealt, capacity, scratch)
        order = Window.partitionBy("grp", "bin").orderBy("no")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = packed.select("no", "size", (F.lit(level << 58) + F.col("grp") * (1 << 20) + F.col("bin")).alias("sequence_id"), (F.sum("size").over(order) - F.col("size")).alias("offset"), (F.sum("size").over(whole) >= FULL * capacity).alias("done"))
        placed = scratch.write(placed)
        rest = 0 if groups == 1 else placed.where("not done").count()
        last = rest == 0 or rest > left * 3 // 4
        stays = placed if last else placed.where("done")
        stays = stays.select("no", "sequence_id", "offset")
        out = stays if out is None else out.unionAll(stays)
        if last:
            break
        items, left, level = placed.where("not done").select("no", "size"), rest, level + 1
    return base.join(out.withColumnRenamed("no", no), no).drop(no)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "op9")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = scratch.write(pieces(docs, "text", public_tokenizers.path("word_bpe_49k.json"), ["doc_id"]))
    return pack(cut, scratch=scratch)


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
