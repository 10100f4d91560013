"""What the text operators share: scratch tables, row ids, sized broadcasts, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and holds at most this many bytes.
BROADCAST_BYTES = 48 << 20
#: The same where many joins follow each other in one session, as in joined(): their tables stay in the driver's memory for a while.
CHAIN_BYTES = 4 << 20

#: Flags by which rows that a join does not need are left out before they are dealt.
FLAGS = 1 << 23

#: The white space that separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"


#: Folders of local sessions that have none set, by application.
_OWN_FOLDERS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir of the session.

    Only where it is unset and the session is local, a temporary folder is made; it is kept here and not in the session's settings.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN_FOLDERS.get(context.applicationId)
        if not found:
            found = _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="skein-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They survive lost executors and cut lineage.

    drop() removes a table that nothing reads any more. close() removes all of them, once the operator's result,
    which reads some of them, was written or collected. An operator that is given a Scratch leaves that to its caller.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found.scratch_path = path
        return found

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that write() returned."""
        for t in tables:
            self._delete(t.scratch_path)

    def close(self) -> None:
        self._delete(self.root)


def with_row_id(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Adds a value that is unique for each row and the same whenever the result is read.

    Rows of a file format that numbers them (Parquet) are known by file and place there, whatever splits a scan makes.
    Any other df is written once, with a number for each row.
    """
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    if "_metadata" not in df.columns and any("row_index" in hidden.apply(i).dataType().catalogString() for i in range(hidden.size())):
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return scratch.write(df.withColumn(name, F.monotonically_increasing_id()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(keep: list[str], *new: str) -> list[str]:
    """The columns to keep without those that new ones, named alike in any case, replace."""
    return [k for k in keep if k.lower() not in {n.lower() for n in new}]


def inner(df: DataFrame, keep: list[str], *more: Column) -> tuple[DataFrame, list[str], list[str]]:
    """df's columns keep under names that no operator uses, and more; those names; what turns them back."""
    names = [f"__keep_{i}" for i in range(len(keep))]
    return df.select(*(F.col(k).alias(n) for k, n in zip(keep, names)), *more), names, [F.col(n).alias(k) for k, n in zip(keep, names)]


def sized(df: DataFrame, row_bytes: int, rows: int | None = None, array: str | None = None, item_bytes: int = 8, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its counted rows, and the counted items of their column array, fit into most bytes; else it joins by a shuffle.

    df must be cheap to count: a written table.
    """
    items = 0
    if array:
        rows, items = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(array).cast("long")), F.lit(0))).first()
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes + items * item_bytes <= most else df


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the graph with the edges (a long, b long).

    Returns (node, root) for every node with an edge to another one. Each round maps a
    node to its neighbour of least hashed rank (itself included) and contracts the
    graph; a hashed rank shortens chains whatever the order of ids. Groups are never
    gathered: a round is a partial minimum and joins that can be split.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
    edges = scratch.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while edges.limit(1).count():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = step.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        step = scratch.write(step)
        maps.append(step)
        left, right = step.toDF("a", "x"), step.toDF("b", "y")
        before, edges = edges, edges.join(left, "a").join(right, "b").where("x <> y")
        edges = scratch.write(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(before)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1].toDF("node", "root")
    for step in reversed(maps[:-1]):
        # A node's image keeps its image's root; an image without edges left is a root itself.
        found = step.join(found.toDF("to", "root"), "to", "left")
        found = found.select("node", F.coalesce("root", "to").alias("root"))
    found = scratch.write(found)
    scratch.drop(edges, *maps)
    return found


def _flags(rows: DataFrame, wanted: DataFrame, column: str, how: str) -> tuple[DataFrame, Column]:
    """rows joined with the flags of wanted's values of the column, and whether a row's value is flagged. The flags are a table of fixed size."""
    slot = F.xxhash64(column).bitwiseAND(F.lit(FLAGS - 1).cast("long"))
    place = slot.bitwiseAND(F.lit(63).cast("long")).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    flags = wanted.groupBy(F.shiftright(slot, 6).alias("__flag")).agg(F.bit_or(bit).alias("__bits"))
    return rows.withColumn("__flag", F.shiftright(slot, 6)).join(F.broadcast(flags), "__flag", how), F.getbit("__bits", place) == 1


def flagged(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose value of the column is flagged by one in wanted: all of the values there, and some others."""
    found, is_flagged = _flags(rows, wanted, column, "inner")
    return found.where(is_flagged).drop("__flag", "__bits")


def parted(rows: DataFrame, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The flagged rows and all others, whose value is none of wanted's: what those of wanted need done, the others need not go through."""
    found, is_flagged = _flags(rows, wanted, column, "left")
    return tuple(found.where(c).drop("__flag", "__bits") for c in (is_flagged, ~F.coalesce(is_flagged, F.lit(False))))


def joined(postings: DataFrame, fits, alike, scratch: Scratch, chunk: int = 128, known: DataFrame | None = None, apart=None, zone=None) -> DataFrame:
    """(node, root) of the nodes linked to others, from postings (feature, node, n), one row for each feature of a node; n may be a struct.

    Linked are the nodes that share a feature, whose n fits(n, n) accepts, and that alike, given written pairs (a, b),
    leaves. A node first meets its features' first nodes, then those of all their nodes that it is not connected with
    yet. So a group of like nodes costs pairs in proportion to its size, but where the first nodes of all its
    features are unlike it: then it is compared in full, by chunks. Nodes with the root that most
    of a feature's have do not look for others, those look for them: in each chunk for the one with the least
    apart(n, n), and where that does not connect them, for all. A feature of two nodes has no more to meet than its first
    one. One of at most chunk nodes is gathered and met in one place. Of a larger one the nodes are gathered in chunks of
    about so many, by zone(n) and a hash, and a node looks for others in its own and the two next zones: fits must
    not accept nodes whose zones, integers, differ by more than one. No step holds a feature's nodes in one task: counts and firsts are partial aggregates, and joins split.
    postings is read twice. known, if given, are links (a, b) found before, a written table; nodes that they connect do not meet.
    """
    times = scratch.write(postings.groupBy("feature").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    features = times.count()
    several = postings if features * 24 <= CHAIN_BYTES or features > FLAGS else flagged(postings, times, "feature")
    shared = scratch.write(several.join(sized(times, 24, rows=features, most=CHAIN_BYTES), "feature"))
    firsts = scratch.write(shared.groupBy("feature").agg(F.min(F.struct("node", "n")).alias("first")))
    star = shared.join(sized(firsts, 48, most=CHAIN_BYTES), "feature").where((F.col("first.node") != F.col("node")) & fits(F.col("first.n"), F.col("n")))
    star = star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    if known is not None:
        placed = scratch.write(components(known, scratch))
        for side in "ab":
            star = star.join(sized(placed.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), 32, rows=placed.count(), most=CHAIN_BYTES), side, "left")
        star = star.where(~F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False))).select("a", "b")
    star = scratch.write(star)
    scratch.drop(times, firsts)
    links = alike(star)
    links = scratch.write(links if known is None else links.unionAll(known))
    found = components(links, scratch)
    placed = shared.where("times > 2").join(sized(found, 32, most=CHAIN_BYTES), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = placed.groupBy("feature", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = roots.groupBy("feature").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    mixed = scratch.write(mixed.where("roots > 1").select("feature", F.col("top.root").alias("major")))
    open_ = scratch.write(placed.join(sized(mixed, 32, most=CHAIN_BYTES), "feature").withColumn("zone", F.when(F.col("times") > chunk, zone(F.col("n")) if zone else F.lit(0)).cast("int")))
    scratch.drop(shared, mixed)
    large = open_.where(F.col("times") > chunk)
    parts = scratch.write(large.groupBy("feature", "zone").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")))
    parts = sized(parts, 24, most=CHAIN_BYTES)
    dealt = large.join(parts, ["feature", "zone"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    chunked = open_.where(F.col("times") <= chunk).withColumns({"zone": F.lit(0), "part": F.lit(0)}).unionByName(dealt)
    gathered = lambda rows, *more: rows.groupBy("feature", "zone", "part").agg(F.collect_list(F.struct("node", "n", "root")).alias("members"), *more)
    inside = lambda m, me: (m["root"] == F.col("major")) & fits(m["n"], me["n"])
    outside = lambda m, me: (m["root"] != me["root"]) & (m["root"] != F.col("major")) & (m["node"] < me["node"]) & fits(m["n"], me["n"])
    nearest = lambda ms, me: F.array_min(F.transform(ms, lambda m: F.struct((apart(m["n"], me["n"]) if apart else F.lit(0)).alias("d"), m["node"].alias("m"))))["m"]

    def met(me: Column) -> Column:
        """What a node meets of members: (m, more, node, n, root), more if there are others of the major root."""
        of = lambda m, more: F.struct(m.alias("m"), more.alias("more"), me["node"].alias("node"), me["n"].alias("n"), me["root"].alias("root"))
        others_ = F.transform(F.filter("members", lambda m: outside(m, me)), lambda m: of(m["node"], F.lit(False)))
        one = F.transform(F.array(F.filter("members", lambda m: inside(m, me))), lambda ms: F.when(F.size(ms) > 0, of(nearest(ms, me), F.size(ms) > 1)))
        return F.concat(others_, F.filter(one, lambda x: x.isNotNull()))

    whole = gathered(open_.where(F.col("times") <= chunk).withColumns({"zone": F.lit(0), "part": F.lit(0)}), F.first("major").alias("major"))
    whole = whole.withColumn("met", F.explode(F.flatten(F.transform(F.filter("members", lambda m: m["root"] != F.col("major")), met))))
    looks = large.where("root <> major").select("feature", "zone", F.struct("node", "n", "root").alias("me"), "major")
    if zone:
        looks = looks.withColumn("zone", F.explode(F.array(*[F.col("zone") + i for i in (-1, 0, 1)])))
    looks = looks.join(parts, ["feature", "zone"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    looks = looks.join(gathered(dealt), ["feature", "zone", "part"]).withColumn("met", F.explode(met(F.col("me"))))
    first = whole.select("feature", "zone", "part", "major", "met").unionAll(looks.select("feature", "zone", "part", "major", "met"))
    first = scratch.write(first.select("feature", "zone", "part", "major", F.struct("met.m", "met.more").alias("met"), "met.node", "met.n", "met.root"))
    pairs = lambda rows, m: rows.select(F.least("node", m).alias("a"), F.greatest("node", m).alias("b")).distinct()
    rest = scratch.write(pairs(first, "met.m").join(star, ["a", "b"], "left_anti"))
    more = scratch.write(alike(rest))
    found = found if more.isEmpty() else components(links.unionAll(more), scratch)
    # Chunks with more nodes of the major root, for those that are still apart from it.
    open_looks = first.where("met.more").select("feature", "zone", "part", "node", "n", "root", "major")
    for side in ("root", "major"):
        now = sized(found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_now")), 32, rows=found.count(), most=CHAIN_BYTES)
        open_looks = open_looks.join(now, side, "left").withColumn(f"{side}_now", F.coalesce(f"{side}_now", side))
    apart_still = scratch.write(open_looks.where("root_now <> major_now").drop("root_now", "major_now"))
    if not apart_still.isEmpty():
        wanted = scratch.write(apart_still.select("feature", "zone", "part").distinct())
        held = gathered(chunked.where("root = major").join(sized(wanted, 32, most=CHAIN_BYTES), ["feature", "zone", "part"], "left_semi"))
        last = apart_still.withColumn("me", F.struct("node", "n", "root")).join(held, ["feature", "zone", "part"]).select("node", F.explode(F.filter("members", lambda m: inside(m, F.col("me")))).alias("met"))
        last = scratch.write(pairs(last, "met.node").join(star.unionAll(rest), ["a", "b"], "left_anti"))
        final = scratch.write(alike(last))
        if not final.isEmpty():
            found = components(links.unionAll(more).unionAll(final), scratch)
        scratch.drop(wanted, last, final)
    scratch.drop(star, open_, first, rest, apart_still)
    return found
