"""Operator 6. Exact near-duplicates of embeddings by dual traversal of cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, components

#: Least cosine of a link in the query.
COSINE = 0.98
#: Vectors of a block; a label with more is cut into blocks that are compared by pairs.
BLOCK = 2048
#: Points of a node that are compared directly, and the slack for rounding of distances.
LEAF, SLACK = 24, 1e-7


class CoverTree:
    """Nested levels of centres over unit vectors; the radius that a level covers is half that of the level above.

    Node 0 is the root. A node's points are order[lo:hi]; its centre is the first of
    them and also the centre of its first child; radius is the greatest distance of one
    of its points from the centre.
    """

    def __init__(self, units: np.ndarray):
        self.units = units
        self.order = np.arange(len(units))
        self.lo, self.hi, self.radius, self.children = [], [], [], []
        self._build()
        self.radius = np.array(self.radius)
        self.lo, self.hi = np.array(self.lo, np.int64), np.array(self.hi, np.int64)
        self.centre = self.order[self.lo]

    def _add(self, lo: int, hi: int) -> int:
        here = self.order[lo:hi]
        self.lo.append(lo)
        self.hi.append(hi)
        self.radius.append(float(_distance(self.units[here], self.units[here[:1]]).max()) if hi - lo > 1 else 0.0)
        self.children.append([])
        return len(self.lo) - 1

    def _build(self) -> None:
        level = [(self._add(0, len(self.units)), 2.0)]
        while level:
            below = []
            for node, cover in level:
                lo, hi = self.lo[node], self.hi[node]
                if hi - lo <= LEAF or self.radius[node] < 1e-6:
                    continue
                half = cover / 2
                while half >= self.radius[node]:  # levels that would have this centre alone
                    half /= 2
                rest, parts = self.order[lo:hi], []
                while len(rest):  # the next uncovered point covers what is within half
                    near = _distance(self.units[rest], self.units[rest[:1]])[:, 0] <= half
                    near[0] = True
                    parts.append(rest[near])
                    rest = rest[~near]
                self.order[lo:hi] = np.concatenate(parts)
                at = lo
                for part in parts:
                    child = self._add(at, at + len(part))
                    self.children[node].append(child)
                    below.append((child, half))
                    at += len(part)
            level = below


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def dual(left: CoverTree, right: CoverTree, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each point of left and of right, and links enough to connect what is connected.

    A pair of nodes is dropped if its centres are farther apart than both radii and the
    link distance, taken whole if all its points must be linked, and else opened at its
    larger node. same: both trees are one; a pair counts once for each end.
    """
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    n_left = np.zeros(len(left.units), np.int64)
    n_right = n_left if same else np.zeros(len(right.units), np.int64)
    edges: list[tuple[int, int]] = []
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64), same)]
    while stack:
        many, others, siblings = stack.pop()
        for at in range(0, len(many), 2048):
            a, b = many[at : at + 2048], others
            apart = _distance(left.units[left.centre[a]], right.units[right.centre[b]])
            both = left.radius[a][:, None] + right.radius[b][None, :]
            for i, j in np.argwhere(apart <= both + reach + SLACK).tolist():
                x, y = int(a[i]), int(b[j])
                if siblings and y < x:  # (y, x) is there too
                    continue
                p, q = left.order[left.lo[x] : left.hi[x]], right.order[right.lo[y] : right.hi[y]]
                if x != y and apart[i, j] + both[i, j] <= reach - SLACK or same and x == y and 2 * left.radius[x] <= reach - SLACK:
                    own = same and x == y
                    n_left[p] += len(q) - own
                    if not own:
                        n_right[q] += len(p)
                    edges += [(int(p[0]), int(z)) for z in (q[1:] if own else q)] + ([] if own else [(int(z), int(q[0])) for z in p[1:]])
                    continue
                cx, cy = left.children[x], right.children[y]
                if not cx and not cy:
                    close = left.units[p] @ right.units[q].T >= cosine
                    if same and x == y:
                        close[np.arange(len(p)), np.arange(len(p))] = False
                        n_left[p] += close.sum(axis=1)
                        close = np.triu(close, 1)
                    else:
                        n_left[p] += close.sum(axis=1)
                        n_right[q] += close.sum(axis=0)
                    edges += [(int(p[k]), int(q[m])) for k, m in np.argwhere(close)]
                elif same and x == y:
                    kids = np.array(cx)
                    stack.append((kids, kids, True))
                elif cx and (not cy or left.radius[x] >= right.radius[y]):
                    stack.append((np.array(cx), np.array([y]), False))
                else:
                    stack.append((np.array([x]), np.array(cy), False))
    return n_left, n_right, edges


def _block_pair(cosine: float):
    """The function that compares two blocks of a label (or one with itself) in Spark."""

    def work(key, table):
        first, second = key[-2].as_py(), key[-1].as_py()
        block = table.column("__own").to_numpy()
        rows = table.column("__row").to_numpy()
        flat = table.column("__unit").combine_chunks()
        units = flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        order = np.argsort(rows, kind="stable")  # the same tree whatever order the rows came in
        a = order[block[order] == first]
        tree = CoverTree(units[a])
        if first == second:
            counts, _, edges = dual(tree, tree, cosine, True)
            found, linked, ends = a, counts, a
        else:
            b = order[block[order] == second]
            if not len(a) or not len(b):
                found, linked, edges, ends = a[:0], a[:0], [], a
            else:
                one, two, edges = dual(tree, CoverTree(units[b]), cosine, False)
                found, linked, ends = np.r_[a, b], np.r_[one, two], b
        links = np.array(sorted(_forest(edges, first == second)), np.int64).reshape(-1, 2)
        some = linked > 0
        left = np.r_[rows[found[some]], rows[a[links[:, 0]]]]
        none = [None] * int(some.sum())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(none + rows[ends[links[:, 1]]].tolist(), pa.int64()), "n": pa.array(linked[some].tolist() + [None] * len(links), pa.int64())})

    return work


def _forest(edges: list[tuple[int, int]], same: bool) -> set[tuple[int, int]]:
    """Of the edges of two blocks, those of a spanning forest."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = set()
    for a, b in edges:
        x, y = find(a), find(b if same else ~b)
        if x != y:
            up[x] = y
            kept.add((a, b))
    return kept


def near_vectors(df: DataFrame, key: str, vector: str, label: str, cosine: float = COSINE, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of df.

    Rows with equal labels are linked if the cosine of their vectors, in double
    precision, is at least cosine. Rows whose label or vector is null, and vectors that
    are empty, zero or hold null or non-finite numbers, link with nothing; vectors of
    different lengths neither. component_id is the smallest key reachable, kept says
    that it is the row's own. Repeated rows are rows of their own; a null key is never
    the smallest unless it is alone. df is a table as it was read; other columns are
    not read. A label of several blocks sends each row to every pair of blocks that has
    its own, as any exact comparison must where bounds cannot rule pairs out.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    base = df.select(F.col(key).alias("__key"), F.col(vector).alias("__vector"), F.col(label).alias("__label"))
    base = scratch.write(base.withColumn("__row", F.monotonically_increasing_id()))
    doubles = F.transform("__vector", lambda x: x.cast("double"))
    good = base.where(F.col("__label").isNotNull() & F.col("__vector").isNotNull() & (F.size("__vector") > 0))
    good = good.where(~F.exists("__vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # Scaled by its largest component first, so that no square over- or underflows.
    good = good.withColumn("__vector", doubles).withColumn("__top", F.array_max(F.transform("__vector", F.abs))).where("__top > 0")
    good = good.withColumn("__vector", F.transform("__vector", lambda x: x / F.col("__top")))
    norm = F.sqrt(F.aggregate("__vector", F.lit(0.0), lambda s, x: s + x * x))
    good = good.withColumn("__norm", norm).select("__row", "__label", F.size("__vector").alias("__dim"), F.transform("__vector", lambda x: x / F.col("__norm")).alias("__unit"))
    good = scratch.write(good)
    counts = good.groupBy("__label", "__dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("__of"))
    dealt = good.join(counts, ["__label", "__dim"]).withColumn("__own", F.pmod(F.xxhash64("__row"), F.col("__of")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__of") - 1)))
    dealt = dealt.withColumn("__first", F.least("__own", "__other")).withColumn("__second", F.greatest("__own", "__other"))
    dealt = dealt.select("__label", "__dim", "__first", "__second", "__own", "__row", "__unit")
    found = scratch.write(dealt.groupBy("__label", "__dim", "__first", "__second").applyInArrow(_block_pair(cosine), "a long, b long, n long"))
    counted = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "__row")
    nodes = components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "__row")
    least = nodes.join(base.select("__row", "__key"), "__row").groupBy("root").agg(F.min("__key").alias("component_id"))
    placed = scratch.write(nodes.join(least, "root").select("__row", "component_id").join(counted, "__row", "full"))
    out = base.select("__row", "__key").join(placed, "__row", "left")
    out = out.select(F.col("__key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "__key").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


QUERIES = {"op6_embeddings": op6_embeddings}
ORACLE_SQL = {
    "op6_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x
), counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id::BIGINT AS component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.x = v.vec_id LEFT JOIN counted c ON c.x = v.vec_id
"""
}
