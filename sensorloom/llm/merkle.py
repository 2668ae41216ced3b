"""A Merkle manifest of a dataset by slot pivots.

Every document is a leaf of the tree of its group (its language, say). At each level conditional aggregates
spread a parent's children into `fan` slot columns: the columns joined are hashed to the parent, and the same
columns without a row's own slot are that row's siblings, in order. The roots of the groups are the leaves of
one more tree.

Levels are climbed in storeys. Rows are dealt by (tree, block of fan ** HEIGHT consecutive nodes) once a
storey, so that all levels of a storey are windows over the same exchange and the same sort: the ancestors of a
node, from the block down, are the leading sort columns, and each level's window takes a prefix of them. The
blocks' roots, a few hundredths of the nodes, are the next storey's nodes, and their siblings come back by a join
on (tree, block). A block is bounded, so neither a hot group nor a large one gathers in a task; positions are
counted in range partitions and added up over partitions, not over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Levels of a storey with two slots; more slots take fewer, so that a block keeps its size.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's values: `-` for a null, else the bytes' count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with pos (from 0) and total within its tree, in the order of the columns.

    Rows are ranged by (tree, order) and counted within the ranges; what stands before a range in its tree is added
    from one row a (tree, range). Equal rows may take each other's places.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("span", F.shiftright("at", 33))
    spans = ranged.groupBy("tree", "span").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "span", (before - F.col("start")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return ranged.join(spans, ["tree", "span"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "span", "shift")


def storey(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """nodes(tree, pos, total, hash, ...) with block, top (the hash of the node's ancestor at the block) and path.

    path: siblings a level, from the node up, as left and right of it; levels where the tree has one node alone add none.
    """
    up = [f"__p{k}" for k in range(height + 1)]
    rows = nodes.withColumn("block", F.floor(F.col("pos") / fan**height)).repartition("tree", "block")
    rows = rows.withColumns({p: F.floor(F.col("pos") / fan**k) for k, p in enumerate(up)}).withColumn("top", F.col("hash"))
    slots = [f"__s{j}" for j in range(fan)]
    path = []
    for k in range(height):
        own, parent = F.col(up[k]) % fan, Window.partitionBy("tree", "block", *up[height:k:-1])
        live = F.ceil(F.col("total") / fan**k) > 1
        rows = rows.withColumns({s: F.coalesce(F.max(F.when(own == j, F.col("top"))).over(parent), F.lit("")) for j, s in enumerate(slots)})
        beside = lambda keep, own=own: F.concat(F.lit(""), *[F.when(keep(F.lit(j), own), F.col(s)).otherwise("") for j, s in enumerate(slots)])
        step = F.struct(beside(lambda j, o: j < o).alias("left"), beside(lambda j, o: j > o).alias("right"))
        rows = rows.withColumns({f"__path{k}": F.when(live, step), "top": F.when(live, digest(*map(F.col, slots))).otherwise(F.col("top"))})
        path.append(f"__path{k}")
    rows = rows.withColumn("path", F.filter(F.array(*path), lambda s: s.isNotNull()))
    return rows.drop(*up, *slots, *path)


def climbed(nodes: DataFrame, most: int, fan: int, height: int) -> DataFrame:
    """nodes(tree, pos, total, hash, ...) with path up to the root of the tree and top, that root. most: the largest total."""
    rows = storey(nodes, fan, height)
    size = fan**height
    if most > size:
        blocks = rows.groupBy("tree", "block").agg(F.max("top").alias("hash"), F.ceil(F.max("total") / size).alias("total"))
        blocks = materialize(blocks.withColumnRenamed("block", "pos"), "blocks")
        above = climbed(blocks, -(-most // size), fan, height).select("tree", F.col("pos").alias("block"), F.col("path").alias("__above"), F.col("top").alias("__top"))
        rows = rows.drop("top").join(above, ["tree", "block"]).withColumn("path", F.concat("path", "__above")).withColumnRenamed("__top", "top").drop("__above")
    return rows.drop("block")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, by: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, fan: int = 2, extra: dict[str, Column] | None = None) -> DataFrame:
    """order, leaf, subroot, root and path (left and right siblings from the leaf to the root) for each row of docs.

    by: the column whose values make trees; a null is a tree of its own and the first. Leaves stand in ascending
    order of `order` (nulls first), ties by leaf; equal rows give equal leaves with a path each. A run of fan
    consecutive nodes (the last one may be shorter, even one node) becomes their digest until one node is left; a
    lone leaf is its subroot. extra: further columns of docs to carry along. Texts are read once and never
    shuffled, of any length; null values are written as `-`; other columns are ignored; an empty table has no rows.
    """
    if fan < 2:
        raise ValueError("a parent has two slots at least")
    height = max(1, int(HEIGHT / math.log2(fan)))
    extra = extra or {}
    leaf = leaf_of([F.col(c) for c in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))  # null first, then bytewise
    rows = docs.select(tree.alias("tree"), F.col(order).alias("__key"), leaf.alias("hash"), *[c.alias(f"__extra_{k}") for k, c in extra.items()])
    rows = materialize(numbered(materialize(rows, "leaves"), ["__key", "hash"]), "numbered")
    most = rows.agg(F.max("total")).first()[0] or 1
    rows = climbed(rows, most, fan, height).withColumnRenamed("top", "subroot")

    tops = materialize(rows.where("pos = 0").select(F.col("tree").alias("__tree"), F.col("subroot").alias("hash")), "subroots")
    tops = materialize(numbered(tops.withColumn("tree", F.lit("")), ["__tree"]), "trees")
    most = tops.agg(F.max("total")).first()[0] or 1
    tops = climbed(tops, most, fan, height).select(F.col("__tree").alias("tree"), F.col("path").alias("__above"), F.col("top").alias("root"))
    rows = rows.join(tops, "tree").withColumn("path", F.concat("path", "__above"))
    return rows.select(F.col("__key").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path", *[F.col(f"__extra_{k}").alias(k) for k in extra])
