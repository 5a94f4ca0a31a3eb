"""Consolidating pairwise matches into groups.

The pairs are range-partitioned and cut into chunks of bounded size. Union-find in each chunk keeps a spanning forest
only: one row for each node, pointing at the least node of its local component. A node then hangs on the least of its
local roots, and the links between that root and its other local roots are the pairs of the next, much smaller level.
Levels follow until no pairs are left, the last one in a single bounded chunk; group ids then go back down. A node with a
third of all pairs is spread over many chunks, and gives one row in each.

Chunks of near ids merge nothing where every pair leads to another chunk, as with ids in the order of frames. So a level
that keeps more than SLOW of its pairs is followed by levels of stars: each node looks at its neighbour of the least hash,
and hangs on it if that one has no lesser neighbour itself. On a chain about three of five nodes go with each such level,
whatever their ids are, so the number of levels grows with the logarithm of the pairs.

Defined cases: pairs with a null end, or of a node with itself, match nothing; repeated pairs count once; the group id is
the least node of the group; no pairs give no rows. Extra columns are not read. Keys can be integers or strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.runs import chunks
from stemline.llm.unionfind import components
from stemline.skew import hot_ends, lookup
from stemline.store import Scratch

#: Pairs of a chunk.
BOUND = 1_000_000
#: A level that keeps a larger part of its pairs is followed by stars.
SLOW = 0.7


def _forest(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, bound):
            node, root = components(t.column("a").to_numpy(), t.column("b").to_numpy())
            kind = t.schema.field("a").type
            yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(root, kind)], ["node", "root"])

    return run


def _chunk_level(pairs: DataFrame, n: int, bound: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of all nodes, and the pairs between parents that are left."""
    schema = ", ".join(f"{c} {pairs.schema['a'].dataType.simpleString()}" for c in ("node", "root"))
    level = pairs.repartition(1) if n <= bound else pairs.repartitionByRange(-(-n // bound), "a", "b").sortWithinPartitions("a", "b")
    forest = level.mapInArrow(_forest(bound), schema)
    if n <= bound:
        return scratch.keep(forest.withColumnRenamed("root", "parent"), "forest"), pairs.limit(0)
    least = W.partitionBy("node").orderBy("root")
    kept = scratch.keep(forest.select("node", "root", F.first("root").over(least).alias("parent"), F.row_number().over(least).alias("k")), "forest")
    # the node's row of itself as a local root also links it to its parent
    left = kept.where("root <> parent").select(F.col("parent").alias("a"), F.col("root").alias("b")).distinct()
    return kept.where("k = 1").select("node", "parent"), left


def _star_level(pairs: DataFrame, number: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of all nodes, the parent being the least of its star, and the pairs between stars that are left."""
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("best"))
    near = scratch.keep(near.select("node", F.when(F.col("best") < rank("node"), F.col("best.n")).alias("wish")), "near")
    tops = near.where("wish is null").select(F.col("node").alias("wish"), F.lit(True).alias("top"))
    wishes = near.where("wish is not null")
    star = lookup(wishes, tops, "wish", F.col("node")).select("node", F.when(F.col("top"), F.col("wish")).otherwise(F.col("node")).alias("star"))
    star = scratch.keep(star.unionByName(near.where("wish is null").select("node", F.col("node").alias("star"))), "stars")
    named = star.groupBy("star").agg(F.min("node").alias("parent"))
    level = scratch.keep(lookup(star, named, "star", F.col("node"), "inner").select("node", "parent"), "forest")
    hot = hot_ends(pairs, ["a", "b"])
    for c, other in (("a", "b"), ("b", "a")):
        pairs = lookup(pairs, level.select(F.col("node").alias(c), F.col("parent").alias(f"{c}p")), c, F.col(other), "inner", hot[c])
    left = pairs.where("ap <> bp").select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).distinct()
    return level, left


def consolidate(pairs: DataFrame, a: str = "a", b: str = "b", bound: int = BOUND, sizes: list[int] | None = None) -> DataFrame:
    """(node, group) for each node that is matched to another one, at once or over others.

    sizes: takes the number of pairs of each level.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    n, before, slow = left.count(), float("inf"), False
    levels: list[DataFrame] = []
    while n:
        if sizes is not None:
            sizes.append(n)
        slow = slow or n > SLOW * before
        level, rest = _star_level(left, len(levels), scratch) if slow and n > bound else _chunk_level(left, n, bound, scratch)
        levels.append(level)
        rest = scratch.keep(rest, "pairs")
        scratch.drop(left)
        left, before, n = rest, n, rest.count()
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("group"))
    group = levels.pop().withColumnRenamed("parent", "group")
    while levels:
        up = scratch.keep(group, "group").withColumnRenamed("node", "parent")
        group = lookup(levels.pop(), up, "parent", F.col("node")).select("node", F.coalesce("group", "parent").alias("group"))
    return group


def matched_nodes(edges: DataFrame, nodes: DataFrame, source: str = "source_id", target: str = "target_id", key: str = "node_id") -> DataFrame:
    """(a, b) of links whose ends both exist in nodes."""
    ids = nodes.where(F.col(key).isNotNull()).select(F.col(key)).distinct()
    links = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    hot = hot_ends(links, ["a", "b"])
    links = lookup(links, ids.withColumnRenamed(key, "a"), "a", F.col("b"), "left_semi", hot["a"])
    return lookup(links, ids.withColumnRenamed(key, "b"), "b", F.col("a"), "left_semi", hot["b"])


def group_all(nodes: DataFrame, pairs: DataFrame, key: str = "node_id", bound: int = BOUND) -> DataFrame:
    """(key, group_id) for every node, those without a match in a group of their own."""
    grouped = consolidate(pairs, bound=bound).withColumnRenamed("node", key)
    every = nodes.where(F.col(key).isNotNull()).select(key).distinct()
    return every.join(grouped, key, "left").select(key, F.coalesce("group", key).alias("group_id"))
