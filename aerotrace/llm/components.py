"""Connected components of a table of links by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links per partition of a table of links, and its partitions at least.
PER_PARTITION, LEAST_PARTITIONS = 200_000, 16
EDGE = "u long, v long"


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its number of rows asks for, without a shuffle."""
    return df.coalesce(max(LEAST_PARTITIONS, -(-rows // PER_PARTITION)))


def _forest(batches):
    """The links of a partition as stars: each node with the smallest node that it reaches through them."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not sum(len(x) for x, _ in held):
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
    nodes, number = np.unique(ends, return_inverse=True)
    a, b = number[: len(number) // 2], number[len(number) // 2 :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b):
            np.minimum.at(new, x, least)
            np.minimum.at(new, root[x], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    use = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(nodes[root[use]])], names=["u", "v"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one root."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(None), F.lit(1)))
    return ends.groupBy("node").agg(F.min("up").alias("a"), F.max("up").alias("b"), F.max("down").alias("down")).filter("a < b OR (a IS NOT NULL AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long), computed already.  Returns node, component (the smallest node reachable) of every node with a link.

    The links of each partition are united in memory first, so a node has at
    most one link in each.  Each round joins every node's larger neighbours, then
    its smaller ones, to the smallest of them, and unites partitions again.
    Rounds end when the links are stars; their number grows with the
    logarithm of the longest chain, and links that are stars need none.  Minima
    are combined before they are shuffled, and the joins are plain ones, which
    adaptive execution can split where one node holds very many links.
    """
    rows = links.count()
    edges = saved(compact(links.select("u", "v").filter("u <> v"), rows).mapInArrow(_forest, EDGE))
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(compact(pulled.union(small.select("u", F.col("m").alias("v"))).filter("u <> v"), rows).mapInArrow(_forest, EDGE))
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select("v").distinct()
    return saved(compact(stars.select(F.col("u").alias("node"), "component").union(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))), 2 * rows))
