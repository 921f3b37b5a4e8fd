"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.session import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an undirected edge table; the component is its smallest node.

    Alternates two star operations: first every node sends its larger neighbours to the smallest one
    it knows, then its smaller ones; the edges shrink to stars around each component's smallest
    node in a number of rounds that grows with the logarithm of its size (Kiveris et al., 2014,
    "Connected Components in MapReduce and Beyond"). Every round is an aggregation with partial
    minima and a join, so a hub never has its neighbours gathered in one task. Rounds are written to
    the shared folder, so plans stay short and lost executors cost no round twice.

    Rows with a null end are left out, loops and repeated edges are harmless; a node that only has a
    loop is its own component. An empty table gives no rows.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    links = now.where(F.col("u") != F.col("v"))
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _mark(links)
        if after == mark:
            break
        mark = after
    return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum, by which two rounds are told apart."""
    return tuple(links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
