"""Connected components of link tables, in Spark joins only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.operators.skew import hot_join
from timbrel.session import finished, standing_on, written

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether all links lead from single-linked nodes to roots, so that each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(False).alias("root")).union(edges.select("v", F.lit(0), F.lit(True)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.bool_or("root").alias("root")).where("up > 1 or up > 0 and root").isEmpty()


def star_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of every node of a link; the component is its smallest node.

    Alternating large-star and small-star joins: the first links a node's larger
    neighbours to its smallest neighbour, the second its smaller ones and itself, until
    every component is a star. Rounds grow with the logarithm of the longest path. A hub is
    never gathered: its smallest neighbour comes from a map-side aggregate and is joined back
    by :func:`hot_join`.

    Links to itself, repeated and null links are ignored; no link gives no row.
    """
    edges = written(
        links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        # large-star: over both directions, larger neighbours go to the smallest of the neighbourhood
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("rows")), "low")
        large = finished(hot_join(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", edges, low)
        # small-star: smaller neighbours and the node itself go to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")), "low")
        small = hot_join(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = finished(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", large, low)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
    return standing_on(out, edges)


def frontier_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` by frontier search from many seeds at once.

    Adjacency is stored by node. Every node whose hash is the lowest of its
    neighbourhood is a seed, so each component has one. A round expands the frontier:
    a node reached for the first time takes the smallest label that reaches it and is
    the next frontier; where labels meet, the two labels are linked. The small graph of
    labels is merged by :func:`star_components`.
    """
    one = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    adjacent = written(one.union(one.select("v", "u")).distinct().repartition("u"), "adjacent")
    rank = F.xxhash64
    least = adjacent.groupBy("u").agg(F.min(F.struct(rank("v").alias("h"), F.col("v").alias("v"))).alias("n"), F.count("*").alias("rows"))
    degree = written(least.select(F.col("u").alias("node"), "rows", (F.struct(rank("u").alias("h"), F.col("u").alias("v")) < F.col("n")).alias("seed")), "degree")
    frontier = written(degree.where("seed").select("node", F.col("node").alias("label"), "rows"), "visited")
    parts, meetings = [frontier], []
    visited = frontier
    for _ in range(MAX_ROUNDS):
        if frontier.isEmpty():
            break
        reached = written(hot_join(adjacent, frontier.select(F.col("node").alias("u"), "label", "rows"), ["u"]).select(F.col("v").alias("node"), "label").distinct(), "reached")
        # a node reached by several labels joins them; one reached before joins its own with the new
        first = reached.groupBy("node").agg(F.min("label").alias("low"), F.count("*").alias("rows"))
        old = visited.select("node", F.col("label").alias("own"))
        held = written(first.join(old, "node", "left").select("node", "rows", F.coalesce("own", "low").alias("own"), F.col("own").isNull().alias("fresh")), "held")
        several = held.where("rows > 1 or not fresh").select("node", "own", "rows")
        meetings.append(hot_join(reached, several, ["node"]).where("label <> own").select(F.least("label", "own").alias("src"), F.greatest("label", "own").alias("dst")).distinct())
        frontier = written(held.where("fresh").select("node", F.col("own").alias("label")).join(degree.select("node", "rows"), "node"), "visited")
        parts += [frontier, reached, held]
        visited = visited.union(frontier)
    else:
        raise RuntimeError(f"the search did not end in {MAX_ROUNDS} rounds")
    if not meetings:
        return finished(visited.select("node", F.col("label").alias("component")), "components", adjacent, degree, *parts)
    stars = star_components(reduce(DataFrame.union, meetings))
    merged = stars.select(F.col("node").alias("label"), "component")
    size = visited.groupBy("label").agg(F.count("*").alias("rows")).join(merged, "label", "left")
    size = written(size.select("label", F.coalesce("component", "label").alias("component"), "rows"), "labels")
    found = hot_join(visited.select("node", "label"), size, ["label"]).select("node", "component")
    return finished(found, "components", adjacent, degree, stars, size, *parts)
