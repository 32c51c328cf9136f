"""Connected components over pairs, in two ways.

``contracted_groups``  strips degree-one vertices and compresses degree-two chains until a
core is left, solves the core, and restores the labels of what was taken out.

``star_components``    alternating large-star and small-star; solves that core, and entity
graphs by itself.

Both work on string node names, name a group by its smallest node, never hold a group in one
task (aggregates are partial before each shuffle, joins on hot nodes are split by AQE) and
write each round as a table.

Defined cases, for both: null nodes and self-links link nothing; repeated and reversed pairs
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (u, v) with u < v; null ends and self-links dropped."""
    a, b = F.col(a), F.col(b)
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("_ok")).filter("_ok").select("u", "v").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(x, y) for each edge and its reverse, from one scan of the edges."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("_e")).select("_e.x", "_e.y")


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return r[0], r[1] or 0


def star_components(edges: DataFrame, stages: Stages, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of ``edges`` (u < v): root is the smallest node of its component.

    Alternates large-star (every larger neighbour of x is linked to the smallest of x and its
    neighbours) and small-star (every smaller neighbour of x, and x, are linked to the smallest),
    until the edges no longer change: then each component is a star around its smallest node.
    """
    now, state = edges, None
    for _ in range(max_rounds):
        adj = both_ways(now)
        low = adj.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = adj.filter("y > x").join(low, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u < v").distinct()
        large = stages.write(large, "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        kept = large.join(low, "v")
        small = kept.select("m", F.explode(F.array("u", "v")).alias("v")).filter("m < v").select(F.col("m").alias("u"), "v").distinct()
        small = stages.write(small, "small")
        new = _state(small)
        stages.drop(large)
        if now is not edges:
            stages.drop(now)
        now = small
        if new == state or new[0] == 0:
            break
        state = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _independent(edges: DataFrame) -> DataFrame:
    """(x, lo, hi): vertices of degree one or two that come before their neighbours of such degree; lo and hi are their neighbours.

    Vertices of degree one come first, others by a random priority.  Each tells its neighbours its place, so
    a vertex meets the earliest of them as one row.  Neighbours of equal place both wait.
    """
    d = both_ways(edges).groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.min("y").alias("lo"), F.max("y").alias("hi")).filter("d <= 2")
    place = F.xxhash64("x").bitwiseAND(F.lit((1 << 61) - 1)) + (F.col("d") - 1) * (1 << 61)
    low = d.select("x", "lo", "hi", place.alias("place"))
    told = low.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), "place").groupBy("x").agg(F.min("place").alias("other"))
    return low.join(told, "x", "left").filter("other is null or place < other").select("x", "lo", "hi")


def contracted_groups(pairs: DataFrame, a: str, b: str, stages: Stages, max_rounds: int = 200, least_share: float = 0.02) -> DataFrame:
    """(node, group_id): each node of a group of two or more, named by the group's smallest node.

    A round takes out an independent set of the vertices of degree at most two.  A vertex of degree one
    points to its neighbour; one of degree two points to a neighbour and leaves an edge between its two
    neighbours, which is list ranking of a chain by repeated removal: about a third of a long chain goes in
    each round.  When fewer than ``least_share`` of the edges would go, the core is solved with alternating
    stars.  A pointer leads to a vertex that was taken out later or never, so all pointers together are
    followed by doubling, in as many steps as the number of rounds has binary digits; what is at their ends
    has the labels.
    """
    edges, left = stages.write_counted(undirected(pairs, a, b), "edges")
    removed, first = [], edges
    for _ in range(max_rounds):
        if not left:
            break
        gone, n = stages.write_counted(_independent(edges), "gone")
        if n == 0:
            break
        removed.append(gone)
        ends = gone.select("x")
        rest = edges.join(ends.withColumnRenamed("x", "u"), "u", "left_anti").join(ends.withColumnRenamed("x", "v"), "v", "left_anti")
        bridges = gone.filter("lo < hi").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        before = left
        new, left = stages.write_counted(rest.select("u", "v").unionByName(bridges).distinct(), "edges")
        if edges is not first:
            stages.drop(edges)
        edges = new
        if n / before < least_share:
            break
    label = star_components(edges, stages) if left else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if removed:
        point = reduce(DataFrame.unionByName, [g.select(F.col("x").alias("node"), F.col("lo").alias("to")) for g in removed])
        for k in range((len(removed) - 1).bit_length()):
            point = stages.write(point.join(point.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"pointers{k}")
        # a vertex takes the label of the one at the end, or that one itself if it stayed alone
        at = point.join(label.withColumnRenamed("node", "to"), "to", "left").select("node", "to", "root")
        alone = at.filter("root is null").select(F.col("to").alias("node"), F.col("to").alias("root")).distinct()
        label = stages.write(reduce(DataFrame.unionByName, [label, at.select("node", F.coalesce("root", "to").alias("root")), alone]), "labels")
    least = label.groupBy("root").agg(F.min("node").alias("group_id"))
    return label.join(least, "root").select("node", "group_id")
