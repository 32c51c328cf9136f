"""Problem 1: clusters of mutually near trails, by density peaks over compared pairs.

1.  Each pipeline's distances fall into a near and a far range: the gap between them is found from a
    histogram of all its distances (``near_limits``), whatever share of them is near.
2.  The runs of a pair are joined into one scaled result: distance by limit, near below 1 (``pair_results``).
3.  Blocked neighbour joins, the shared near neighbour being the block, tell what the third trails say of
    two trails (``agreement``): one that is near to both puts them at the larger of its two scaled
    distances, one that is near to one and far from the other puts them at ``FAR``.  The distance of two
    trails is the mean of what the third trails and their own result say.  Only supported pairs count from
    here on: those that more third trails hold together than apart.  So a single near pair between two sets
    that are otherwise far has no support, while two members that were never compared, or have one far
    result, have it.
4.  Local density is the number of supported near neighbours; ``delta`` is the distance to the nearest
    supported denser trail, ``FAR`` without one, and a trail points to that trail (``density_peaks``).
    Peaks are the trails with the largest density times delta: those whose delta is ``FAR``.
5.  Pointers are followed by doubling to the peaks, whose names label the clusters (``follow``).
6.  A trail that is far from most of its cluster leaves it.

No step holds a cluster or a hot trail in one task: counts are partial before each shuffle and AQE
splits hot join keys.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_trail
from ..functions.numbers import finite
from ..sources.stages import Stages

#: Width of a histogram bin in natural log units; all doubles fall into under 75,000 bins.
BIN = 0.02
#: Ratio of the two ends of the gap, at least.
RATIO = 1.2
#: Distances on either side of a gap beyond which more of them make it no likelier.
ENOUGH = 50
#: Scaled distance of trails that are apart.
FAR = 2.0


def compared(pairs: DataFrame, a: str = "trail_a_id", b: str = "trail_b_id", dist: str = "dist_euclidean") -> DataFrame:
    """(lo, hi, pipeline, run, d): pair rows of two different trails with a distance; others are dropped."""
    d = finite(dist)
    x, y = base_trail(a), base_trail(b)
    rows = pairs.select(x.alias("a"), y.alias("b"), F.coalesce("pipeline", F.lit("unknown")).alias("pipeline"), F.col("comparison_id").alias("run"), F.when(d >= 0, d).alias("d"))
    rows = rows.filter("a is not null and b is not null and d is not null and a <> b")
    return rows.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "pipeline", "run", "d")


def near_limits(pairs: DataFrame, dist: str = "dist_euclidean") -> DataFrame:
    """(pipeline, n, n_near, near_limit): the middle of the gap between near and far distances of each pipeline.

    Of the gaps with a ratio of at least ``RATIO`` that one is taken whose log width, times the number of
    distances on its smaller side (``ENOUGH`` at most), is the largest: stray values leave wide gaps, but
    few beyond them, and no share of the distances needs to be near.  Zero distances are near and take no
    part.  A pipeline whose distances form one range has a null limit.
    """
    rows = pairs.select(F.coalesce("pipeline", F.lit("unknown")).alias("pipeline"), finite(dist).alias("d")).filter("d > 0")
    bins = rows.groupBy("pipeline", F.floor(F.log("d") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    up = Window.partitionBy("pipeline").orderBy("bin")
    every = Window.partitionBy("pipeline")
    gaps = bins.select("pipeline", "most", F.lead("least").over(up).alias("next"), F.sum("n").over(up).alias("below"), F.sum("n").over(every).alias("n"))
    ratio = F.col("next") / F.col("most")
    ok = F.coalesce(ratio >= RATIO, F.lit(False))
    weight = F.log(ratio) * F.least("below", F.col("n") - F.col("below"), F.lit(ENOUGH))
    best = F.max_by(F.struct(F.sqrt(F.col("most") * F.col("next")).alias("near_limit"), F.col("below")), F.when(ok, F.struct(weight, -F.col("most"))))
    return gaps.groupBy("pipeline").agg(F.max("n").alias("n"), best.alias("g")).select("pipeline", "n", F.col("g.below").alias("n_near"), "g.near_limit")


def pair_results(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(lo, hi, near, rel): one row for each compared pair.

    ``rel`` is the mean over its runs of log(distance / limit); a run that is repeated exactly counts
    once.  The pair is near if that mean is below zero.
    """
    rel = F.log(F.greatest(F.col("d"), F.col("near_limit") * 1e-3) / F.col("near_limit"))
    scaled = rows.join(limits.filter("near_limit is not null").select("pipeline", "near_limit"), "pipeline").select("lo", "hi", "run", rel.alias("rel"))
    runs = scaled.groupBy("lo", "hi", "run").agg(F.avg("rel").alias("rel"))
    return runs.groupBy("lo", "hi").agg(F.avg("rel").alias("rel")).select("lo", "hi", (F.col("rel") < 0).alias("near"), "rel")


def _both(pairs: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")), F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")))
    return pairs.select(F.explode(ends).alias("e"), "rel").select("e.x", "e.y", "rel")


def agreement(pairs: DataFrame, stages: Stages) -> DataFrame:
    """(lo, hi, near, distance): supported pairs of trails and their distance, 0 to ``FAR``.

    Candidates are near pairs and pairs with a shared near neighbour.  ``c`` counts the trails both
    are near to, ``f`` those one is near to and the other far from; a far result of the pair itself
    counts as one of ``f``.  Supported: a near pair with c + 1 >= f that shares at least half as many
    trails, less one, as the near pairs of either one do on average; another pair with c > f that
    shares more than half as many as those of both, so that few comparisons between two sets don't
    join them.  Missing comparisons lower that average, too, so they are no votes against a pair.
    """
    near = stages.write(_both(pairs.filter("near")).select("x", "y", F.exp("rel").alias("s")), "near")
    far = pairs.filter("not near").select("lo", "hi")
    a, b = near.select("x", F.col("y").alias("lo"), "s"), near.select("x", F.col("y").alias("hi"), F.col("s").alias("s2"))
    shared = a.join(b, "x").filter("lo < hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("c"), F.sum(F.greatest("s", "s2")).alias("s"))
    direct = pairs.filter("near").select("lo", "hi", F.lit(0).cast("long").alias("c"), F.exp("rel").alias("s"), F.lit(1).alias("direct"))
    cand = shared.withColumn("direct", F.lit(0)).unionByName(direct).groupBy("lo", "hi").agg(F.max("c").alias("c"), F.sum("s").alias("s"), F.max("direct").alias("direct"))
    cand = stages.write(cand, "candidates")
    # third trails: near to one of the two ...
    third = cand.select("lo", "hi", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("hi").alias("o")), F.struct(F.col("hi").alias("x"), F.col("lo").alias("o")))).alias("e")).select("lo", "hi", "e.x", "e.o")
    third = third.join(near.select("x", "y"), "x").filter("y <> o").select("lo", "hi", F.least("o", "y").alias("p"), F.greatest("o", "y").alias("q"))
    # ... and far from the other
    split = third.join(far.select(F.col("lo").alias("p"), F.col("hi").alias("q")), ["p", "q"]).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("f"))
    own = cand.filter("direct = 0").select("lo", "hi").join(far, ["lo", "hi"]).select("lo", "hi", F.lit(1).cast("long").alias("f"))
    against = split.unionByName(own).groupBy("lo", "hi").agg(F.sum("f").alias("f"))
    # shared near neighbours that an end's near pairs have on average: all of them where every pair is compared
    ends = cand.filter("direct = 1").select(F.explode(F.array("lo", "hi")).alias("x"), "c")
    usual = ends.groupBy("x").agg(F.avg("c").alias("usual"))
    judged = cand.join(against, ["lo", "hi"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    for end in ("lo", "hi"):
        judged = judged.join(usual.withColumnsRenamed({"x": end, "usual": f"usual_{end}"}), end)
    judged = judged.filter("(direct = 1 and c + 1 >= f and 2 * c >= least(usual_lo, usual_hi) - 1) or (c > f and 2 * c > greatest(usual_lo, usual_hi))")
    distance = (F.col("s") + FAR * F.col("f")) / (F.col("c") + F.col("f") + F.col("direct"))
    return judged.select("lo", "hi", (F.col("direct") == 1).alias("near"), distance.alias("distance"))


def density_peaks(supported: DataFrame) -> DataFrame:
    """(node, to, density, delta): each trail's nearest supported denser trail and its distance; a peak points to itself.

    Of equal densities the trail with the smaller name is the denser one, so the order is total; of
    equally near ones the densest is taken, then the smallest name.  ``delta`` of a trail without a denser
    supported one is ``FAR``.
    """
    ends = F.array(F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")), F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")))
    both = supported.select(F.explode(ends).alias("e"), "near", "distance").select("e.x", "e.y", "near", "distance")
    density = both.filter("near").groupBy("x").agg(F.count(F.lit(1)).alias("density"))
    links = both.join(density, "x").join(density.select(F.col("x").alias("y"), F.col("density").alias("other")), "y")
    denser = links.filter("other > density or (other = density and y < x)")
    nearest = F.min_by(F.struct("y", "distance"), F.struct("distance", -F.col("other"), F.col("y")))
    best = denser.groupBy("x").agg(nearest.alias("n"))
    return density.join(best, "x", "left").select(F.col("x").alias("node"), F.coalesce("n.y", "x").alias("to"), "density", F.coalesce("n.distance", F.lit(FAR)).alias("delta"))


def follow(pointers: DataFrame, stages: Stages, max_rounds: int = 64) -> DataFrame:
    """(node, peak): the end of each chain of pointers, by doubling; a chain of n links takes log2 n rounds."""
    now = stages.write(pointers.select("node", "to"), "pointers")
    for k in range(max_rounds):
        step = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")
        new = stages.write(step.select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), f"pointers{k}")
        stages.drop(now)
        now = new
        if not now.filter("moved").limit(1).count():
            return now.select("node", F.col("to").alias("peak"))
    raise RuntimeError(f"pointers not followed after {max_rounds} rounds")


def trail_clusters(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trail, cluster, density, delta) for each trail of a cluster of two or more, and the pair results.

    Null, ``unknown`` and empty trails, and distances that are null, NaN, infinite or negative, are
    left out; rows of one trail with itself say nothing.  An empty table gives no rows.  A cluster
    is named by its peak.  A pipeline whose distances form one range only says neither near nor far: it is
    named in a warning, with the number of its distances.
    """
    stages = Stages(pairs.sparkSession, "density")
    rows, limits = compared(pairs), stages.write(near_limits(pairs), "limits")
    for r in limits.filter("near_limit is null").select("pipeline", "n").orderBy("pipeline").limit(20).collect():
        warnings.warn(f"pipeline {r['pipeline']}: its {r['n']} distances form one range, so they tell neither near nor far", stacklevel=2)
    results = stages.write(pair_results(rows, limits), "pairs")
    supported = stages.write(agreement(results, stages), "supported")
    peaks = stages.write(density_peaks(supported), "peaks")
    label = stages.write(follow(peaks, stages).join(peaks.select("node", "density", "delta"), "node"), "labels")
    both = results.join(label.select(F.col("node").alias("lo"), F.col("peak").alias("k1")), "lo").join(label.select(F.col("node").alias("hi"), F.col("peak").alias("k2")), "hi").filter("k1 = k2")
    votes = both.select(F.explode(F.array("lo", "hi")).alias("node"), "near").groupBy("node").agg(F.count_if("near").alias("n"), F.count_if(~F.col("near")).alias("f"))
    kept = label.join(votes.filter("n >= f").select("node"), "node", "left_semi")
    sizes = kept.groupBy("peak").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stages.write(kept.join(sizes, "peak").select(F.col("node").alias("trail"), F.col("peak").alias("cluster"), "density", "delta"), "members")
    return members, results


def cluster_pairs(members: DataFrame) -> DataFrame:
    """(trail_lo, trail_hi): the pairs of trails of one cluster, compared or not."""
    a = members.select("cluster", F.col("trail").alias("trail_lo"))
    return a.join(members.select("cluster", F.col("trail").alias("trail_hi")), "cluster").filter("trail_lo < trail_hi").select("trail_lo", "trail_hi")


def describe_clusters(members: DataFrame, results: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, n_trails, n_compared, near_share, rank_no, trail, centrality): each cluster and its most typical trails.

    A trail's centrality is its mean log distance to the others of its cluster, in units of the
    limit: the smaller the more typical; ties go to the smaller name.
    """
    m = members.select("trail", "cluster")
    both = results.join(m.select(F.col("trail").alias("lo"), F.col("cluster").alias("k1")), "lo").join(m.select(F.col("trail").alias("hi"), F.col("cluster").alias("k2")), "hi").filter("k1 = k2")
    ends = both.select(F.explode(F.array("lo", "hi")).alias("trail"), "rel", "near")
    central = ends.groupBy("trail").agg(F.avg("rel").alias("centrality"), F.count(F.lit(1)).alias("c"), F.count_if("near").alias("n"))
    rows = m.join(central, "trail")
    whole = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_trails"), (F.sum("c") / 2).cast("long").alias("n_compared"), (F.sum("n") / F.sum("c")).alias("near_share"))
    first = Window.partitionBy("cluster").orderBy("centrality", "trail")
    top = rows.withColumn("rank_no", F.row_number().over(first)).filter(F.col("rank_no") <= typical)
    return whole.join(top.select("cluster", "rank_no", "trail", "centrality"), "cluster")
