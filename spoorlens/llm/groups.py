"""Problem 4: one group identifier for all records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import base_trail, flag_true
from ..sources.stages import Stages
from .components import contracted_groups


def positive_links(pairs: DataFrame, a: str = "trail_a_id", b: str = "trail_b_id", flag: str = "same_individual") -> DataFrame:
    """(a, b): the base trails of each pair row whose flag reads ``true``; rows lacking a trail are dropped."""
    return pairs.filter(flag_true(flag)).select(base_trail(a).alias("a"), base_trail(b).alias("b")).filter("a is not null and b is not null and a <> b")


def trail_groups(pairs: DataFrame, a: str = "trail_a_id", b: str = "trail_b_id", flag: str = "same_individual") -> DataFrame:
    """(trail_id, group_id): each trail of a group of two or more trails, and the group's smallest trail.

    A row that says otherwise, or says nothing, undoes no link.  Two spellings or two sub-trails of
    one trail are one node, so a row of both links nothing.  An empty table gives no rows.
    """
    stages = Stages(pairs.sparkSession, "groups")
    return contracted_groups(positive_links(pairs, a, b, flag), "a", "b", stages).select(F.col("node").alias("trail_id"), "group_id")


def group_sizes(groups: DataFrame) -> DataFrame:
    """(n_trails, n_groups): how many groups have each size."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_trails"))
    return sizes.groupBy("n_trails").agg(F.count(F.lit(1)).alias("n_groups"))
