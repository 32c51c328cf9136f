"""Problem 6: splits that keep related records together.

Entities that occur in one record are related.  The graph has entities as nodes, not records, and
one edge for each distinct combination, so an entity that holds a third of all rows is one node.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import known, label_form
from ..sources.stages import Stages
from .components import star_components, undirected

#: Hash buckets of the running sums, and steps of the line on which splits begin and end.
BUCKETS, STEPS = 4096, 4096


def entity(kind: str, *labels: Column) -> Column:
    """Name of an entity: its kind and its labels; null if a label is null."""
    return F.when(reduce(lambda x, y: x & y, [v.isNotNull() for v in labels]), F.concat_ws("\x1f", F.lit(kind), *labels))


def animal(species: str = "species", individual: str = "individual_id") -> Column:
    """The animal of a footprint row in label form; null where species or individual is unknown."""
    return entity("animal", known(label_form(species)), known(label_form(individual)))


def animal_kinds(species: str = "species", individual: str = "individual_id") -> dict[str, Column]:
    """The entities of a footprint row: its animal, and the names as they are written there.

    All spellings of an animal are linked to it, and through it to each other; trails link nothing.
    """
    known_animal = animal(species, individual)
    return {"animal": known_animal, "written": F.when(known_animal.isNotNull(), entity("written", F.col(species), F.col(individual)))}


def entity_families(df: DataFrame, entities: dict[str, Column], stages: Stages) -> DataFrame:
    """(entity, family) for each entity of ``df``: family is the smallest entity linked to it.

    Distinct combinations are formed before any shuffle of edges; alternating large-star and
    small-star gives the components.  A record's null entities link nothing.
    """
    names = list(entities)
    combos = df.select(*[c.alias(n) for n, c in entities.items()]).distinct()
    combos = stages.write(combos.select(F.array_compact(F.array(*names)).alias("all")).filter("size(all) > 0"), "combos")
    nodes = combos.select(F.explode("all").alias("entity")).distinct()
    edges = stages.write(undirected(combos.select(F.col("all")[0].alias("a"), F.explode("all").alias("b")), "a", "b"), "edges")
    roots = star_components(edges, stages).withColumnsRenamed({"node": "entity", "root": "family"})
    return nodes.join(roots, "entity", "left").select("entity", F.coalesce("family", "entity").alias("family"))


def with_family(df: DataFrame, entities: dict[str, Column], families: DataFrame, row_key: Column) -> DataFrame:
    """``df`` with ``_family``: the family of the record's first entity; a record without any is its own family."""
    first = F.coalesce(*entities.values())
    keyed = df.withColumn("_entity", first)
    hit = keyed.filter("_entity is not null").join(families.select(F.col("entity").alias("_entity"), F.col("family").alias("_family")), "_entity").drop("_entity")
    lone = keyed.filter("_entity is null").drop("_entity").withColumn("_family", F.concat(F.lit("row\x1f"), row_key.cast("string")))
    return hit.unionByName(lone)


def split_ranges(weights: np.ndarray, shares: dict[str, float]) -> list[tuple[str, int, int]]:
    """(split, first, end): the steps of a circle of ``STEPS`` that each split has; one that runs past the end has two rows.

    ``weights`` has the rows whose family lies in each step.  All splits keep their length on the circle;
    of all places where the first may begin, the one is taken at which the largest miss of a share is the
    smallest (of equal ones the first), so that no border falls into a large family that could be spared.
    """
    names = [s for s in sorted(shares) if shares[s] > 0]
    n, total = len(weights), max(weights.sum(), 1)
    ends = np.rint(np.cumsum([shares[s] for s in names]) / sum(shares[s] for s in names) * n).astype(int)
    run = np.concatenate([[0], np.cumsum(np.concatenate([weights, weights]))])
    starts = np.arange(n)
    miss, lo = np.zeros(n), 0
    for s, hi in zip(names, ends):
        got = (run[starts + hi] - run[starts + lo]) / total
        miss = np.maximum(miss, np.abs(got - shares[s] / sum(shares[x] for x in names)))
        lo = hi
    start, out, lo = int(miss.argmin()), [], 0
    for s, hi in zip(names, ends):
        a, b = start + lo, start + hi
        out += [(s, x - w, y - w) for w in (0, n) if (x := max(a, w)) < (y := min(b, w + n))]
        lo = hi
    return out


def assign_splits(df: DataFrame, targets: DataFrame, entities: dict[str, Column], row_key: str = "id", seed: int = 99) -> DataFrame:
    """(row key, family, split_name): every record with its split, a family never broken.

    The hash of a family is its place on a circle on which each family is as long as it has rows; a family
    belongs to the split that holds its middle.  The splits follow each other in code point order of name,
    each as long as its target share, and begin where the shares reached miss the targets least
    (``split_ranges``).  So one rule holds for every family, and shares are missed by about half a family
    that lies on a border.  Running sums go over 4096 hash buckets and then within a bucket, never over all
    families in one task.  Targets that are null or not positive get nothing; with no targets split_name is
    null.  Rows with equal keys that are repeated stay repeated.
    """
    spark, stages = df.sparkSession, Stages(df.sparkSession, "splits")
    families = entity_families(df, entities, stages)
    rows = stages.write(with_family(df, entities, families, F.coalesce(F.col(row_key).cast("string"), F.lit(""))).select(F.col(row_key).alias("_key"), "_family"), "rows")
    at = F.xxhash64(F.lit(seed), F.col("_family"))
    sizes = stages.write(rows.groupBy("_family").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": at, "bucket": F.pmod(at, F.lit(BUCKETS))}), "families")
    # at most 4096 rows
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("m"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select("bucket", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"), F.sum("m").over(everything).alias("total"))
    within = Window.partitionBy("bucket").orderBy("h", "_family").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(buckets, "bucket")
    middle = (F.col("before") + F.col("inner") + F.col("n") / 2) / F.col("total")
    placed = stages.write(placed.select("_family", "n", F.least(F.floor(middle * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")), "placed")
    good = targets.filter("target_share > 0 and split_name is not null").groupBy("split_name").agg(F.sum("target_share").alias("share"))
    shares = {r["split_name"]: r["share"] for r in good.collect()}  # a row a split
    split = F.lit(None).cast("string")
    if shares:
        weights = np.zeros(STEPS)
        for r in placed.groupBy("step").agg(F.sum("n").alias("n")).collect():  # a row a step
            weights[r["step"]] = r["n"]
        for s, lo, hi in split_ranges(weights, shares):
            split = F.when((F.col("step") >= lo) & (F.col("step") < hi), s).otherwise(split)
    return rows.join(placed.select("_family", split.alias("split_name")), "_family").select(F.col("_key").alias(row_key), F.col("_family").alias("family"), "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, target_share, share, n_rows, n_families, n_broken): the shares reached, and families that lie in several splits."""
    goals = targets.filter("target_share > 0 and split_name is not null").groupBy("split_name").agg(F.sum("target_share").alias("share"))
    goals = goals.select("split_name", (F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(0)))).alias("target_share"))  # a row a split
    # a family's rows in one split are one row here
    part = assigned.groupBy("family", "split_name").agg(F.count(F.lit(1)).alias("n"))
    several = part.groupBy("family").agg(F.count(F.lit(1)).alias("splits")).filter("splits > 1")
    part = part.join(several, "family", "left")
    by = part.groupBy("split_name").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_families"), F.count("splits").alias("n_broken"))
    by = by.withColumn("n_all", F.sum("n_rows").over(Window.partitionBy(F.lit(0))))  # a row a split
    out = goals.join(by, "split_name", "left").fillna(0, ["n_rows", "n_families", "n_broken"])
    return out.select("split_name", "target_share", F.coalesce(F.try_divide("n_rows", "n_all"), F.lit(0.0)).alias("share"), "n_rows", "n_families", "n_broken")


def broken_families(df: DataFrame, entities: dict[str, Column], fold: str, names: Sequence[str], stages: Stages) -> DataFrame:
    """The ``names`` of the first kind's entities of each family whose rows carry more than one fold; null folds aside.

    Minimum and maximum tell whether there is more than one fold, so no set is gathered.
    """
    families = entity_families(df, entities, stages)
    rows = df.withColumn("_entity", F.coalesce(*entities.values())).filter(F.col("_entity").isNotNull()).filter(F.col(fold).isNotNull())
    # partial sums by entity first: a hot entity is one row when it meets its family
    folds = rows.groupBy("_entity").agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    by = folds.join(families.withColumnRenamed("entity", "_entity"), "_entity").groupBy("family").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bad = by.filter("lo < hi").select("family")
    parts = F.split("entity", "\x1f")
    kind = next(iter(entities))
    return families.filter(parts[0] == kind).join(bad, "family").select(*[parts[k + 1].alias(n) for k, n in enumerate(names)])


def broken_animals(footprints: DataFrame) -> DataFrame:
    """(species, individual_id): animals whose rows of split train carry more than one fold."""
    stages = Stages(footprints.sparkSession, "broken")
    train = footprints.filter(label_form("__split__") == "train").select("species", "individual_id", "fold")
    return broken_families(train, animal_kinds(), "fold", ["species", "individual_id"], stages)
