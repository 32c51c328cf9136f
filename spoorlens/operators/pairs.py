"""Trails, pairs of trails, and the distances within and between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import METRICS, all_distances, distance
from ..functions.labels import known
from .cleaning import running_id


def trail_table(df: DataFrame, trail: str = "trail", individual: str = "individual_id", sex: str = "sex", fold: str = "fold", substrate: str | None = None, key: str = "id", position: str = "id") -> DataFrame:
    """One row for each known trail: place, base trail, samples, and the first known attribute of its rows.

    ``ord`` is the trail's first position, which gives pairs their direction; the substrate is the
    commonest one, the smaller of equally common ones.
    """
    rows = df.filter(known(F.col(trail)).isNotNull())
    pos = F.col(position)
    first = lambda c: F.min_by(known(F.col(c)) if c != fold else F.col(c), F.when((known(F.col(c)) if c != fold else F.col(c)).isNotNull(), pos))
    aggs = [F.min(pos).alias("ord"), F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("samples"), first(individual).alias("ind"), first(sex).alias("sex"), first(fold).alias("fold")]
    if substrate:
        aggs.append(F.expr(f"mode() WITHIN GROUP (ORDER BY {substrate})").alias("substrate"))
    return rows.groupBy(F.col(trail).alias("trail_id")).agg(*aggs).withColumn("base", F.substring_index("trail_id", "_sub", 1))


def trail_pairs(trails: DataFrame, within: Sequence[str] = (), samples: bool = False, blocks: int = 16) -> DataFrame:
    """All pairs of trails with different base trails, the one with the smaller ``ord`` first.

    ``within`` names columns that both trails share (data set, fold): then the join is on them.  Each trail
    also lies in one of ``blocks`` blocks by its hash, and pairs of blocks are joined, so that the pairs of
    one data set, or of all trails, are spread over blocks squared parts.  Unknown individuals or sexes make
    ``same_individual`` or ``same_sex`` null; ``fold`` is the larger of the two, and a pair's folds may be
    null.  A pair has the numbers of its trails' samples, n_a and n_b, and their ids only if ``samples``.
    """
    block = F.pmod(F.xxhash64("trail_id"), F.lit(blocks))
    t = trails.withColumn("n", F.size("samples"))
    t = (t if samples else t.drop("samples")).withColumn("_own", block)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    a, b = (t.select("*", every).select(*[F.col(c).alias(f"{c}_{s}") for c in [*t.columns, "_other"]]) for s in "ab")
    on = [F.col("_own_a") == F.col("_other_b"), F.col("_other_a") == F.col("_own_b")] + [F.col(f"{c}_a") == F.col(f"{c}_b") for c in within]
    on += [(F.col("ord_a") < F.col("ord_b")) & (F.col("base_a") != F.col("base_b"))]
    p = a.join(b, on)
    return p.select(
        F.col("trail_id_a").alias("trail_a_id"), F.col("trail_id_b").alias("trail_b_id"), "ind_a", "ind_b", "n_a", "n_b", *[c for c in ("samples_a", "samples_b") if samples],
        (F.col("ind_a") == F.col("ind_b")).alias("same_individual"), (F.col("sex_a") == F.col("sex_b")).alias("same_sex"),
        "fold_a", "fold_b", (F.col("fold_a") == F.col("fold_b")).alias("same_fold"), F.greatest("fold_a", "fold_b").alias("fold"),
        *[F.col(f"{c}_a").alias(c) for c in within if c != "fold"], *[c for c in ("substrate_a", "substrate_b") if c in p.columns],
    )


def vector(df: DataFrame, features: Sequence[str], name: str = "vec") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in features]))


def centroids(points: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, n, centroid): component-wise means of the vectors of each key."""
    long = points.select(*keys, F.posexplode(vec).alias("i", "x"))
    m = long.groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def centroid_distances(pairs: DataFrame, cents: DataFrame, trail: str, a: str = "trail_a_id", b: str = "trail_b_id") -> DataFrame:
    """``pairs`` with the six distances of the two trails' centroids."""
    ca = cents.select(F.col(trail).alias(a), F.col("centroid").alias("_ca"))
    cb = cents.select(F.col(trail).alias(b), F.col("centroid").alias("_cb"))
    return pairs.join(ca, a).join(cb, b).select(*pairs.columns, *all_distances("_ca", "_cb"))


def _stats(prefix: str, metrics: Sequence[str]) -> list[Column]:
    return [x for m in metrics for x in (F.avg(f"d_{m}").alias(f"mean_{m}_{prefix}"), F.percentile(f"d_{m}", F.lit(0.5)).alias(f"median_{m}_{prefix}"))]


def between_stats(pairs: DataFrame, points: DataFrame, trail: str, vec: str = "vec", metrics: Sequence[str] = METRICS, a: str = "trail_a_id", b: str = "trail_b_id") -> DataFrame:
    """(a, b, mean and median of each distance) over all point pairs of two trails."""
    pa = points.select(F.col(trail).alias(a), F.col(vec).alias("_va"))
    pb = points.select(F.col(trail).alias(b), F.col(vec).alias("_vb"))
    met = pairs.select(a, b).join(pa, a).join(pb, b)
    return met.select(a, b, *[distance(m, "_va", "_vb").alias(f"d_{m}") for m in metrics]).groupBy(a, b).agg(*_stats("between", metrics))


def within_stats(points: DataFrame, trail: str, key: str, vec: str = "vec", metrics: Sequence[str] = METRICS) -> DataFrame:
    """(trail, mean and median of each distance) over the pairs of points of one trail; a lone point has no row."""
    a = points.select(F.col(trail), F.col(key).alias("_ka"), F.col(vec).alias("_va"))
    b = points.select(F.col(trail), F.col(key).alias("_kb"), F.col(vec).alias("_vb"))
    met = a.join(b, trail).filter("_ka < _kb")
    return met.select(trail, *[distance(m, "_va", "_vb").alias(f"d_{m}") for m in metrics]).groupBy(trail).agg(*_stats("within", metrics))


def complement_moments(points: DataFrame, pairs: DataFrame, trail: str, features: Sequence[str], a: str = "trail_a_id", b: str = "trail_b_id") -> DataFrame:
    """(a, b, n_rest, mean_<feature>): size and means of all rows outside the two trails of a pair.

    Totals less the trails' own sums, so no pair gathers the rest; pairs whose rest has fewer than two
    rows are left out.
    """
    own = points.groupBy(trail).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in features], *[F.count(c).alias(f"c_{c}") for c in features])
    tot = points.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in features], *[F.count(c).alias(f"c_{c}") for c in features])
    side = lambda k, x: own.select(F.col(trail).alias(k), *[F.col(c).alias(f"{c}_{x}") for c in own.columns if c != trail])
    p = pairs.select(a, b).join(side(a, "a"), a).join(side(b, "b"), b).crossJoin(F.broadcast(tot))  # one row
    rest = lambda c: F.col(c) - F.col(f"{c}_a") - F.col(f"{c}_b")
    return p.select(a, b, rest("n").alias("n_rest"), *[F.try_divide(rest(f"s_{c}"), rest(f"c_{c}")).alias(f"mean_{c}") for c in features]).filter("n_rest >= 2")


def gathered(lists: DataFrame, points: DataFrame, list_key: str, samples: str, key: str, vec: str) -> DataFrame:
    """(list_key, vectors): the vectors of a list of ids in the list's order, repeated ids repeated, unknown ones left out."""
    e = lists.select(list_key, F.posexplode(samples).alias("p", "_id"))
    got = e.join(points.select(F.col(key).cast("string").alias("_id"), F.col(vec).alias("v")), "_id")
    return got.groupBy(list_key).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("vectors"))


def resolved_ids(wanted: DataFrame, base: DataFrame, ref: str, key: str) -> DataFrame:
    """``wanted`` with ``resolved``: the id itself if known, else the id at that position (from 0); an error for neither."""
    ids = running_id(base.select(key), [key], "_pos").select(F.col(key).cast("string").alias("_id"), F.col("_pos").cast("string").alias("_pos"))
    a = wanted.join(ids.select(F.col("_id").alias(ref), F.col("_id").alias("_hit")), ref, "left")
    b = a.join(ids.select(F.col("_pos").alias(ref), F.col("_id").alias("_at")), ref, "left")
    return b.withColumn("resolved", F.coalesce("_hit", "_at", F.raise_error(F.concat(F.lit("no such id or position: "), F.col(ref))))).drop("_hit", "_at")


def merged_predictions(df: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Left join of the ``pred_*`` columns by id; columns of both come from the predictions."""
    cols = [c for c in preds.columns if c.startswith("pred_")]
    return df.drop(*cols).join(preds.select(key, *cols), key, "left")


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Many-to-one left join; an error if a key is repeated on the right."""
    n = right.groupBy(*on).count().filter("count > 1").limit(1).count()
    if n:
        raise ValueError(f"keys {', '.join(on)} aren't unique on the right")
    return left.join(right, list(on), "left")


def nearest_value(wanted: DataFrame, table: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """For each wanted row the table's row of equal keys whose value is nearest; the smaller value of two as near.

    Both are sorted together by value, so each row only looks at the table's last value before it and the
    first after it; of equal values in the table the least row is taken.  A null value has no nearest one.
    """
    keys, cols = list(keys), wanted.columns
    rest = [c for c in table.columns if c not in keys]
    t = table.filter(F.col(value).isNotNull()).select(*keys, F.struct(*rest).alias("_t")).groupBy(*keys, F.col(f"_t.{value}").alias("_v")).agg(F.min("_t").alias("_t"))
    none = F.lit(None).cast(dict(t.dtypes)["_t"])
    kept = F.struct(*[c for c in cols if c not in keys])
    both = wanted.select(*keys, F.col(value).cast("double").alias("_v"), kept.alias("_w"), none.alias("_t")).unionByName(t.select(*keys, F.col("_v").cast("double").alias("_v"), F.lit(None).cast(dict(wanted.select(kept.alias("w")).dtypes)["w"]).alias("_w"), "_t"))
    order = Window.partitionBy(*keys).orderBy("_v")
    before = F.last("_t", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_t", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    d = both.withColumns({"_lo": before, "_hi": after}).filter("_w is not null")
    gap = lambda x: F.abs(F.col(f"{x}.{value}") - F.col("_v"))
    best = F.when(F.col("_v").isNull(), none).when(F.col("_hi").isNull() | (gap("_lo") <= gap("_hi")), F.col("_lo")).otherwise(F.col("_hi"))
    d = d.withColumn("_n", best)
    return d.select(*[c if c in keys else F.col(f"_w.{c}").alias(c) for c in cols], *[F.col(f"_n.{c}").alias(f"nearest_{c}") for c in rest])


def parameter_grid(spark, **options: Sequence) -> DataFrame:
    """One row for each combination of the options; at most a few thousand rows, made on the driver."""
    from itertools import product

    names = list(options)
    return spark.createDataFrame([tuple(c) for c in product(*options.values())], names)
