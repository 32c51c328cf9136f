"""Ingest cleaning: names, roles, types, labels, and the clean footprint table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import base_trail, label_form
from ..functions.numbers import decimal_comma, finite, measurement
from ..functions.texts import standard_sex
from ..sources.stages import Stages

#: Name prefixes of feature columns, and the roles of the other columns.
FEATURE_PREFIXES = ("v", "area", "dist", "ang", "t")
TARGETS = ("species", "individual_id", "trail", "sex")
META = ("id", "date", "location", "dataorigin", "substrate", "fold")
SYNONYMS = {"animal": "individual_id", "individual": "individual_id"}
MEASURES = ("v1", "v2", "v3", "v4", "area1", "area2", "dist1", "dist2", "dist3", "dist4", "ang1", "t1")


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of a table's columns."""

    meta: tuple[str, ...] = META
    targets: tuple[str, ...] = TARGETS
    features: tuple[str, ...] = field(default=())


def normal_name(name: str) -> str:
    """Column name trimmed, in small letters, runs of other characters one underscore."""
    return re.sub(r"\W+", "_", name.strip().lower())


def with_normal_names(df: DataFrame, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """Normal column names, synonyms renamed; a name that comes up again gets a number."""
    out, seen = [], {}
    for c in df.columns:
        n = normal_name(c)
        n = synonyms.get(n, n)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)


def present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    low = {c.lower(): c for c in df.columns}
    return next((low[c.lower()] for c in candidates if c.lower() in low), None)


def with_case(df: DataFrame, name: str) -> DataFrame:
    """A column of that name in any case, renamed to it."""
    old = present(df, [name])
    return df.withColumnRenamed(old, name) if old and old != name else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def prefixed(df: DataFrame, *prefixes: str) -> list[str]:
    """Columns whose name begins with one of the prefixes."""
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def feature_columns(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> list[str]:
    """Numeric columns with a feature prefix; only where no column has one, the numeric ones from the fifth on."""
    numeric = [c for c in numeric_columns(df) if c.lower() not in {*spec.meta, *spec.targets}]
    if any(c.lower().startswith(FEATURE_PREFIXES) for c in df.columns):
        return [c for c in numeric if c.lower().startswith(FEATURE_PREFIXES)]
    return [c for c in df.columns[5:] if c in numeric]


def majority_numeric(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.8) -> DataFrame:
    """Text columns to doubles where at least ``share`` of all rows are numbers (a comma counts as point).

    One pass counts for all columns; a table without rows stays as it is.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not columns:
        return df
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(decimal_comma(c)).alias(c) for c in columns]).first()
    to = [c for c in columns if counts[c] > 0 and counts[c] >= share * counts["n"]]
    return df.withColumns({c: decimal_comma(c) for c in to})


def features_to_double(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Every column that is no target and no metadata to double, a comma counting as point, other texts null."""
    fixed = {*spec.meta, *spec.targets}
    return df.withColumns({c: decimal_comma(c) for c in df.columns if c.lower() not in fixed})


def mapped(c: Column, mapping: dict[str, str]) -> Column:
    """The mapped value, or the value itself."""
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def with_clean_labels(df: DataFrame, columns: Sequence[str], maps: dict[str, dict[str, str]] | None = None, keep_null: Sequence[str] = ()) -> DataFrame:
    """Label columns in label form, then mapped; missing ones read ``unknown`` unless they may stay null."""
    maps = maps or {}
    return df.withColumns({c: mapped(label_form(c, None if c in keep_null else "unknown"), maps.get(c, {})) for c in columns})


def known_trails(df: DataFrame, column: str = "trail") -> DataFrame:
    """Rows whose trail is neither null nor ``unknown`` in any case."""
    return df.filter(F.col(column).isNotNull() & (F.lower(F.trim(column)) != "unknown"))


def with_group_mean(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the mean of ``value`` over the rows of equal keys, null keys being equal.

    The means, partial before their shuffle, are joined back, so no key's rows meet in one task.
    """
    key = F.xxhash64(*keys)
    text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    means = df.groupBy(key.alias("_h"), text.alias("_g")).agg(F.avg(value).alias(name))
    return df.withColumns({"_h": key, "_g": text}).join(means, ["_h", "_g"]).drop("_h", "_g")


def running_id(df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int = 0) -> DataFrame:
    """Contiguous numbers in the given order, which should have no ties.

    Rows are numbered within ranges of the order and the ranges' offsets added, so no task sorts all.
    The ranges are written before they are counted, as their bounds come from a sample.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{k}": (F.col(c) if isinstance(c, str) else c) for k, c in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*keys))).drop(*keys)
    ranged = Stages(spark, "ranges").write(ranged, "rows")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + (start - 1)).drop("_part", "_row", "_before")


def with_codes(df: DataFrame, column: str, name: str, first_seen: str | None = None) -> DataFrame:
    """``df`` with ``name``: the number of its label from 0, in order of the labels or of where each is first seen.

    Labels, not rows, are numbered; a null label has the code -1.
    """
    by = df.filter(F.col(column).isNotNull()).groupBy(column).agg(*([F.min(first_seen).alias("_p")] if first_seen else [F.count(F.lit(1)).alias("_p")]))
    codes = running_id(by, ["_p", column] if first_seen else [column], name).select(column, name)
    return df.join(codes, column, "left").fillna(-1, [name])


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_<value>`` for each value: 1 where the column has it, else 0, null included."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def base_frame(df: DataFrame, features: Sequence[str], key: str = "id") -> DataFrame:
    """Key as text and features as numbers (a comma counting as point, other texts null), other columns as they are; an error for a null or repeated key."""
    out = df.withColumns({key: F.col(key).cast("string")} | {c: decimal_comma(c) for c in features})
    bad = out.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][key]!r} is null or repeated")
    return out


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], rank: str = "_k", size: str = "_n") -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of equal ``by``, and how many these are; ``by`` isn't null.

    The places come from one running number over all, so a key that holds a third of the rows is no one
    task's work.
    """
    d = running_id(df, [*by, *order], "_all", 1)
    first = d.groupBy(*by).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias(size))
    joined = d.join(first, list(by)) if by else d.crossJoin(F.broadcast(first))  # one row
    return joined.withColumn(rank, F.col("_all") - F.col("_first") + 1).drop("_all", "_first")


def report_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, n_columns, n_null, n_inf): size of a table and its NaN or null and infinite numbers."""
    null = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns]
    inf = [F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in columns]
    zero = F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), sum(null, zero).alias("n_null"), sum(inf, zero).alias("n_inf"))


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value): one row for each feature of each row, null values included."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(keys), list(features), "feature", "value")


def footprint_table(df: DataFrame) -> DataFrame:
    """The clean footprint table: labels in label form, sex as f / m / unknown, missing measurements null."""
    sex = standard_sex("sex")
    return df.select(
        "id", label_form("species").alias("species"), label_form("individual_id").alias("individual_id"), label_form("trail").alias("trail"),
        F.when(sex == "Female", "f").when(sex == "Male", "m").otherwise("unknown").alias("sex"),
        label_form("dataorigin").alias("dataorigin"), label_form("substrate").alias("substrate"), "fold", label_form("__split__").alias("split"),
        *[measurement(c).alias(c) for c in MEASURES],
    )




DISTANCES = ("euclidean", "manhattan", "cosine", "chebyshev", "canberra", "braycurtis")


def pair_table(df: DataFrame) -> DataFrame:
    """Clean pair rows: base trails a and b, ``same`` 1 / 0 / null, distances that could be had, else null."""
    flag = label_form("same_individual")
    d = lambda m: F.when(finite(f"dist_{m}") >= 0, finite(f"dist_{m}")).alias(m)
    return df.select(
        "comparison_id", base_trail("trail_a_id").alias("a"), base_trail("trail_b_id").alias("b"), label_form("trail_a_id").alias("trail_a_id"), label_form("trail_b_id").alias("trail_b_id"),
        "pipeline", "origin", "tag", "fold", "min_observations", "max_observations", F.when(flag == "true", 1).when(flag == "false", 0).alias("same"), *[d(m) for m in DISTANCES],
    )


def display_labels(df: DataFrame, individual: str = "individual_id", trail: str = "trail", position: str = "id") -> DataFrame:
    """(individual, trail, display_individual, display_trail): anonymous labels numbered in order of first position.

    Individuals are ``Ind_1``..; their trails ``Ind_1_trail_orig_1``..; null names have no label.
    """
    ind = df.filter(F.col(individual).isNotNull()).groupBy(individual).agg(F.min(position).alias("_p"))
    ind = running_id(ind, ["_p", individual], "_i", 1).select(individual, F.concat(F.lit("Ind_"), "_i").alias("display_individual"))
    tr = df.filter(F.col(individual).isNotNull() & F.col(trail).isNotNull()).groupBy(individual, trail).agg(F.min(position).alias("_p"))
    n = F.row_number().over(Window.partitionBy(individual).orderBy("_p", trail))
    return tr.withColumn("_j", n).join(ind, individual).select(individual, trail, "display_individual", F.concat("display_individual", F.lit("_trail_orig_"), "_j").alias("display_trail"))
