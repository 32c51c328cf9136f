"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.sqltext import base_sql, label_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB counterpart."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- problem 4
_LINKS = f"""
  links AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (
    SELECT {base_sql('trail_a_id')} AS a, {base_sql('trail_b_id')} AS b FROM master_pairs
    WHERE lower(regexp_replace(same_individual, '^\\s+|\\s+$', '', 'g')) = 'true') WHERE a <> b),
  two AS (SELECT u AS x, v AS y FROM links UNION ALL SELECT v, u FROM links),
  reach AS (SELECT x, x AS y FROM two UNION SELECT r.x, t.y FROM reach r JOIN two t ON r.y = t.x),
  groups AS (SELECT x AS trail_id, min(y) AS group_id FROM reach GROUP BY x)"""


@query("p4_found", f"WITH RECURSIVE {_LINKS} SELECT trail_id, group_id FROM groups")
def p4_found(spark, d):
    from .groups import trail_groups

    return trail_groups(table(spark, d, "master_pairs"))


@query("p4_group_sizes", f"WITH RECURSIVE {_LINKS} SELECT n_trails, count(*) AS n_groups FROM (SELECT count(*) AS n_trails FROM groups GROUP BY group_id) GROUP BY n_trails")
def p4_group_sizes(spark, d):
    from .groups import group_sizes, trail_groups

    return group_sizes(trail_groups(table(spark, d, "master_pairs")))


# ---------------------------------------------------------------- problem 6
@query(
    "p6_found",
    f"""SELECT species, individual_id FROM (
      SELECT {label_sql('species')} AS species, {label_sql('individual_id')} AS individual_id, fold FROM footprints WHERE {label_sql('__split__')} = 'train')
    WHERE species NOT IN ('unknown', '') AND individual_id NOT IN ('unknown', '')
    GROUP BY species, individual_id HAVING count(DISTINCT fold) > 1""",
)
def p6_found(spark, d):
    from .family_split import broken_animals

    return broken_animals(table(spark, d, "footprints"))


@query("p6_assign")
def p6_assign(spark, d):
    from .family_split import animal_kinds, assign_splits

    return assign_splits(table(spark, d, "footprints"), table(spark, d, "split_targets"), animal_kinds())


@query("p6_shares", "SELECT split_name, round(target_share, 6) AS target_share, true AS met, 0 AS n_broken FROM split_targets")
def p6_shares(spark, d):
    """Each split, whether its share is met to within a hundredth and one average family, and its broken families."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .family_split import animal_kinds, assign_splits, split_report

    targets = table(spark, d, "split_targets")
    out = split_report(assign_splits(table(spark, d, "footprints"), targets, animal_kinds()), targets)
    family = F.lit(1.0) / F.sum("n_families").over(Window.partitionBy(F.lit(0)))  # a row a split
    return out.select("split_name", F.round("target_share", 6).alias("target_share"), (F.abs(F.col("share") - F.col("target_share")) <= 0.01 + family).alias("met"), F.col("n_broken").cast("int").alias("n_broken"))


# ---------------------------------------------------------------- problem 1
@query("p1_found")
def p1_found(spark, d):
    from .density import cluster_pairs, trail_clusters

    return cluster_pairs(trail_clusters(table(spark, d, "master_pairs"))[0])


@query("p1_clusters")
def p1_clusters(spark, d):
    from .density import describe_clusters, trail_clusters

    return describe_clusters(*trail_clusters(table(spark, d, "master_pairs")))


# ---------------------------------------------------------------- problem 2
@query("p2_found")
def p2_found(spark, d):
    from pyspark.sql import functions as F

    from .fingerprint import cross_split_pairs

    pairs = cross_split_pairs(table(spark, d, "footprints"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_lo"), F.greatest("train_id", "eval_id").alias("id_hi")).filter("id_lo < id_hi")


@query("p2_counts")
def p2_counts(spark, d):
    from .fingerprint import cross_split_pairs, overlap_counts

    return overlap_counts(cross_split_pairs(table(spark, d, "footprints")))


# ---------------------------------------------------------------- problem 5
_TOP5 = f"""
  ok AS (SELECT {label_sql('species')} AS species, {label_sql('model_key')} AS model_key, pipeline_id, mean_cv_balanced_accuracy AS score, record_id
         FROM best_models WHERE mean_cv_balanced_accuracy BETWEEN 0 AND 1 AND NOT isnan(mean_cv_balanced_accuracy)),
  one AS (SELECT species, model_key, score, min(record_id) AS record_id FROM ok GROUP BY species, model_key, pipeline_id, score),
  best AS (SELECT *, row_number() OVER (PARTITION BY species, model_key ORDER BY score DESC, record_id) AS rank_no FROM one)"""


@query("p5_found", f"WITH {_TOP5} SELECT record_id, rank_no FROM best WHERE rank_no <= 5")
def p5_found(spark, d):
    from .topn import best_models

    return best_models(table(spark, d, "best_models"))[0].select("record_id", "rank_no")


@query("p5_top", f"WITH {_TOP5} SELECT species, model_key, rank_no, record_id, score FROM best WHERE rank_no <= 5")
def p5_top(spark, d):
    from .topn import best_models

    return best_models(table(spark, d, "best_models"))[0].select("species", "model_key", "rank_no", "record_id", "score")


@query("p5_skipped", "SELECT true AS some_skipped")
def p5_skipped(spark, d):
    """Whether the files' statistics spared reading any of them."""
    from .topn import best_models

    seen = best_models(table(spark, d, "best_models"))[1]
    return spark.createDataFrame([(seen["read"] < seen["files"],)], "some_skipped boolean")


# ---------------------------------------------------------------- problem 7
@query("p7_found")
def p7_found(spark, d):
    from .leakage import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query("p7_report")
def p7_report(spark, d):
    from .leakage import leak_report, leaked_items

    items = table(spark, d, "eval_items")
    return leak_report(leaked_items(table(spark, d, "documents"), items), items)


# ---------------------------------------------------------------- problem 9
@query("p9_found")
def p9_found(spark, d):
    from .spam import spam_pages

    return spam_pages(table(spark, d, "documents"))


@query("p9_kinds")
def p9_kinds(spark, d):
    from pyspark.sql import functions as F

    from .spam import SHARE, judged_pages

    pages = judged_pages(table(spark, d, "documents")).filter(F.col("spam_share") > SHARE)
    return pages.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("spam_share"), 6).alias("mean_share"))


# ---------------------------------------------------------------- problem 8
@query("p8_allocation")
def p8_allocation(spark, d):
    from .mixing import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query("p8_report")
def p8_report(spark, d):
    from .mixing import mixture

    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query("p8_shares", f"SELECT {label_sql('source')} AS source, round(target_share, 6) AS target_share, true AS met, true AS within_repeats FROM mix_targets")
def p8_shares(spark, d):
    """Each source, whether its share is met to within a hundredth and one text, and max_repeats kept."""
    from pyspark.sql import functions as F

    from .mixing import mixture

    allocation, report = mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    text = allocation.agg((F.max("tokens") / F.sum(F.col("tokens") * F.col("repeats"))).alias("text"))  # one row
    met = F.abs(F.col("share") - F.col("target_share")) <= 0.01 + F.col("text")
    return report.join(F.broadcast(text)).select("source", F.round("target_share", 6).alias("target_share"), met.alias("met"), (F.col("most_used") <= F.col("max_repeats")).alias("within_repeats"))
