"""Problem 5: the N best records of every group, by statistics-guided skipping.

``cluster_by_group`` lays the records out once, as they come: files hold ranges of (group, falling score),
so a hot group is spread over many files and a small one lies in one.  ``unit_statistics`` takes the
groups' range, the highest score and the number of records of each file from the Parquet footers, in
tasks; no record is read for it.  ``top_records`` opens the files that hold more than one group and, of
every group that has files to itself, the one of the highest maximum.  What has been read gives each
group's current N-th score; files strictly below it are skipped for good, and the others are opened in
falling order of their maximum, twice as many of a group at each turn.  Files with an equal maximum are
read, so ties are exact.

Records that are entered again needn't be taken out before they are laid out: the N best are taken of
distinct records, turn by turn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_form
from ..functions.numbers import finite
from ..sources.stages import Stages

#: Records of a file, at most, and files of the layout, at least: a group of more than two in ``UNITS`` of the
#: records has files to itself.
UNIT_ROWS, UNITS = 200_000, 64


def cluster_by_group(records: DataFrame, group: Sequence[str], stages: Stages, unit_rows: int = UNIT_ROWS, units: int = UNITS) -> DataFrame:
    """``records`` (group columns, score, ...) as a table of files clustered by group and falling score."""
    at = stages.path("clustered")
    keys = [*group, F.col("score").desc()]
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), units)
    records.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", unit_rows).parquet(at)
    return records.sparkSession.read.schema(records.schema).parquet(at)


def _footers(group: Sequence[str], score: str):
    """Batches of (file) to (file, n, top, own): own is the file's only group, as an array; null if it holds several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for pdf in batches:
            out = []
            for file in pdf["file"]:
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
                at = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
                parts = [meta.row_group(k) for k in range(meta.num_row_groups)]
                stats = lambda c: [p.column(at[c]).statistics for p in parts]
                ends = [stats(c) for c in group]
                # a range is known only where every row group has one and no null
                known = all(s is not None and s.has_min_max and not s.null_count for c in ends for s in c)
                own = [c[0].min for c in ends] if known and parts and all(s.min == s.max == c[0].min for c in ends for s in c) else None
                tops = [s.max if s is not None and s.has_min_max else None for s in stats(score)]
                out.append((file, meta.num_rows, max(tops) if tops and None not in tops else None, own))
            yield pd.DataFrame(out, columns=["file", "n", "top", "own"])

    return run


def unit_statistics(clustered: DataFrame, group: Sequence[str], stages: Stages, score: str = "score") -> DataFrame:
    """(file, n, top, own) for each file: records, highest score (null if unknown) and its only group (null if several)."""
    spark = clustered.sparkSession
    files = clustered.inputFiles()  # the list that the driver plans a scan from
    if not files:
        return spark.createDataFrame([], "file string, n long, top double, own array<string>")
    parts = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(parts)
    return stages.write(names.mapInPandas(_footers(group, score), "file string, n long, top double, own array<string>"), "statistics")


def _best(rows: DataFrame, group: Sequence[str], n: int, same: Sequence[str]) -> DataFrame:
    # Spark limits each group in each task before it shuffles, as the rank is bounded
    one = rows.groupBy(*group, *same, "score").agg(F.min("record_id").alias("record_id")) if same else rows
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "record_id")
    return one.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= n)


def top_records(clustered: DataFrame, statistics: DataFrame, group: Sequence[str], n: int, stages: Stages, same: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """The ``n`` best records of each group with ``rank_no``, and how many files there are and were read.

    Records of equal group, score and ``same`` columns are one, with the smallest record_id.
    """
    spark = clustered.sparkSession
    own = F.array(*[F.col(c) for c in group])
    down = Window.partitionBy("own").orderBy(F.col("top").desc_nulls_first(), "file")
    left = stages.write(statistics.withColumn("turn", F.when(F.col("own").isNull(), 1).otherwise(F.row_number().over(down))), "units")
    best, read, upto = None, 0, 1
    while True:
        # one path for each file that is read: the driver lists them in any case to plan the scan
        now = left if best is None else left.join(best.filter(F.col("rank_no") == n).select(own.alias("own"), F.col("score").alias("nth")), "own", "left").filter("own is not null and (nth is null or top is null or top >= nth)")
        paths = [r[0] for r in now.filter(f"turn between {upto // 2 + 1} and {upto}").select("file").collect()]
        if paths:
            rows = spark.read.schema(clustered.schema).parquet(*paths)
            rows = rows if best is None else best.drop("rank_no").unionByName(rows)
            best = stages.write(_best(rows, group, n, same), "best")
            read += len(paths)
        if best is None or now.filter(f"turn > {upto}").limit(1).count() == 0:
            break
        upto *= 2
    if best is None:
        best = _best(clustered.limit(0), group, n, same)
    return best, {"files": statistics.count(), "read": read}


def scored_models(models: DataFrame, score: str = "mean_cv_balanced_accuracy") -> DataFrame:
    """(species, model_key, pipeline_id, score, record_id) of the records that rank.

    Scores that are null, NaN, infinite or outside 0..1 don't rank.  Missing species and model keys read
    ``unknown`` and form groups of their own.
    """
    s = finite(score)
    rows = models.select(label_form("species").alias("species"), label_form("model_key").alias("model_key"), "pipeline_id", s.alias("score"), "record_id").filter("score between 0 and 1 and record_id is not null")
    return rows.select("species", "model_key", "pipeline_id", (F.col("score") + 0.0).alias("score"), "record_id")


def best_models(models: DataFrame, n: int = 5, unit_rows: int = UNIT_ROWS, units: int = UNITS) -> tuple[DataFrame, dict[str, int]]:
    """Top ``n`` of each (species, model_key): equal scores by smaller record_id; all, where there are fewer.

    Records of equal group, pipeline and score (null pipelines being equal) are one, with the smallest
    record_id.
    """
    stages, group = Stages(models.sparkSession, "topn"), ["species", "model_key"]
    clustered = cluster_by_group(scored_models(models), group, stages, unit_rows, units)
    return top_records(clustered, unit_statistics(clustered, group, stages), group, n, stages, ["pipeline_id"])
