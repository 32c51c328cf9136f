"""Structured Streaming counterparts; extensions, as the batch engine they mirror has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import base_trail, flag_true


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, total): sessions of events no further apart than the gap; works on batches and streams."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    d = events.withColumn(time, F.col(time).cast("timestamp"))
    d = d.withWatermark(time, late) if events.isStreaming else d
    out = d.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) in windows of fixed width."""
    d = events.withColumn(time, F.col(time).cast("timestamp"))
    d = d.withWatermark(time, late) if events.isStreaming else d
    out = d.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(trail_lo, trail_hi, n_runs, n_same): runs of each pair so far; partial counts of batches add up."""
    a, b = base_trail("trail_a_id"), base_trail("trail_b_id")
    d = pairs.select(F.least(a, b).alias("trail_lo"), F.greatest(a, b).alias("trail_hi"), (a.isNotNull() & b.isNotNull()).alias("ok"), flag_true("same_individual").alias("same")).filter("ok")
    return d.groupBy("trail_lo", "trail_hi").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("same").alias("n_same"))


def append_new(source: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Start a stream that appends rows whose keys the table at ``path`` doesn't hold yet, batch by batch."""
    spark = source.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        from ..sources.sinks import exists

        rows = batch.dropDuplicates(keys)
        if exists(spark, path):
            rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
