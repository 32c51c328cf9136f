"""Sinks: Parquet and CSV, appending, merging without repeats, reuse of finished parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "snappy", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append files with a header each, which readers with a header take as one table."""
    df.write.mode("append").option("header", True).csv(path)


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that aren't arrays, maps or structs."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def merged(old: DataFrame | None, new: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Old and new rows, those equal on the keys (all scalar columns by default) once."""
    both = old.unionByName(new, allowMissingColumns=True) if old is not None else new
    return both.dropDuplicates(list(keys) if keys else scalar_columns(both))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The stored table, if there is one, else the made one, stored."""
    if again or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unfinished(parts: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The parts that aren't done yet."""
    return parts if done is None else parts.join(done.select(*keys).distinct(), list(keys), "left_anti")


def add_part(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append parts to a table laid out by keys; running a part again replaces it alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_tri_state(c: str):
    """A nullable flag rendered for export: True, False or unknown."""
    return F.coalesce(F.initcap(F.col(c).cast("string")), F.lit("unknown"))
