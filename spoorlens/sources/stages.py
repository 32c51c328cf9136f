"""Written stages: where an iterative job cuts its lineage.

A stage is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``, which every executor can reach.  A lost executor
therefore loses no stage, and a later step reads only the columns it needs.
Only where that setting is absent and the session runs in one process (tests, a
laptop) is a folder chosen here; a cluster without the setting is an error.
Folders of finished runs are removed by ``Stages.close``, and those that are left
when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_open: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for stages: ``spark.checkpoint.dir``, else one local folder a process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spoorlens-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _close_all() -> None:
    for root, spark in list(_open.items()):
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the session may be gone
            break


class Stages:
    """Tables written by one run of one operator, under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _open[self.root] = spark

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Run ``df`` once, keep it as a table and return a scan of the table."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._stage_path = at
        return out

    def write_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``write``, and the number of rows as the writing tasks counted them.

        A task that runs again after an executor is lost may be counted twice: the number tells zero from
        some and steers loops, but is no result.
        """
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, df: DataFrame | None) -> None:
        """Delete a stage that nothing will read again."""
        at = getattr(df, "_stage_path", None)
        if at:
            _delete(self.spark, at)

    def close(self) -> None:
        """Delete all stages of the run: for callers that have read, or written elsewhere, what it returned."""
        _delete(self.spark, self.root)
        _open.pop(self.root, None)
