"""Shared scratch tables: every intermediate lives in the folder the cluster names.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back with its known schema, so a lost executor only costs the running stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for a local master that names no folder (tests, notebooks).
LOCAL_DEFAULT = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_DEFAULT


class Scratch:
    """A fresh folder of intermediate tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Writes ``df`` and returns a DataFrame over the written files.

        The shuffles of the write are of no use after it; Spark deletes their files at its end.
        """
        conf, old = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            # Hashes and texts gain nothing from dictionaries; zstandard takes no longer than the default and a quarter less room.
            df.write.option("parquet.enable.dictionary", "false").option("compression", "zstd").mode("overwrite").parquet(self.path(label))
        finally:
            conf.set(CLEANUP, old)
        # Results may read these tables until the application ends; then they go.
        path, files = self._files(self.root)
        files.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, label: str) -> None:
        path, files = self._files(self.path(label))
        files.delete(path, True)
