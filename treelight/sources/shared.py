"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set, a local master gets a folder here; on a cluster that would lose rows, so it's refused."""
    sc = spark.sparkContext
    kept = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not kept:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="treelight-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(kept)
    return kept


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as the JVM's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables of one run. What clear() doesn't remove goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes df to the shared folder and reads it back: lineage ends here, and losing an executor loses nothing."""
        path = f"{shared_dir(self.spark).rstrip('/')}/treelight/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, partitionBy=partition_by)
        p, fs = hadoop_path(self.spark, path)
        fs.deleteOnExit(p)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def clear(self, *but: DataFrame) -> None:
        """Removes the tables, but not these; nothing that's still to be computed may read them."""
        kept = [t for t in self._tables if any(t[0] is b for b in but)]
        for _, path in (t for t in self._tables if t not in kept):
            p, fs = hadoop_path(self.spark, path)
            fs.delete(p, True)
        self._tables = kept


def written(df: DataFrame, name: str) -> DataFrame:
    """A single table of that kind."""
    return Scratch(df.sparkSession).written(df, name)
