"""Snapshots of all volumes: versioned Parquet partitioned by drive, a manifest, and a pointer to the version that counts."""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelight.operators.paths import validate
from treelight.sources.shared import hadoop_path

log = logging.getLogger(__name__)

MAGIC, FORMAT = "treelight", 2


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """By way of another name, so that a reader sees all of it or nothing."""
    jvm = spark.sparkContext._jvm
    other, fs = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(other, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(other), context.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), over)


def save(entries: DataFrame, volumes: DataFrame, path: str) -> str:
    """Writes the ready volumes (drive, phase, journal_id, next_usn) and their entries as a new version; returns its name."""
    spark = entries.sparkSession
    version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    ready = volumes.where("phase = 'ready'").select("drive", "journal_id", "next_usn")
    entries.join(ready.select("drive"), "drive", "left_semi").write.partitionBy("drive").parquet(f"{path}/{version}/entries")
    ready.write.parquet(f"{path}/{version}/volumes")
    _write_text(spark, f"{path}/CURRENT", json.dumps({"magic": MAGIC, "format": FORMAT, "version": version, "saved_at": int(time.time())}))
    return version


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(entries, volumes) of the version that counts; None where anything is missing, foreign or damaged."""
    try:
        said = "".join(r[0] for r in spark.read.text(f"{path}/CURRENT").collect())
        manifest = json.loads(said)
        if manifest.get("magic") != MAGIC or manifest.get("format") != FORMAT:
            return None
        entries = spark.read.parquet(f"{path}/{manifest['version']}/entries")
        volumes = spark.read.parquet(f"{path}/{manifest['version']}/volumes")
        bad = validate(entries).where("roots + root_keys + names + parents + keys > 0")
        return (entries, volumes) if bad.isEmpty() else None
    except Exception as e:  # a snapshot is only a shortcut: whatever is wrong with it, the volume is built anew
        log.warning("snapshot %s can't be used: %s", path, e)
        return None


def replace_volume(entries: DataFrame, one: DataFrame, drive: str) -> DataFrame:
    """entries with a whole volume replaced (init) or, if `one` is empty, removed."""
    return entries.where(F.col("drive") != drive).unionByName(one.where(F.col("drive") == drive))
