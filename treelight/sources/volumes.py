"""Virtual volumes over the driver's tables: D documents, C a tree along foreign keys, P pages, Q flat names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelight.operators.paths import ROOT_FRN, as_entries, dir_paths
from treelight.sources.shared import Scratch, hadoop_path

#: Ids of directories are hashes of 40 bits above a base, so that none of some millions of names clash; documents stand after them.
LANG_BASE, SOURCE_BASE, DOC_BASE = 1 << 8, 1 << 41, 1 << 42
UNNAMED = "(none)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(rows: DataFrame, drive: str, frn: Column, parent: Column, name: Column, is_dir: bool) -> DataFrame:
    return rows.select(
        F.lit(drive).alias("drive"), frn.cast("long").alias("slot"), frn.cast("long").alias("frn"), parent.cast("long").alias("parent_frn"), name.alias("name"), F.lit(is_dir).alias("is_dir")
    )


def _root(spark: SparkSession, drive: str) -> DataFrame:
    rows = spark.range(1).select(F.lit(drive).alias("drive"), F.lit(0).cast("long").alias("slot"), F.lit(ROOT_FRN).cast("long").alias("frn"), F.lit(None).cast("long").alias("parent_frn"), F.lit(f"{drive}:").alias("name"), F.lit(True).alias("is_dir"))
    return rows


def lang_frn(lang: Column) -> Column:
    """An id of a directory by its name: the hash keeps it stable."""
    return LANG_BASE + F.pmod(F.xxhash64(lang), F.lit(1 << 40))


def source_frn(lang: Column, source: Column) -> Column:
    return SOURCE_BASE + F.pmod(F.xxhash64(lang, source), F.lit(1 << 40))


def documents_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an entry: one without a language or source hangs below the directory UNNAMED."""
    d = table(spark, sf_dir, "documents").withColumns({c: F.coalesce(c, F.lit(UNNAMED)) for c in ("lang", "source")})
    pairs = d.select("lang", "source").distinct()
    lang, source = F.col("lang"), F.col("source")
    return (
        _root(spark, "D")
        .union(_nodes(pairs.select("lang").distinct(), "D", lang_frn(lang), F.lit(ROOT_FRN), lang, True))
        .union(_nodes(pairs, "D", source_frn(lang, source), lang_frn(lang), source, True))
        .union(_nodes(d, "D", DOC_BASE + F.col("doc_id"), source_frn(lang, source), F.format_string("doc_%07d.txt", "doc_id"), False))
    )


def keys_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer are directories, orders are files with their status as extension."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    return (
        _root(spark, "C")
        .union(_nodes(r, "C", 100 + F.col("r_regionkey"), F.lit(ROOT_FRN), F.col("r_name"), True))
        .union(_nodes(n, "C", 1000 + F.col("n_nationkey"), 100 + F.col("n_regionkey"), F.col("n_name"), True))
        .union(_nodes(c, "C", 1_000_000 + F.col("c_custkey"), 1000 + F.col("c_nationkey"), F.col("c_name"), True))
        .union(_nodes(o, "C", 1_000_000_000 + F.col("o_orderkey"), 1_000_000 + F.col("o_custkey"), F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit("."), F.lower("o_orderstatus")), False))
    )


def pages_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/#?]*)", 1))
    host_frn = 1000 + F.pmod(F.xxhash64("host"), F.lit(1 << 40))
    return (
        _root(spark, "P")
        .union(_nodes(p.select("host").distinct(), "P", host_frn, F.lit(ROOT_FRN), F.col("host"), True))
        .union(_nodes(p, "P", (1 << 41) + F.col("page_id"), host_frn, F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html")), False))
    )


def names_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return (
        _root(spark, "Q")
        .union(_nodes(p, "Q", 100 + F.col("p_partkey"), F.lit(ROOT_FRN), F.col("p_name"), False))
        .union(_nodes(s, "Q", 1_000_000_000 + F.col("s_suppkey"), F.lit(ROOT_FRN), F.col("s_name"), False))
    )


VOLUMES = {"C": keys_volume, "D": documents_volume, "P": pages_volume, "Q": names_volume}


def entries(spark: SparkSession, sf_dir: str, drives: str = "CDPQ") -> DataFrame:
    out = None
    for drive in drives:
        one = VOLUMES[drive](spark, sf_dir)
        out = one if out is None else out.unionByName(one)
    return as_entries(out)


_stored: dict[tuple, tuple[DataFrame, DataFrame]] = {}


TABLES = {"C": ("region", "nation", "customer", "orders"), "D": ("documents",), "P": ("pages",), "Q": ("part", "supplier")}


def _state(spark: SparkSession, sf_dir: str, drives: str) -> tuple:
    """What tells whether the tables are still those that were stored."""
    out = []
    for name in (t for d in drives for t in TABLES[d]):
        path, fs = hadoop_path(spark, f"{sf_dir}/{name}.parquet")
        out.append((fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()))
    return tuple(out)


def stored(spark: SparkSession, sf_dir: str, drives: str = "CDPQ") -> tuple[DataFrame, DataFrame]:
    """entries and their directories' paths, built once for an application and searched from there.

    Entries lie in a folder for each drive, in the order of name_fold: filters on drives prune folders, filters on names reach
    the scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir, drives, _state(spark, sf_dir, drives))
    if key not in _stored:
        scratch = Scratch(spark)
        rows = entries(spark, sf_dir, drives).sortWithinPartitions("drive", "name_fold")
        table = scratch.written(rows, "entries", ["drive"])
        _stored[key] = table, scratch.written(dir_paths(table), "dir-paths")
    return _stored[key]


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change journal of volume J: signup creates, view and click rename, purchase deletes.

    Every fifth user's entry is a directory; others hang from the directory of their user id's tens, if it's there.
    """
    op = F.expr("case event_type when 'signup' then 'create' when 'view' then 'rename_old' when 'click' then 'rename_new' when 'purchase' then 'delete' end")
    is_dir = F.col("user_id") % 5 == 0
    parent = F.when(is_dir, F.lit(ROOT_FRN)).otherwise(100 + F.col("user_id") - F.col("user_id") % 5)
    return table(spark, sf_dir, "events").select(
        F.lit("J").alias("drive"),
        F.col("event_id").alias("usn"),
        op.alias("op"),
        (100 + F.col("user_id")).cast("long").alias("frn"),
        parent.cast("long").alias("parent_frn"),
        F.concat(F.lit("user_"), F.col("user_id"), F.lit("_"), F.col("event_id")).alias("name"),
        is_dir.alias("is_dir"),
    ).where("op is not null")
