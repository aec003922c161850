"""Hierarchy operators over entries: full paths, subtrees, reachability, integrity checks and per-volume counters.

Full paths come from pointer doubling over directories alone: round r joins every directory with the ancestor 2^r levels
up, so a tree of depth d takes log2(d) equi-joins, whatever its width; files join their directory once. Each round is
written, and a cycle of parents ends with the rounds and counts as unreachable. A chain that is still open after MOST_ROUNDS rounds
(more than 4096 levels) counts as a cycle, too; eight times the depth that paths may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelight.functions.fold import extension, fold
from treelight.sources.shared import Scratch, written

ROOT_FRN = 5
MOST_ROUNDS = 12
REBUILD_DELETED, REBUILD_SHARE = 1024, 20
FIRST_USER_FRN = 24

COLUMNS = ["drive", "slot", "frn", "parent_frn", "name", "name_fold", "ext", "is_dir", "deleted"]


def as_entries(rows: DataFrame) -> DataFrame:
    """Adds the derived columns to drive, slot, frn, parent_frn, name, is_dir and, if there, deleted."""
    deleted = F.col("deleted") if "deleted" in rows.columns else F.lit(False)
    return rows.select(
        "drive",
        F.col("slot").cast("long").alias("slot"),
        F.col("frn").cast("long").alias("frn"),
        F.col("parent_frn").cast("long").alias("parent_frn"),
        "name",
        fold(F.col("name")).alias("name_fold"),
        F.when(F.col("is_dir"), F.lit("")).otherwise(extension(F.col("name"))).alias("ext"),
        "is_dir",
        deleted.alias("deleted"),
    )


def dir_paths(entries: DataFrame) -> DataFrame:
    """drive, frn, path, path_fold, depth of every live directory that hangs from its root."""
    live = entries.where("is_dir and not deleted").select("drive", "frn", F.col("parent_frn").alias("up"), F.col("name").alias("path"))
    walk = live.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    scratch = Scratch(entries.sparkSession)
    for _ in range(MOST_ROUNDS):
        walk = scratch.written(walk, "walk")
        scratch.clear(walk)
        if walk.where("up is not null").isEmpty():
            break
        above = walk.select(F.col("drive").alias("a_drive"), F.col("frn").alias("a_frn"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("depth").alias("a_depth"))
        # a directory whose ancestor is gone drops out; one whose chain has ended stays as it is
        joined = walk.join(above, (F.col("drive") == F.col("a_drive")) & (F.col("up") == F.col("a_frn")), "left").where("up is null or a_frn is not null")
        walk = joined.select(
            "drive",
            "frn",
            F.col("a_up").alias("up"),
            F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat_ws("\\", "a_path", "path")).alias("path"),
            F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("a_depth")).alias("depth"),
        )
    done = walk.where("up is null")
    path = F.when(F.col("depth") == 0, F.concat("path", F.lit("\\"))).otherwise(F.col("path"))
    return done.select("drive", "frn", path.alias("path"), fold(path).alias("path_fold"), F.col("depth").cast("int").alias("depth"))


def with_paths(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """entries that hang from a root, with path. A root's own path ends with a backslash."""
    parents = paths.select(F.col("drive").alias("p_drive"), F.col("frn").alias("p_frn"), F.col("path").alias("p_path"), F.col("depth").alias("p_depth"))
    met = entries.join(parents, (F.col("drive") == F.col("p_drive")) & (F.coalesce("parent_frn", "frn") == F.col("p_frn")))
    path = (
        F.when(F.col("parent_frn").isNull(), F.col("p_path"))
        .when(F.col("p_depth") == 0, F.concat("p_path", "name"))
        .otherwise(F.concat_ws("\\", "p_path", "name"))
    )
    return met.select(*entries.columns, path.alias("path"))


def subtree(entries: DataFrame, paths: DataFrame, drive: str, frn: int) -> DataFrame:
    """The live entries below and including a directory: those whose path begins with its path."""
    top = paths.where((F.col("drive") == drive) & (F.col("frn") == frn)).select(F.col("path").alias("top"))
    top = top.first()
    if top is None:
        return with_paths(entries, paths).limit(0)
    inside = top["top"].rstrip("\\") + "\\"
    rows = with_paths(entries.where((F.col("drive") == drive) & ~F.col("deleted")), paths)
    return rows.where(F.startswith("path", F.lit(inside)) | ((F.col("frn") == frn) & F.col("is_dir")))


def orphans(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Live entries that don't hang from a root."""
    live = entries.where("not deleted")
    parents = paths.select(F.col("drive").alias("p_drive"), F.col("frn").alias("p_frn"))
    return live.join(parents, (F.col("drive") == F.col("p_drive")) & (F.coalesce("parent_frn", "frn") == F.col("p_frn")), "left_anti")


def needs_rebuild(deleted: Column, nodes: Column) -> Column:
    return (deleted > REBUILD_DELETED) & (deleted * REBUILD_SHARE > nodes)


def volume_status(entries: DataFrame) -> DataFrame:
    """drive, files (live), dirs, deleted, memory (the index's approximate bytes), needs_rebuild."""
    nodes = F.count(F.lit(1))
    memory = F.sum(F.octet_length("name")) + 24 * nodes + 24 * F.count_if(~F.col("deleted")) + 64 * F.count_if(F.col("is_dir")) + 4 * nodes
    return entries.groupBy("drive").agg(
        F.count_if(~F.col("deleted")).alias("files"),
        F.count_if(F.col("is_dir") & ~F.col("deleted")).alias("dirs"),
        F.count_if("deleted").alias("deleted"),
        memory.cast("long").alias("memory"),
        needs_rebuild(F.count_if("deleted"), nodes).alias("needs_rebuild"),
    )


def compact(entries: DataFrame) -> DataFrame:
    """The live entries, their slots numbered anew in the old order.

    Ranges of (drive, slot) are sorted and numbered by a task each; what stands before a range comes from the ranges' counts, of
    which there are as many as shuffle partitions and drives.
    """
    ranges = entries.where("not deleted").repartitionByRange("drive", "slot").withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "ranges")  # ranges are sampled, so they're fixed before they're counted
    counts = ranges.groupBy("drive", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("drive").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("drive").alias("c_drive"), F.col("range").alias("c_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("drive", "range").orderBy("slot")) - 1
    numbered = ranges.withColumn("inside", inside).join(counts, (F.col("drive") == F.col("c_drive")) & (F.col("range") == F.col("c_range")))
    return numbered.withColumn("slot", (F.col("before") + F.col("inside")).cast("long")).select(*entries.columns)


def validate(entries: DataFrame, drives: list[str] | None = None) -> DataFrame:
    """drive and the number of violations: roots (other than one directory without a parent at slot 0), root_keys (other than one root id,
    or elsewhere than at slot 0), names (null or not UTF-8), parents (dangling), keys (repeated). A drive of `drives` without a live
    entry has no root: 1 in both. Deleted entries can't outnumber entries here, as each is one."""
    live = entries.where("not deleted")
    parents = live.where("is_dir").select(F.col("drive").alias("p_drive"), F.col("frn").alias("p_frn")).distinct()
    dangling = live.where("parent_frn is not null").join(parents, (F.col("drive") == F.col("p_drive")) & (F.col("parent_frn") == F.col("p_frn")), "left_anti")
    dangling = dangling.groupBy(F.col("drive").alias("d_drive")).agg(F.count(F.lit(1)).alias("parents"))
    repeated = live.groupBy("drive", "frn").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("drive").alias("k_drive")).agg(F.sum(F.col("n") - 1).alias("keys"))
    roots = live.groupBy("drive").agg(
        F.abs(F.count_if(F.col("parent_frn").isNull() & (F.col("slot") == 0) & F.col("is_dir")) - 1).cast("long").alias("roots"),
        (F.abs(F.count_if(F.col("frn") == ROOT_FRN) - 1) + F.count_if((F.col("frn") == ROOT_FRN) & (F.col("slot") != 0))).cast("long").alias("root_keys"),
        F.count_if(F.col("name").isNull() | ~F.is_valid_utf8("name")).alias("names"),
    )
    out = roots.join(dangling, F.col("drive") == F.col("d_drive"), "left").join(repeated, F.col("drive") == F.col("k_drive"), "left")
    if drives:
        missing = entries.sparkSession.createDataFrame([(d,) for d in drives], "w_drive string")
        out = out.join(missing, F.col("drive") == F.col("w_drive"), "full").withColumn("drive", F.coalesce("drive", "w_drive"))
        out = out.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("roots", "root_keys")}).fillna(0, ["names"])
    return out.select("drive", "roots", "root_keys", "names", F.coalesce("parents", F.lit(0)).cast("long").alias("parents"), F.coalesce("keys", F.lit(0)).cast("long").alias("keys"))
