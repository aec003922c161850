"""Content search: matching, snippets and counts as column expressions, and the bounded scan with its accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.functions.extract import extract_text
from treelight.functions.fold import extension, fold, fold_str, quoted

SNIPPET_BYTES = 64
MOST_COUNT = 10_000
MOST_CANDIDATES = 2000
MOST_WINDOW = 1_000_000


def first_hit(folded: Column, needles: list[str]) -> Column:
    """The least position (from 1) of any needle, 0 unless all of them occur."""
    at = [F.locate(fold_str(n), folded) for n in needles]
    every = reduce(lambda a, b: a & b, (p > 0 for p in at))
    return F.when(every, F.least(*at) if len(at) > 1 else at[0]).otherwise(F.lit(0))


def match_count(folded: Column, needles: list[str]) -> Column:
    """Occurrences of all needles, overlapping ones too, at most MOST_COUNT."""
    n = reduce(lambda a, b: a + b, (F.regexp_count(folded, F.lit(f"(?={quoted(fold_str(x))})")) for x in needles))
    return F.least(F.lit(MOST_COUNT), n).cast("int")


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\p{IsWhite_Space}]+", " "))


def snippet(text: Column, hit: Column, around: int = SNIPPET_BYTES) -> Column:
    """Text around a hit (a position in characters from 1): `around` bytes to each side, widened to whole characters,
    white space collapsed, with an ellipsis where text that isn't blank was cut off."""
    data = F.encode(text, "UTF-8")
    at = F.octet_length(F.substr(text, F.lit(1), hit - 1))
    size = F.octet_length(text)
    low, high = F.greatest(F.lit(0), at - around), F.least(size, at + around)

    def inner(i: Column) -> Column:
        """Whether the byte at i (from 0) continues a character."""
        byte = F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(byte.bitwiseAND(0xC0) == 0x80, F.lit(False))

    back = F.when(inner(low), F.when(inner(low - 1), F.when(inner(low - 2), 3).otherwise(2)).otherwise(1)).otherwise(0)
    on = F.when(inner(high), F.when(inner(high + 1), F.when(inner(high + 2), 3).otherwise(2)).otherwise(1)).otherwise(0)
    start, end = low - back, high + on
    body = collapse_space(F.decode(F.substring(data, start + 1, end - start), "UTF-8"))
    before = collapse_space(F.decode(F.substring(data, F.lit(1), start), "UTF-8")) != ""
    after = collapse_space(F.decode(F.substring(data, end + 1, size - end), "UTF-8")) != ""
    return F.concat(F.when(before, F.lit("…")).otherwise(F.lit("")), body, F.when(after, F.lit("…")).otherwise(F.lit("")))


def scan_text(rows: DataFrame, needles: list[str], text_col: str = "text") -> DataFrame:
    """Adds status (match or no_match; rows with a status keep what isn't `text`), snippet and content_matches."""
    folded = fold(F.col(text_col))
    known = F.col("status") if "status" in rows.columns else F.when(F.col(text_col).isNull(), F.lit("error")).otherwise(F.lit("text"))
    rows = rows.withColumn("scan_status", known).withColumn("hit", first_hit(folded, needles))
    matched = (F.col("scan_status") == "text") & (F.col("hit") > 0)
    return rows.select(
        *[c for c in rows.columns if c not in ("status", "scan_status", "hit", "snippet", "content_matches")],
        F.when(matched, F.lit("match")).when(F.col("scan_status") == "text", F.lit("no_match")).otherwise(F.col("scan_status")).alias("status"),
        F.when(matched, snippet(F.col(text_col), F.col("hit"))).alias("snippet"),
        F.when(matched, match_count(folded, needles)).alias("content_matches"),
    )


def candidates(matched: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The window that is scanned: the first matches in index order; directories take places in it but aren't scanned."""
    return matched.orderBy("drive", "slot").limit(most).where("not is_dir")


def scan_files(candidate_paths: DataFrame, files: DataFrame, needles: list[str], most_bytes: int, tasks: int = 4, deadline: float | None = None) -> DataFrame:
    """candidate_paths: the window's rows with path (at most its size, MOST_WINDOW); files: Spark's binaryFile rows (path, length, content).
    Each candidate gets one status: match, no_match, binary, skipped_size, error (absent or broken) or not_scanned (after the deadline).

    Names and lengths alone decide which files are opened; nothing else is read."""
    spark = candidate_paths.sparkSession
    known = candidate_paths.select("path").distinct().join(files.select(F.col("path").alias("f_path"), "length"), F.col("path") == F.col("f_path"))
    found = known.select("path", "length").limit(MOST_WINDOW + 1).collect()
    if len(found) > MOST_WINDOW:
        raise ValueError(f"more than {MOST_WINDOW} candidates")
    lengths = spark.createDataFrame([tuple(r) for r in found], "f_path string, length long")
    small = [r["path"] for r in found if r["length"] <= most_bytes]
    empty = spark.createDataFrame([], "o_path string, content binary")
    opened = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(small).select(F.col("path").alias("o_path"), "content") if small else empty
    rows = candidate_paths.join(lengths, F.col("path") == F.col("f_path"), "left").join(opened, F.col("path") == F.col("o_path"), "left").repartition(tasks)
    got = rows.withColumn("got", extract_text(F.col("content"), extension(F.col("path")), deadline))
    status = F.when(F.col("length") > most_bytes, F.lit("skipped_size")).otherwise(F.col("got.status"))
    ready = got.select(*candidate_paths.columns, status.alias("status"), F.col("got.text").alias("text"))
    return scan_text(ready, needles).drop("text")


def scan_info(scanned: DataFrame) -> DataFrame:
    """One row of counters over scanned candidates."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return scanned.agg(
        count("match", "no_match").alias("scanned"),
        count("skipped_size").alias("skipped_size"),
        count("binary").alias("skipped_binary"),
        count("error").alias("errors"),
        count("match").alias("total_matched"),
    )


def timed_out(scanned: DataFrame) -> bool:
    return not scanned.where("status = 'not_scanned'").isEmpty()


def content_page(scanned: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Matches in index order, whatever sort was asked for."""
    return scanned.where("status = 'match'").orderBy("drive", "slot").offset(offset).limit(limit)
