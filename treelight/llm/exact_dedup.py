"""Exact deduplication by progressive refinement: length, then prefix hash, then the hash of the whole text.

Rows are counted by length and prefix hash, pre-aggregated before the shuffle; a key that two rows share survives (its length is
shared, too). The surviving keys go into a bitmap of bounded size that every task has: rows that it doesn't know are alone and take
no further part, they aren't shuffled. What it knows is grouped by key and hash of the whole text, which decides; a key that
shares its bit with a surviving one is only grouped for nothing. ``dedup_rows`` hashes whole texts only there, and moves whole
rows only there, after each task has left one row of every group; a group of copies may hold any share of the rows. ``exact_dedup``
returns a digest for every row, so it hashes every text, once, and goes on with ids, lengths and hashes; rows of a large group meet
it in many tasks.

Defined results: a null text counts as the empty text; very long texts are compared whole like any other; texts are equal when they
are identical after lower-casing A-Z alone; of equal texts the largest id stays, a null id only where there's no other; repeated rows
of the document that stays are the same document, so each counts in group_size and each is marked kept (``dedup_rows`` leaves one of
them, the one with the largest hash of all columns where they differ); an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from treelight.llm.common import ascii_lower, text_of, written

#: Characters of the text that the second level hashes.
PREFIX_CHARS = 64
#: Bits of a row of the bitmap (what bitmap_construct_agg makes), bits for each surviving key, and rows at most (32 MB in all).
ROW_BITS, KEY_BITS, MOST_ROWS = 32768, 16, 8192
#: From how many rows on a group is dealt in parts, and in how many.
LARGE_GROUP, SALTS = 256, 64


def _length(text: Column) -> Column:
    return F.octet_length(text)  # lower-casing A-Z keeps the length in bytes


def _prefix(text: Column, prefix_chars: int) -> Column:
    return F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars)))


def _digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text), 256)


def _split(rows: DataFrame, of_row: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key of_row is one of keys (key), with few others; and those whose key certainly isn't."""
    keys = written(keys, "keys")
    n_rows = max(1, min(MOST_ROWS, -(-keys.count() * KEY_BITS // ROW_BITS)))

    def place(key: Column) -> tuple[Column, Column]:
        at = F.pmod(key, F.lit(n_rows * ROW_BITS))
        return F.floor(at / ROW_BITS).cast("int"), F.pmod(at, F.lit(ROW_BITS))

    row, bit = place(F.col("key"))
    bits = F.broadcast(keys.groupBy(row.alias("bit_row")).agg(F.bitmap_construct_agg(bit).alias("bits")))
    row, bit = place(of_row)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1, F.lit(False))
    met = rows.join(bits, row == F.col("bit_row"), "left").withColumn("known", known).drop("bit_row", "bits")
    return met.where("known").drop("known"), met.where("not known").drop("known")


def _surviving(heads: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (with len, prefix) that share both with another row of heads, with few others; and those that certainly don't."""
    key = F.xxhash64("len", "prefix")
    return _split(rows, key, heads.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key.alias("key")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), _length(text).alias("len"), _prefix(text, prefix_chars).alias("prefix"), _digest(text).alias("digest"))
    rows = written(rows, "digests")
    shared, alone = _surviving(rows, rows)
    found = shared.groupBy("len", "prefix", "digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(found.where("group_size > 1").select("digest", "keep_id", "group_size"), "groups")
    # rows of large groups are dealt by salt, too, so that no task meets all of one
    large = groups.where(F.col("group_size") > LARGE_GROUP)
    crowded, others = _split(shared.select("id", "digest"), F.xxhash64("digest"), large.select(F.xxhash64("digest").alias("key")))
    crowded = crowded.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    salted = groups.join(crowded.select("digest").distinct(), "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = others.join(groups, "digest", "left").union(crowded.join(salted, ["digest", "salt"], "left").drop("salt")).select("id", "digest", "keep_id", "group_size")
    alone = alone.select("id", "digest", F.lit(None).cast(rows.schema["id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    return shared.union(alone).select(
        F.col("id").alias("doc_id"),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row for each different text."""
    text = text_of(text_col)
    heads = docs.select(_length(text).alias("len"), _prefix(text, prefix_chars).alias("prefix"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _length(text).alias("len"), _prefix(text, prefix_chars).alias("prefix"))
    shared, alone = _surviving(heads, rows)
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    order = F.struct(F.col("row")[id_col], F.xxhash64(*[F.col("row")[c] for c in plain]))
    whole = _digest(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    shared = shared.groupBy("len", "prefix", whole.alias("digest")).agg(F.max_by("row", order).alias("row"))
    return alone.select("row.*").union(shared.select("row.*"))
