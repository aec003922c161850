"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources, in code-point order with null last, weigh 5, 2, 1, 5, 2, 1, ...; they share 150% of all words by weight, no
source above twice its own words, the excess shared anew by weight (the level at which that settles is found in
closed form). Blocks of BLOCK_WORDS words go to the sources by the highest quotients target / (2k + 1), then each
source's blocks go to its shards in the same way by the words they hold. A shard is a seeded part of a source of about
SHARD_WORDS words, so the order inside one is kept by many tasks however large a source is. Inside a shard the documents
stand in a seeded order, their words one after the other; the shard's quota is taken from the start of that row of
blocks, around again where it's more than the shard holds. So a document is taken whole, twice or not at all, except the
one in each shard in which the last block ends.

Seats by quotients are found without listing them all: rounding target / (2 * level) at the level of exact
shares is off by at most half a block for each cell, so only as many next or last quotients as that can need are listed
for each cell (about three times the cells in all) and ranked.

Sources pass through one task, one row each (source_targets): some millions are fine, as many as there are documents aren't.

Defined results: a null or empty text has 0 words and is never taken; a very long text counts whole, and a shard then holds more than
SHARD_WORDS; a null source is a source; repeated rows count each on its own (ties in the seeded order go by id, then by words, then
by a hash of the text; equal rows are interchangeable); an empty table gives an empty result; other columns are ignored whatever
their names; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelight.llm.common import SPACE_CLASS, WORD_CLASS, Scratch, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
GROUP_SHARDS = 4096
SEED = 20240607


def n_words(text_col: str = "text"):
    return F.regexp_count(text_of(text_col), F.lit(WORD_CLASS)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds sid (its number in order), weight and target.

    The level l of min(2 * size, l * weight) comes from the sources in order of 2 * size / weight: those at their
    bound are the first ones. One row per source passes through one task, not one per document.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    bound = F.col("source_size") * F.lit(float(MOST_REPEATS))
    rows = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight).withColumn("bound", bound)
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    rows = rows.select(
        "*",
        ((F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)).alias("level"),
    )
    # bounded exactly where its own ratio is at most the level that remains for it and those after it
    free = F.when(F.col("level") * F.col("weight") < F.col("bound"), F.col("level"))
    rows = rows.withColumn("level", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select(
        "sid", "source", "source_size", "weight", F.coalesce(F.col("level") * F.col("weight"), F.col("bound")).cast("double").alias("target")
    )


def apportion(cells: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds n_seats to cells; within each group its `seats` go to the highest weight / (2k + 1).

    Ties go by key. Cells without weight get none.
    """
    g = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(1))
    rows = cells.withColumn("w_all", F.sum(weight).over(g)).withColumn("n_cells", F.count(F.lit(1)).over(g))
    rows = rows.withColumn("exact", F.coalesce(F.col(weight) * F.col(seats) / F.when(F.col("w_all") > 0, F.col("w_all")), F.lit(0.0)))
    rows = rows.withColumn("base", F.floor(F.col("exact") + 0.5).cast("long"))
    rows = rows.withColumn("missing", F.col(seats) - F.sum("base").over(g))
    rows = rows.withColumn("place", F.row_number().over(g.orderBy(*[F.col(c).asc_nulls_last() for c in key])))
    # as many quotients of each cell as |missing| <= n_cells / 2 can move
    reach = F.ceil(F.col("exact") * 1.5 * F.col("n_cells") / F.greatest(F.col(seats), F.lit(1))).cast("long") + 1
    up = F.when(
        (F.col("missing") > 0) & (F.col(weight) > 0), F.sequence(F.col("base"), F.col("base") + reach)
    ).when(
        (F.col("missing") < 0) & (F.col("base") > 0), F.sequence(F.greatest(F.lit(0), F.col("base") - 1 - reach), F.col("base") - 1)
    )
    steps = rows.select(*group, *key, weight, "missing", "place", F.explode(up).alias("nth"))
    quotient = F.col(weight) / (2 * F.col("nth") + 1)
    sign = F.when(F.col("missing") > 0, F.lit(-1)).otherwise(F.lit(1))
    # of equal quotients the first keys win: they're added first and taken away last
    order = g.orderBy(sign * quotient, -sign * F.col("place"), "nth")
    moved = (
        steps.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= F.abs("missing"))
        .groupBy(*[F.col(c).alias(f"m_{c}") for c in group + key])
        .agg(F.count(F.lit(1)).alias("n_moved"))
    )
    on = None
    for c in group + key:
        same = F.col(c).eqNullSafe(F.col(f"m_{c}"))
        on = same if on is None else on & same
    joined = rows.join(moved, on, "left")
    n = F.col("base") + F.signum("missing").cast("long") * F.coalesce("n_moved", F.lit(0))
    return joined.select(*cells.columns, n.cast("long").alias("n_seats"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    group_shards: int = GROUP_SHARDS,
    seed: int = SEED,
    carry: Column | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source, shard, shard_quota (blocks), row (what carry says)."""
    carried = [] if carry is None else ["row"]
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text_col).alias("size"),
        F.xxhash64(text_of(text_col)).alias("tie"),
        *([] if carry is None else [carry.alias("row")]),
    )
    narrow = scratch.written(sized.drop("row"), "sizes")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    every = Window.partitionBy(F.lit(1))
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    targets = targets.withColumn("all_blocks", F.round(F.sum("target").over(every) / block_words).cast("long")).withColumn("n_shards", n_shards)
    targets = scratch.written(apportion(targets, [], ["sid"], "target", "all_blocks").withColumnRenamed("n_seats", "source_blocks"), "targets")

    def placed(rows: DataFrame) -> DataFrame:
        met = rows.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
        return met.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("n_shards")))

    shards = placed(narrow).groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = shards.withColumn("group", F.floor(F.col("shard") / group_shards))
    groups = shards.groupBy("sid", "group").agg(F.sum("shard_size").alias("group_size"), F.first("source_blocks").alias("source_blocks"))
    groups = apportion(groups, ["sid"], ["group"], "group_size", "source_blocks").select("sid", "group", F.col("n_seats").alias("group_blocks"))
    shards = apportion(shards.join(groups, ["sid", "group"]), ["sid", "group"], ["shard"], "shard_size", "group_blocks")
    quotas = scratch.written(
        shards.select(
            F.col("sid").alias("q_sid"),
            F.col("shard").alias("q_shard"),
            "shard_size",
            F.col("n_seats").alias("shard_quota"),
            F.least(F.col("n_seats") * block_words, F.col("shard_size") * MOST_REPEATS).alias("quota_words"),
        ),
        "quotas",
    )
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), *map(F.col, ("doc_id", "size", "tie"))]
    in_shard = Window.partitionBy("sid", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed(narrow if carry is None else sized).withColumn("offset", F.coalesce(F.sum("size").over(in_shard), F.lit(0)))
    met = offsets.join(quotas, (F.col("sid") == F.col("q_sid")) & (F.col("shard") == F.col("q_shard")))
    rounds = F.when(F.col("shard_size") > 0, F.expr("quota_words div shard_size")).otherwise(F.lit(0))
    tail = F.col("quota_words") - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), tail - F.col("offset")))
    return met.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", "shard_quota", *carried)


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str | None = None, **options
) -> DataFrame:
    """docs as the mix takes them: a row twice where its words are taken twice, none where they aren't taken.

    Where the last block of a shard ends inside a document, that copy ends after the words taken, and chars_col, if
    given, holds its new length. Whole rows move once, into their shards.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    taken = mix(docs, id_col, source_col, text_col, carry=row, **options).where("taken > 0")
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    copies = taken.select("row", whole.alias("whole"), rest.alias("rest"), F.explode(F.sequence(F.lit(1), whole + F.signum(rest).cast("long"))).alias("copy"))
    text = F.col("row")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(WORD_CLASS + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("rest").cast("int")), ""), SPACE_CLASS + "$", "")
    short = F.col("copy") > F.col("whole")
    out = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.when(short, cut).otherwise(value)
        elif c == chars_col:
            value = F.when(short, F.char_length(cut).cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return copies.select(*out)
