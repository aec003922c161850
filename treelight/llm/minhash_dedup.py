"""Near-duplicate detection by ProbMinHash over sets of word shingles, banding and verification.

1. Words (JVM) are hashed; every five in a row make a shingle. Documents with the same shingles the same number of times
   are copies of each other: the smallest id stands for them from here on, so copies cost nothing below, however many
   there are.
2. ProbMinHash: each shingle is a Poisson process with its weight as rate. Every weight is 1, however often a text repeats the
   shingle, because links are defined by sets: so the probability Jaccard similarity is the Jaccard similarity of the sets. Its arrivals go to registers at random; a
   register keeps the shingle of its earliest arrival. A shingle is done once its next arrival is later than the
   latest of all registers, which ends most after one or two arrivals. Two documents agree in a register
   with a probability equal to their probability Jaccard similarity.
3. Banding: BANDS keys of ROWS registers each. Documents that share a key are candidates. In each bucket only the
   smallest id is paired with the others (a star), then classes are formed. Buckets that still hold several classes pair
   all their members with the hub of the largest class, the member with the highest mean similarity so far. What is then
   still apart is paired by what differs from the hub: two texts of a crowd that are similar enough must have
   a certain number of differences from the hub in common, so they meet in one of the rarest of these (prefix filtering on
   differences, bounded by positions and by parity maps). So no link between candidates is lost, and the pairs listed are of
   the order of the links, whatever the size of the crowd.
4. Verification: a pair is linked where the Jaccard similarity of the sets of shingles is 0.8 or more.
5. Classes are the connected components of the links, found by least labels and pointer jumping, each round written
   to the shared folder.

With 24 bands of 5, a pair at exactly 0.8 is a candidate with probability 1 - (1 - 0.8^5)^24 = 0.99993, whatever the counts.
Shuffles move keys and ids for all documents; texts move only for documents that are in a candidate pair.

Defined results: a null text counts as the empty text; a text without words has no shingles and is in a class of its own;
a very long text takes part whole; of members equally near the largest id is the hub, which changes no class; one with fewer than five words has a single shingle, all its words; case is ignored; repeated rows are copies; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import Scratch, text_of, words_of

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
CHUNK_WORDS = 400_000
#: Bytes of a shingle's hash that verification compares.
HASH_BYTES = 5
#: Members of one hub that one task meets it with, about.
HUB_PART = 256
#: 64-bit words of a difference's parity map.
MAP_WORDS = 4

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shifts and odd multipliers), element-wise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, starts: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all documents of a batch, and where each document's begin.

    words: 64-bit hashes of all words; starts: where each document's words begin, with the end of the last.
    """
    n = np.diff(starts)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out_starts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(starts[:-1] - out_starts[:-1], count) + np.arange(out_starts[-1])
    end = np.repeat(starts[1:], count)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        term = np.where(at + i < end, mix64(padded[at + i] + np.uint64(i + 1)), np.uint64(0))
        h = h * np.uint64(0x100000001B3) + term
    return mix64(h + _GOLDEN), out_starts


def counted_sets(h: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each document its different shingles in order and how often each occurs."""
    sets, counts = [], []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        s, n = np.unique(h[a:b], return_counts=True)
        sets.append(s)
        counts.append(n)
    return sets, counts


def prob_minhash(sets: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """Registers (documents x m): the shingle of the earliest arrival of each; zeros for a document without shingles."""
    n_docs = len(sets)
    best = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    if n_docs and sum(map(len, sets)):
        doc = np.repeat(np.arange(n_docs), [len(s) for s in sets])
        element, rate = np.concatenate(sets), np.concatenate(weights)
        time, step = np.zeros(len(element)), 0
        while len(element):
            step += 1
            r = mix64(element + np.uint64(step * int(_GOLDEN) % 2**64))
            time = time - np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / rate
            slot = doc * m + (mix64(r ^ _GOLDEN) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, slot, time)
            first = best[slot] == time
            held[slot[first]] = element[first]
            going = time < best.reshape(n_docs, m).max(axis=1)[doc]
            doc, element, rate, time = doc[going], element[going], rate[going], time[going]
    return held.reshape(n_docs, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(registers), bands), np.uint64)
    for i in range(rows):
        keys = mix64(keys * np.uint64(0x100000001B3) + registers[:, i::rows][:, :bands])
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, word hashes and starts, for so many documents at a time that their words stay few."""
    lists = batch.column("w")
    starts = np.asarray(lists.offsets, dtype=np.int64)
    words = np.asarray(lists.values).view(np.uint64)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_WORDS)) - 1)
        j = min(j, n)
        yield batch.column("id").slice(i, j - i), words[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        i = j


def _hashed_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = words_of(F.lower(text_of(text_col)))
    return docs.select(F.col(id_col).alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("w"))


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, digest (of all shingles and counts; null without words), keys (one for each band)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, starts in _chunks(batch):
                sets, counts = counted_sets(*shingles(words, starts, k))
                keys = band_keys(prob_minhash(sets, [np.ones(len(s)) for s in sets], bands * rows), bands, rows)
                digests = [xxhash.xxh3_128_digest(s.tobytes() + n.tobytes()) if len(s) else None for s, n in zip(sets, counts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), lists], names=["id", "digest", "keys"])

    rows_in = _hashed_words(docs, id_col, text_col)
    id_type = rows_in.schema["id"].dataType.simpleString()
    return rows_in.mapInArrow(run, f"id {id_type}, digest binary, keys array<bigint>")


def _contents(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id and h (hashes of the shingles in order, HASH_BYTES each) of the documents in ids."""
    chosen = docs.hint("merge").join(ids.select(F.col("id").alias("chosen_id")), F.col(id_col) == F.col("chosen_id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_ids, words, starts in _chunks(batch):
                sets, _ = counted_sets(*shingles(words, starts, k))
                h = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([chunk_ids, pa.array(h, pa.binary())], names=["id", "h"])

    rows = _hashed_words(chosen, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, h binary")


def _unpacked(h: bytes) -> np.ndarray:
    out = np.zeros((len(h) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(h, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(np.uint64).ravel()


def _verified(pairs: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold, with it."""
    left = contents.select(F.col("id").alias("a"), F.col("h").alias("ha"))
    right = contents.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    rows = pairs.select("a", "b").hint("merge").join(right, "b").hint("merge").join(left, "a").select("a", "b", "ha", "hb")
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, hb = batch.column("ha").to_pylist(), batch.column("hb").to_pylist()
            found = np.array([similarity(_unpacked(x), _unpacked(y)) for x, y in zip(ha, hb, strict=True)], float)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])
            yield out.filter(pa.array(found >= threshold))

    return rows.mapInArrow(run, f"a {id_type}, b {id_type}, similarity double")


_MAP = [f"map{i}" for i in range(MAP_WORDS)]


def _by_part(spokes: DataFrame, hub_rows: DataFrame) -> DataFrame:
    """hub_rows (hub, ...) once for each part of each hub."""
    hubs = spokes.select("hub", "parts").distinct()
    return hubs.join(hub_rows, "hub").select(*hub_rows.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _differences(spokes: DataFrame, contents: DataFrame) -> DataFrame:
    """hub, id, n and hub_n (shingles), similarity, tokens (hashes of the shingles that only one of the two has) and map (the parity of
    the tokens in each of 64 * MAP_WORDS cells) of spokes (hub, id, part,
    parts: members of a hub are dealt in parts, each with its own copy of the hub's row).

    A token's hash also depends on the hub, so equal tokens belong to one hub's members.
    """
    left = _by_part(spokes, contents.select(F.col("id").alias("hub"), F.col("h").alias("hub_h")))
    rows = spokes.hint("merge").join(contents, "id").hint("merge").join(left, ["hub", "part"])
    rows = rows.select("hub", "id", "h", "hub_h", F.xxhash64("hub").alias("salt"), "part", "parts")
    id_type = spokes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hub_n, found, tokens, maps = [], [], [], [], []
            for h, hub_h, salt in zip(batch.column("h"), batch.column("hub_h"), batch.column("salt").to_numpy().view(np.uint64), strict=True):
                x, y = _unpacked(h.as_py()), _unpacked(hub_h.as_py())
                only = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(only)) // 2
                n.append(len(x))
                hub_n.append(len(y))
                found.append(both / max(1, both + len(only)))
                hashed = mix64(only ^ salt)
                tokens.append(hashed.view(np.int64))
                odd = np.bincount((hashed % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) % 2
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            starts = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            lists = pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
            columns = [batch.column("hub"), batch.column("id"), pa.array(n, pa.int64()), pa.array(hub_n, pa.int64()), pa.array(found, pa.float64()), lists]
            columns += [batch.column("part"), batch.column("parts"), *(pa.array([m[i] for m in maps], pa.int64()) for i in range(MAP_WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["hub", "id", "n", "hub_n", "similarity", "tokens", "part", "parts", *_MAP])

    maps = ", ".join(f"{m} bigint" for m in _MAP)
    return rows.mapInArrow(run, f"hub {id_type}, id {id_type}, n bigint, hub_n bigint, similarity double, tokens array<bigint>, part int, parts int, {maps}")


def _candidates(differences: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of one hub, in different classes, that can reach the threshold.

    differences: hub, id, n, hub_n, label, outside (label isn't the hub's), tokens. Two texts of n and m shingles are similar enough where
    they differ in at most share * (n + m) of them, share = (1 - t) / (1 + t). With differences of size d and e from the hub, of which they
    have k in common, they differ in d + e - 2 k; so k >= (excess of one + excess of the other) / 2, where a text's excess is
    d - share * n. Excesses of texts outside the hub's class are above share * hub_n, so k is above zero.
    Both sides list tokens in order of rising frequency, those that no other member has standing first without being listed. The one
    with the lower excess lists what a partner with a higher one must meet; what stands before a common token bounds k on either side.
    Cells in which two parity maps differ hold at least one shingle that only one of the two texts has.
    """
    share = (1 - threshold) / (1 + threshold)
    listed = differences.select("hub", "id", F.explode("tokens").alias("token"))
    often = listed.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    met = listed.join(often, "token").groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("met"))
    sized = differences.select("hub", "id", "n", "label", "outside", F.size("tokens").alias("d"), (F.size("tokens") - share * F.col("n")).alias("excess"), (share * F.col("hub_n")).alias("far"), *_MAP)
    rows = sized.join(met, ["hub", "id"]).withColumn("own", F.col("d") - F.size("met"))
    # the least excess of a partner: one of higher excess, or any text of a size that fits
    above = F.when(F.col("outside"), F.col("excess")).otherwise(F.greatest("excess", "far"))
    below = F.greatest(F.col("excess") - 2 * share * F.col("n") / threshold, -share * F.col("n") / threshold)

    def tokens(partner: Column) -> DataFrame:
        common = (F.col("excess") + partner) / 2 - 1e-9
        length = F.floor(F.col("d") - F.greatest(common, F.lit(0.5))).cast("int") + 1 - F.col("own")
        kept = rows.withColumn("listed", F.slice("met", F.lit(1), F.greatest(length, F.lit(0))))
        return kept.select("id", "n", "label", "excess", "d", "own", *_MAP, F.posexplode("listed").alias("at", "x")).select(
            "id", "n", "label", "excess", *_MAP, (F.col("d") - F.col("own") - F.col("at")).alias("left"), F.col("x.token").alias("token")
        )

    lower = tokens(above).select(*[F.col(c).alias(c if c == "token" else f"l_{c}") for c in ("id", "n", "label", "excess", "left", "token", *_MAP)])
    unlike = reduce(Column.__add__, (F.bit_count(F.col(m).bitwiseXOR(F.col(f"l_{m}"))) for m in _MAP))
    return (
        tokens(below)
        .join(lower, "token")
        .where("label <> l_label and (l_excess < excess or (l_excess = excess and l_id < id))")
        .where(F.least("left", "l_left") >= (F.col("excess") + F.col("l_excess")) / 2 - 1e-9)
        .where(unlike <= share * (F.col("n") + F.col("l_n")) + 1e-9)
        .where(F.least("n", "l_n") >= threshold * F.greatest("n", "l_n") - 1e-9)
        .select(*_ordered(F.col("id"), F.col("l_id")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """id, class: the least id of each connected component of links (a, b); a row for each id in a link."""
    scratch = Scratch(links.sparkSession)
    both = scratch.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = scratch.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("n_id")).agg(F.min("class").alias("n_class"))
        lowered = labels.join(near, labels["id"] == near["n_id"], "left").select("id", F.col("class").alias("was"), F.least("class", F.coalesce("n_class", "class")).alias("to"))
        over = labels.select(F.col("id").alias("o_id"), F.col("class").alias("o_class"))
        jumped = lowered.join(over, lowered["to"] == over["o_id"], "left").select("id", "was", F.least("to", F.coalesce("o_class", "to")).alias("class"))
        jumped = scratch.written(jumped, "labels")
        labels = jumped.select("id", "class")
        if jumped.where("class < was").isEmpty():
            scratch.clear(jumped)
            return labels
        scratch.clear(both, jumped)


def _apart(shared: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, n (the bucket's members), label, main (the label of the bucket's largest class) of the members of buckets with several classes."""
    labelled = shared.join(labels.withColumnRenamed("class", "label"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    labelled = scratch.written(labelled, "labelled")
    mixed = (
        labelled.groupBy("key", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("n_labels"))
        .where("n_labels > 1")
        .select("key", F.col("most.label").alias("main"))
    )
    return scratch.written(labelled.join(mixed, "key"), "mixed")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of its class), copy_of (the least id with equal shingles),
    n_links (verified links of that id to others), class_size, kept (doc_id is class_id).

    Rows with a null id take no part and share the null class. Links are those that were verified; pairs already in one class through others aren't tested.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.written(_signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    copies = signed.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("copy_of"))
    chosen = copies.select(F.col("copy_of").alias("id")).distinct()
    members = scratch.written(
        signed.where("digest is not null")
        .join(chosen, "id", "left_semi")
        .select("id", F.explode("keys").alias("key"))
        .distinct(),
        "members",
    )
    buckets = scratch.written(members.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = members.join(buckets, "key")
    stars = scratch.written(shared.where("id <> center").select(*_ordered(F.col("center"), F.col("id"))).distinct(), "stars")
    ends = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    contents = scratch.written(_contents(docs, ends, id_col, text_col, words), "contents")
    links = scratch.written(_verified(stars, contents, threshold), "star-links")

    # buckets of three or more with several classes: every member against the hub
    inside = _apart(shared.where("n > 2"), components(links), scratch)
    both_ways = links.select(F.col("a").alias("c_id"), "similarity").union(links.select(F.col("b").alias("c_id"), "similarity"))
    closeness = both_ways.groupBy("c_id").agg(F.avg("similarity").alias("near"))
    hubs = (
        inside.where("label = main")
        .join(closeness, F.col("id") == F.col("c_id"), "left")
        .groupBy("key")
        .agg(F.max(F.struct(F.coalesce("near", F.lit(0.0)), "id"))["id"].alias("hub"), F.max("n").alias("n"))
    )
    parts = hubs.groupBy(F.col("hub").alias("p_hub")).agg(F.ceil(F.sum("n") / HUB_PART).cast("int").alias("parts"))
    hubs = hubs.join(parts, F.col("hub") == F.col("p_hub")).select("key", "hub", "parts")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    spokes = scratch.written(inside.join(hubs, "key").where("id <> hub").select("hub", "id", part.alias("part"), "parts").distinct(), "spokes")
    differences = scratch.written(_differences(spokes, contents), "differences")
    links = links.union(differences.where(F.col("similarity") >= threshold).select(*_ordered(F.col("hub"), F.col("id")), "similarity"))

    # members of a hub that are still apart, by what they have other than the hub
    labels = components(links).withColumnRenamed("class", "label")
    placed = differences.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    hub_labels = spokes.select("hub").distinct().join(labels, F.col("hub") == F.col("id"), "left").select("hub", F.coalesce("label", "hub").alias("hub_label"))
    placed = placed.join(_by_part(spokes, hub_labels), ["hub", "part"])
    placed = scratch.written(placed.withColumn("outside", F.col("label") != F.col("hub_label")), "placed")
    mixed = _by_part(spokes, placed.where("outside").select("hub").distinct())
    cross = scratch.written(_candidates(placed.join(mixed, ["hub", "part"], "left_semi"), threshold), "cross")
    links = links.union(scratch.written(_verified(cross, contents, threshold), "cross-links")).select("a", "b").distinct()
    labels = components(links)
    degrees = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    copies = copies.join(labels, copies["copy_of"] == labels["id"], "left").drop("id")
    copies = copies.join(degrees, copies["copy_of"] == degrees["id"], "left").select(
        "digest", "copy_of", F.coalesce("class", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    placed = signed.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(copies, "digest", "left")
    placed = scratch.written(
        placed.select(
            "id",
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("copy_of", "id").alias("copy_of"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ),
        "classes",
    )
    scratch.clear(placed)
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    sizes = sizes.withColumnRenamed("class_id", "s_id")
    return placed.join(sizes, F.col("class_id").eqNullSafe(F.col("s_id"))).select(
        F.col("id").alias("doc_id"), "class_id", "copy_of", "n_links", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each class the document with the least id, with all its columns (repeats of that row too)."""
    gone = near_dedup(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
