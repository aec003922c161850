"""Language identification by language-bitmask n-gram filters: a bit-sliced Bloom filter over all languages at once.

Row r of the filter is a bit mask with one bit for each language; an n-gram has K_HASHES rows, and the AND of their masks
names every language whose filter contains it. A text is decided by popcounts: for each language, how many of the text's
n-grams it contains, less what false positives alone would give: with f the chance that a filter contains an
n-gram it never saw (the share of its bits that are set, to the power K_HASHES), hits h of n become (h - f n) / (1 - f).
The language with the highest corrected count wins (ties: the one first in code-point order).

Training: about SAMPLE_DOCS labelled documents, chosen by a seeded hash of their id, give the TOP_NGRAMS most frequent
n-grams of each language. Counts are aggregated by the executors; the driver gets TOP_NGRAMS hashes a language and sends
a filter of fixed size. Learned from are only rows whose crc32(doc_id as text) mod 5 is not 0 and whose label isn't null.
Prediction sees nothing but the text, all of it.

An n-gram is four characters in a row, after lower-casing, with every run of other characters than letters as one space.

Defined results: null text or one without a letter is ``und`` with score 0, as is everything if no label was learned; a
text none of whose n-grams is known gets the most frequent label with score 0; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelight.llm.common import bounded_sample, text_of

N = 4
TOP_NGRAMS = 8000
FILTER_ROWS = 1 << 18
K_HASHES = 3
SAMPLE_DOCS = 8000
SAMPLE_SEED = 5
FOLDS = 5
CHUNK_CHARS = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it isn't a letter or mark."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the index of each one's text, and for each text whether it has a letter."""
    # each text between two spaces of its own
    joined = "".join(f" {t} " for t in texts)
    codes = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = codes != _SPACE
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[letters]] = True
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # of each run of spaces the first
    keep[np.cumsum(lengths) - lengths] = True
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    n = len(codes) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter
    h = np.zeros(n, np.uint64)
    for i in range(N):
        h = h * np.uint64(0x110001) + codes[i : i + n]
    same = owner[:n] == owner[N - 1 :]
    return _mix(h[same] + _GOLDEN), owner[:n][same], has_letter


def slots(h: np.ndarray) -> list[np.ndarray]:
    """The K_HASHES rows of each n-gram, from one hash by double hashing."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(FILTER_ROWS)).astype(np.int64) for k in range(K_HASHES)]


class BitSlicedFilter:
    """masks: FILTER_ROWS x words of 64 languages; rates: chance of a false positive for each language."""

    def __init__(self, grams: dict[str, np.ndarray], prior: str | None):
        self.languages = sorted(grams)
        self.prior = prior
        self.masks = np.zeros((FILTER_ROWS, (len(self.languages) + 63) // 64), np.uint64)
        self.rates = np.zeros(len(self.languages))
        for i, language in enumerate(self.languages):
            bit = np.uint64(1 << (i % 64))
            for rows in slots(grams[language]):
                self.masks[rows, i // 64] |= bit
            self.rates[i] = np.mean((self.masks[:, i // 64] & bit) != 0) ** K_HASHES

    def corrected_counts(self, h: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
        """Texts x languages."""
        total = np.bincount(owner, minlength=n_texts).astype(float)
        out = np.zeros((n_texts, len(self.languages)))
        if len(h):
            first, *rest = slots(h)
            masks = self.masks[first]
            for rows in rest:
                masks &= self.masks[rows]
            for i, rate in enumerate(self.rates):
                hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits = np.bincount(owner, weights=hit, minlength=n_texts)
                out[:, i] = np.maximum(0, (hits - rate * total) / (1 - rate))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        h, owner, has_letter = ngrams(texts)
        counts = self.corrected_counts(h, owner, len(texts))
        labels, scores = [], []
        for i in range(len(texts)):
            if not has_letter[i] or not self.languages:
                labels.append("und")
                scores.append(0.0)
                continue
            best = int(counts[i].argmax())
            top = counts[i, best]
            labels.append(self.languages[best] if top > 0 else self.prior)
            scores.append(float(top / counts[i].sum()) if top > 0 else 0.0)
        return labels, scores


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, so many at a time that their characters stay few."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> BitSlicedFilter:
    learned = docs.where(f"`{label_col}` is not null and `{text_col}` is not null").where(fold(id_col) != 0)
    sample = bounded_sample(learned, id_col, sample_docs, SAMPLE_SEED).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label: dict[str, list[str]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_label.setdefault(label, []).append(text)
            for label, texts in by_label.items():
                for part in _parts(texts):
                    h, n = np.unique(ngrams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["label", "h", "n"])

    counts = sample.mapInArrow(run, "label string, h bigint, n bigint").groupBy("label", "h").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "h"))
    top = counts.withColumn("r", rank).where(F.col("r") <= TOP_NGRAMS).select("label", "h").toPandas()
    prior = sample.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).collect()
    grams = {str(k): v["h"].to_numpy().astype(np.int64).view(np.uint64) for k, v in top.groupby("label")}
    return BitSlicedFilter(grams, prior[0]["label"] if prior else None)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: BitSlicedFilter | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    model = model or train(docs, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [], []
            for part in _parts(batch.column("text").to_pylist()):
                got = sent.value.predict(part)
                labels += got[0]
                scores += got[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
