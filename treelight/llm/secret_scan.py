"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans. Besides, every unbroken run of key characters in the text that's long enough is scored
by two first-order character models, trained from labelled samples: one from random strings, one from
ordinary words and identifiers. Where the log-likelihood ratio per character passes the threshold, and no base span
touches the run, it becomes a span of kind ``model``.

Labelled samples: the random strings are seeded draws from the alphabets that keys use (a rule, not a list), together
with the values of base spans in a bounded sample of documents; the ordinary ones are runs of key characters outside
base spans in the same sample, with letters in them and either no digits or parts joined as in identifiers. The sample is
about SAMPLE_DOCS documents chosen by a seeded hash of their id, and of each the first SAMPLE_RUNS runs by hash; only
counts of character pairs leave the executors.

Defined results: a null text counts as the empty text; a document without spans has zero counts, the digest of the empty
string and an empty spans string; a very long text is scanned whole; runs under LEAST_RUN characters
aren't scored (too short to tell); repeated rows give equal rows; an empty table gives an empty result; other columns are
ignored whatever their names. Offsets count code points, ends are exclusive; of equal starts, kinds go as listed.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import bounded_sample, text_of

KINDS = ("assign", "access", "hex", "model")
#: Fixed patterns of the base. Matches that fail the length are dropped, but what they consumed stays consumed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Characters of the runs that the models score; everything else separates runs.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
LEAST_RUN = 20
THRESHOLD = 0.9
SAMPLE_DOCS = 4000
SAMPLE_RUNS = 200
SAMPLE_SEED = 11
RANDOM_STRINGS = 4000

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
_WORD_RUN = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
_SIZE = len(ALPHABET) + 1
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(out)


# runs of hexadecimal digits are maximal either way, so asking for the length at once finds the same ones
_HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)


def pair_counts(strings: list[str]) -> np.ndarray:
    """Counts of (character, next character); row 0 stands for the start."""
    counts = np.zeros((_SIZE, _SIZE))
    for s in strings:
        codes = [0, *(_CODE[c] for c in s)]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return counts


def random_strings(n: int = RANDOM_STRINGS, seed: int = SAMPLE_SEED) -> list[str]:
    """Seeded draws over the alphabets of keys: hexadecimal, capitals and digits, letters and digits, base 64, and its URL form."""
    draw = random.Random(seed)
    capitals, small, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = [digits + small[:6], capitals + digits, capitals + small + digits, capitals + small + digits + "+/", capitals + small + digits + "-_"]
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(LEAST_RUN, 64))) for i in range(n)]


def ordinary(run: str) -> bool:
    """Whether a run outside base spans is a labelled ordinary string: letters, in parts that no digit breaks."""
    return any(c.isalpha() for c in run) and not re.search(r"[A-Za-z][0-9]+[A-Za-z]", run)


def _sample_counts(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts of secret values and of ordinary runs in the sample; two small matrices come to the driver."""
    sample = bounded_sample(docs, id_col, sample_docs, SAMPLE_SEED).select(text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _SIZE, _SIZE))
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py()
                spans = base_spans(text)
                values = [text[s:e] for s, k, e in spans if k] + [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
                total[1] += pair_counts([v for v in values if set(v) <= _CODE.keys()])
                runs = {m[0] for m in _WORD_RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in spans)}
                chosen = sorted((r for r in runs if ordinary(r)), key=lambda r: hashlib.blake2b(r.encode(), digest_size=8).digest())[:SAMPLE_RUNS]
                total[0] += pair_counts(chosen)
        cells = np.nonzero(total.reshape(-1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.reshape(-1)[cells])], names=["cell", "n"])

    counts = np.zeros(2 * _SIZE * _SIZE)
    for row in sample.mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return tuple(counts.reshape(2, _SIZE, _SIZE))


def log_ratios(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """log P(next | character) under the random model less the same under the ordinary one, both smoothed by 0.5."""
    given = lambda c: np.log((c + 0.5) / (c + 0.5).sum(axis=1, keepdims=True))
    return given(random_counts) - given(ordinary_counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    ordinary_counts, secret_counts = _sample_counts(docs, id_col, text_col, sample_docs)
    return log_ratios(pair_counts(random_strings()) + secret_counts, ordinary_counts)


def model_spans(text: str, base: list[tuple[int, int, int]], ratios: list[list[float]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, _, e in base):
            continue
        last, total = 0, 0.0
        for c in m[0]:
            code = _CODE[c]
            total += ratios[last][code]
            last = code
        if total > threshold * (end - start):
            out.append((start, 3, end))
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    table = (train(docs, id_col, text_col) if ratios is None else ratios).tolist()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [[], [], [], []], [], []
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text)
                more = model_spans(text, base, table, threshold)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in (more if k == 3 else base)))
                digests.append(hashlib.sha256(said(base).encode()).hexdigest())
                listed.append(said(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts[:3]), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(counts[3], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint")
