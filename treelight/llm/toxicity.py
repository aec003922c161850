"""Toxicity by a weighted finite-state pattern grammar: clauses are scored, not isolated words.

Lexicon. A word is an insult with a weight if it, or the longest of its beginnings in the lexicon, was found in toxic texts
far more often than in others (log ratio of rates, from labelled rows). A short beginning only counts if several words share it.
Threats, targets, negations and words of reported speech are short fixed lists in the languages the grammar knows.

Grammar. Words become classes (insult, threat, target, negation, report, other) and ends of clauses and sentences. Five transducers,
given as tables of states and arcs, read them and put marks on what they pass:

  insult      marks words of the lexicon
  threat      marks threats
  negation    marks the NEGATION_REACH words after a negation
  reported    marks what follows a word of reported speech up to the end of the sentence
  target      marks the end of a clause in which a target was named, so it holds for all of the clause

compose() makes one automaton of them, whose states are the reachable tuples of theirs and whose arcs carry all their marks; it runs
once over the words. A clause matches if an insult or threat was passed in it. Its pattern is the set of marks, its weight that of its
insults and threats times a factor for each mark; a threat without a target has none.

Scoring. A text's features are the weight of its matched clauses and the same over the root of its number of words. A
logistic regression over them gives the score. The marks' factors (arc weights) are learned with it, on the same sample: each from a
grid by the likelihood, held by a prior (PRIORS) where the sample says nothing.

Training sample: about SAMPLE_ROWS labelled documents, chosen by a seeded hash of their id; equal texts (but for case and
white space) with the same label count once, by the row with the least id. Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2. The driver gets at most MOST_TERMS terms
and 17 numbers for each sampled document. Neither order nor partitions of the rows change what is learned. Scoring sees nothing but the text, all of it.

Defined results: a null or empty text has no clauses, its features are zeros and it's scored like any other; a very long text is read
whole, in memory of its own size; of two lexicon entries the whole word, then the longer beginning wins; with no
labels of both kinds every score is 0; a document with several labels is toxic if one says so; repeated rows give equal
rows; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import bounded_sample, text_of, written

SAMPLE_ROWS = 16_000
SAMPLE_SEED = 17
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MOST_TERMS = 20_000
LEAST_TEXTS = 5
LEAST_WEIGHT = 3.0
MOST_WEIGHT = 6.0
BEGINNINGS = range(3, 9)
#: Letters from which on a beginning needn't be shared by several words.
OWN_BEGINNING = 6

NEGATION_REACH = 2
THREAT_WEIGHT = 4.0
#: Factors of the marks where the sample says nothing, and how firmly it's held to them (for the square of a factor of e).
PRIORS = {"threat": 1.0, "negated": 0.1, "reported": 0.3, "targeted": 1.5}
PRIOR_STRENGTH = 2.0
GRID = (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

#: The words of the grammar's other transducers.
THREATS = {"kill", "hurt", "destroy", "murder", "tuer", "tuerai", "frapper", "umbringen", "töten", "verprügeln", "matar", "mataré", "golpear"}
TARGETS = {"you", "your", "yourself", "them", "toi", "tu", "vous", "ton", "votre", "du", "dich", "dir", "euch", "tú", "ti", "usted", "ustedes"}
NEGATIONS = {"not", "never", "isn't", "aren't", "wasn't", "don't", "pas", "jamais", "nicht", "nie", "kein", "keine", "nunca", "jamás"}
REPORTS = {"said", "says", "wrote", "claimed", "quoted", "reported", "dit", "écrit", "affirme", "sagte", "schrieb", "behauptete", "dijo", "escribió", "afirmó"}

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?\n;]")


OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CLAUSE, SENTENCE = range(8)
WORDS, ENDS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT), (CLAUSE, SENTENCE)


@dataclass(frozen=True)
class Transducer:
    """start; arcs: (state, class) to (state, marks). Where there's no arc, the state stays and nothing is marked."""

    start: Hashable
    arcs: dict[tuple[Hashable, int], tuple[Hashable, frozenset[str]]]

    def step(self, state: Hashable, read: int) -> tuple[Hashable, frozenset[str]]:
        return self.arcs.get((state, read), (state, frozenset()))


def _arcs(*rows: tuple) -> dict:
    """From (state, classes, state, marks...)."""
    return {(state, c): (to, frozenset(marks)) for state, classes, to, *marks in rows for c in classes}


COMPONENTS = (
    Transducer(0, _arcs((0, [INSULT], 0, "insult"))),
    Transducer(0, _arcs((0, [THREAT], 0, "threat"))),
    Transducer(
        0,
        _arcs(
            *((r, [c for c in WORDS if c != NEGATION], r - 1, "negated") for r in range(1, NEGATION_REACH + 1)),
            *((r, [NEGATION], NEGATION_REACH) for r in range(NEGATION_REACH + 1)),
            *((r, ENDS, 0) for r in range(NEGATION_REACH + 1)),
        ),
    ),
    Transducer("own", _arcs(("own", [REPORT], "reported"), ("reported", WORDS, "reported", "reported"), ("reported", [SENTENCE], "own"))),
    Transducer("none", _arcs(("none", [TARGET], "named"), ("named", ENDS, "none", "targeted"))),
)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same classes side by side: reachable pairs of states, marks of both."""
    start = (a.start, b.start)
    arcs, todo, known = {}, [start], {start}
    while todo:
        state = todo.pop()
        for c in (*WORDS, *ENDS):
            (to_a, marks_a), (to_b, marks_b) = a.step(state[0], c), b.step(state[1], c)
            to = (to_a, to_b)
            if to != state or marks_a or marks_b:
                arcs[state, c] = (to, marks_a | marks_b)
            if to not in known:
                known.add(to)
                todo.append(to)
    return Transducer(start, arcs)


#: Bits of a pattern.
PATTERN = {"threat": 1, "negated": 2, "reported": 4, "targeted": 8}
N_PATTERNS = 16


def _table(t: Transducer) -> list[list[tuple[int, int]]]:
    """For each state, numbered, the first being the start, and class: the next state and the pattern's bits of the marks."""
    numbers = {t.start: 0}
    for to, _ in t.arcs.values():
        numbers.setdefault(to, len(numbers))
    out = []
    for state in numbers:
        steps = [t.step(state, c) for c in (*WORDS, *ENDS)]
        out.append([(numbers[to], sum(PATTERN.get(m, 0) for m in marks)) for to, marks in steps])
    return out


TABLE = _table(reduce(compose, COMPONENTS))
#: States that a word of no class neither leaves nor marks.
_IDLE = [row[OTHER] == (i, 0) for i, row in enumerate(TABLE)]
_CLASSES = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_CLASSES |= {".": SENTENCE, "!": SENTENCE, "?": SENTENCE, "\n": SENTENCE, ";": CLAUSE}


def factors_of(marks: dict[str, float]) -> np.ndarray:
    """The factor of each pattern."""
    out = np.ones(N_PATTERNS)
    for i in range(N_PATTERNS):
        for mark, bit in PATTERN.items():
            if i & bit:
                out[i] *= marks[mark]
        if i & PATTERN["threat"] and not i & PATTERN["targeted"]:
            out[i] = 0.0
    return out


@dataclass
class Grammar:
    """weights: of insults by word (``=word``) or beginning; marks: factors; coefficients: of the regression, the constant first."""

    weights: dict[str, float] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    coefficients: list[float] | None = None

    def __post_init__(self):
        self._seen: dict[str, tuple[int, float]] = {}
        self._factors = factors_of(self.marks)

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a word: its own weight, else that of its longest beginning in the lexicon, else the fixed lists."""
        found = self._seen.get(word)
        if found is None:
            weight = self.weights.get("=" + word)
            for k in reversed(BEGINNINGS):
                if weight is None and len(word) > k:
                    weight = self.weights.get(word[:k])
            found = (INSULT, weight) if weight else (_CLASSES.get(word, OTHER), THREAT_WEIGHT)
            if len(self._seen) > 300_000:
                self._seen.clear()
            self._seen[word] = found
        return found

    def patterns(self, text: str) -> tuple[list[float], int]:
        """Weights of matched clauses by pattern, without factors, and the number of words."""
        sums, clause = [0.0] * N_PATTERNS, []
        state, n_ends, seen, read = 0, 0, self._seen, self.read
        tokens = _TOKEN.findall(text.lower())
        for token in tokens:
            c, weight = seen.get(token) or read(token)
            if c == OTHER and _IDLE[state]:
                continue
            state, bits = TABLE[state][c]
            if c == INSULT or c == THREAT:
                clause.append((bits, weight))
            elif c >= CLAUSE:
                n_ends += 1
                for inside, w in clause:
                    sums[inside | bits] += w
                clause.clear()
        _, bits = TABLE[state][SENTENCE]
        for inside, w in clause:
            sums[inside | bits] += w
        return sums, len(tokens) - n_ends

    def total(self, text: str) -> float:
        return float(np.dot(self.patterns(text)[0], self._factors))

    def score(self, text: str) -> float:
        if self.coefficients is None:
            return 0.0
        sums, n = self.patterns(text)
        z = float(np.dot(self.coefficients, design(np.array([np.dot(sums, self._factors)]), np.array([n]))[0]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def design(totals: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Columns of the regression: a constant, the logarithms of the weight and of the weight over the root of the words."""
    return np.column_stack([np.ones(len(totals)), np.log1p(totals), np.log1p(totals / np.sqrt(np.maximum(n, 1)))])


def learn(sums: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[dict[str, float], list[float]]:
    """Factors of the marks, each from the grid in turn until none changes, and the coefficients with them."""

    def loss(marks: dict[str, float]) -> float:
        x = design(sums @ factors_of(marks), n)
        w = np.array(fit_logistic(x, y))
        z = np.clip(x @ w, -30, 30)
        held = sum(np.log(marks[m] / PRIORS[m]) ** 2 for m in PRIORS)
        return float(np.sum(np.log1p(np.exp(-z)) + (1 - y) * z) + 0.5 * np.sum(w[1:] ** 2) + PRIOR_STRENGTH * held)

    used = {m for m, bit in PATTERN.items() if sums[:, [i for i in range(N_PATTERNS) if i & bit]].any()}
    marks, best = dict(PRIORS), loss(PRIORS)
    for _ in range(3):
        before = dict(marks)
        for m in sorted(used):
            for value in GRID:
                if (new := loss(marks | {m: value})) < best - 1e-9:
                    marks, best = marks | {m: value}, new
        if marks == before:
            break
    return marks, fit_logistic(design(sums @ factors_of(marks), n), y)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Newton's method; the constant isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(shrink), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def terms(text: str) -> Counter:
    """How often each word (``=word``) and each beginning of a longer word occurs."""
    words = Counter(t for t in _TOKEN.findall(text.lower()) if len(t) > 1)
    out = Counter()
    for w, n in words.items():
        out["=" + w] += n
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k]] += n
    return out


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """term, texts, uses, over all rows (text); only the wanted terms if given."""
    sent = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, uses = Counter(), Counter()
            for value in batch.column("text"):
                found = terms(value.as_py())
                if sent is not None:
                    found = Counter({t: n for t, n in found.items() if t in sent.value})
                texts.update(found.keys())
                uses.update(found)
            names = list(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([texts[t] for t in names], pa.int64()), pa.array([uses[t] for t in names], pa.int64())],
                names=["term", "texts", "uses"],
            )

    counts = rows.select("text").mapInArrow(run, "term string, texts bigint, uses bigint")
    return counts.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("uses").alias("uses"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    known = labels.where(f"`{label_col}` is not null").groupBy(F.col(id_col).alias("l_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = bounded_sample(known.where(fold("l_id") != HELD_OUT), "l_id", sample_rows, SAMPLE_SEED)
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(chosen, F.col("id") == F.col("l_id"))
    alike = F.sha2(F.btrim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    sample = sample.groupBy(alike.alias("like"), "label").agg(F.min(F.struct("id", "text"))["text"].alias("text"))
    sample = written(sample.select("text", "label"), "toxicity-sample")
    size = {r["label"]: (r["texts"], r["n"]) for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    if not (size.get(0) and size.get(1)):
        return Grammar()
    toxic = _counted(sample.where("label = 1"), None).where(F.col("texts") >= LEAST_TEXTS)
    toxic = {r["term"]: (r["texts"], r["uses"]) for r in toxic.orderBy(F.desc("texts"), "term").limit(MOST_TERMS).collect()}
    other = {r["term"]: (r["texts"], r["uses"]) for r in _counted(sample.where("label = 0"), set(toxic)).collect()}
    most_used: dict[str, int] = {}
    for term, (_, uses) in toxic.items():
        for k in BEGINNINGS:
            if term[0] == "=" and len(term) - 1 > k:
                most_used[term[1 : k + 1]] = max(uses, most_used.get(term[1 : k + 1], 0))
    weights = {}
    for term, (texts, uses) in toxic.items():
        if term[0] != "=" and len(term) < OWN_BEGINNING and uses - most_used.get(term, 0) < LEAST_TEXTS:
            continue  # one word's beginning
        if term.removeprefix("=") in _CLASSES:
            continue  # the grammar's own
        clean_texts, clean_uses = other.get(term, (0, 0))
        by_use = np.log((uses + 0.1) / size[1][1]) - np.log((clean_uses + 0.5) / size[0][1])
        by_text = np.log((texts + 0.1) / size[1][0]) - np.log((clean_texts + 0.5) / size[0][0])
        if min(by_use, by_text) >= LEAST_WEIGHT:
            weights[term] = float(min(by_use, by_text, MOST_WEIGHT))
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"f{i}" for i in range(N_PATTERNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar(sent.value)
        for batch in batches:
            found = [reader.patterns(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[i] for x, _ in found], pa.float64()) for i in range(N_PATTERNS)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([n for _, n in found], pa.int64()), *columns], names=["label", "n", *names])

    read = sample.select("label", "text").mapInArrow(run, "label int, n bigint, " + ", ".join(f"{x} double" for x in names))
    rows = read.toPandas().sort_values(["label", "n", *names])
    return Grammar(weights, *learn(rows[names].to_numpy(), rows["n"].to_numpy(), rows["label"].to_numpy()))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grammar: Grammar | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    grammar = grammar or train(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast((grammar.weights, grammar.marks, grammar.coefficients))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar(*sent.value)
        for batch in batches:
            scores = [reader.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
