"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule names a measure and the range it must stay in. ``measures`` computes the counts of a text with built-in
functions, ``compile_rules`` turns the table into columns; both stay in a single projection over the scan, so the
work is one pass without any shuffle, whatever the number of rows.

Defined results: a null or empty text has no words and fails the base rule; an empty table gives an empty result;
other columns are ignored whatever their names; repeated rows are judged each on its own;
a very long text is one row's work, its words and windows are in memory at once; there are no ties. Words of two 3-word
windows are equal by a 64-bit hash of the three words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import text_of, words_of

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "are", "this", "by", "from", "at", "or", "an", "not"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "est", "sur", "par", "avec", "pas", "au", "elle", "ou"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se", "no", "su", "al", "es", "lo", "como", "más"],
}


@dataclass(frozen=True)
class Rule:
    """name: of the rule; measure: an SQL expression over the columns of ``measures``; least, most: the range to stay in."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production thresholds. The base rule is the contract's; the others follow published web-text heuristics.
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
RULES = [
    Rule("mean_word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("words_with_a_letter", "n_letter_words / n_words", 0.7, None),
    Rule("stop_words_per_word", "n_stop_words / n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.3),
    Rule("lines_ending_in_ellipsis", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("lines_starting_with_bullet", "n_bullet_lines / n_lines", None, 0.9),
]

_HAS_WORD = r"[^\x20\x09-\x0D]"
_EDGE_PUNCTUATION = ".,;:!?\"'()"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and the counts that rules can use."""
    stop_words = sorted({w for words in STOP_WORDS.values() for w in words})
    text = text_of(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD)).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    windows = F.slice(
        F.transform(
            "words",
            lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
        ),
        F.lit(1),
        F.greatest(F.size("words") - 2, F.lit(0)),
    )
    sorted_windows = base.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("words", lambda w: F.lower(F.btrim(w, F.lit(_EDGE_PUNCTUATION))).isin(stop_words))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•‣]\s"))).cast("long").alias("n_bullet_lines"),
        F.sort_array(windows).alias("s"),
    )
    repeated = sorted_windows.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter(
                    "s",
                    lambda x, i: (F.get("s", i + 1)["h"] == x["h"]).eqNullSafe(True)
                    | (F.when(i > 0, F.get("s", i - 1)["h"]) == x["h"]).eqNullSafe(True),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("s")
    # a window at position p covers p, p + 1 and p + 2; one that starts d < 3 words after the last adds d words
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("at", i - 1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    counted = repeated.withColumn("n_repeat_words", covered.cast("long")).drop("at")
    # numbering rows keeps later filters above this projection; pushed below it, they would compute every count once for each use
    counts = F.struct(*[c for c in counted.columns if c != "doc_id"])
    return counted.select("doc_id", F.when(F.monotonically_increasing_id() >= 0, counts).alias("m")).select("doc_id", "m.*")


def base_failed() -> Column:
    return F.expr(f"n_words < {BASE_MIN_WORDS} or 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words")


def compile_rules(rules: list[Rule]) -> list[Column]:
    """A boolean column fails_<name> for each rule; a measure that can't be computed (no words, no lines) doesn't fail."""
    out = []
    for rule in rules:
        outside = [f"({rule.measure}) < {rule.least}D"] * (rule.least is not None) + [f"({rule.measure}) > {rule.most}D"] * (rule.most is not None)
        guarded = rule.measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")
        sql = " or ".join(x.replace(rule.measure, guarded) for x in outside) or "false"
        out.append(F.coalesce(F.expr(sql), F.lit(False)).alias(f"fails_{rule.name}"))
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then fails_<rule> columns."""
    rules = RULES if rules is None else rules
    judged = measures(docs, id_col, text_col).select("*", base_failed().alias("base_failed"), *compile_rules(rules))
    failed = [f"fails_{r.name}" for r in rules]
    kept = ~F.col("base_failed")
    for name in failed:
        kept = kept & ~F.col(name)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *failed
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that pass, with all their columns. The row travels through the projection beside the counts."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row"), F.col(text_col).alias("doc_text"))
    return quality(row, "doc_row", "doc_text", rules).where("kept").select("doc_id.*")
