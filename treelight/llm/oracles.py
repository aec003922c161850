"""DuckDB equivalents of the queries that SQL can express, built from the same tables of thresholds and texts."""

from __future__ import annotations

from treelight.llm import license_scan, quality_rules


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EXACT_DEDUP = """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h
"""


def quality() -> str:
    """Repeated words by numbering words and counting windows; the thresholds come from the table of rules."""
    stop_words = ", ".join(_text(w) for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws}))
    fails = []
    for r in quality_rules.RULES:
        measure = r.measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")
        sides = [f"({measure}) < {r.least}"] * (r.least is not None) + [f"({measure}) > {r.most}"] * (r.most is not None)
        fails.append(f"coalesce({' OR '.join(sides)}, false) AS fails_{r.name}")
    names = [f"fails_{r.name}" for r in quality_rules.RULES]
    return rf"""
WITH w AS (
    SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), g AS (SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
d AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1) GROUP BY k),
m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
           len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
           len(list_filter(ws, lambda x: lower(trim(x, {_text(quality_rules._EDGE_PUNCTUATION)})) IN ({stop_words}))) AS n_stop_words,
           len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
           len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•‣]\s'))) AS n_bullet_lines
    FROM w LEFT JOIN covered USING (k)
), f AS (SELECT *, n_words < {quality_rules.BASE_MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed, {', '.join(fails)} FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {' OR '.join(names)}) AS kept, {', '.join(names)} FROM f
"""


def _canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), {_text(license_scan.COPYRIGHT_LINE)}, ' ', 'g')"
    for pattern, spelling in license_scan.EQUIVALENT:
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(spelling.replace('$1', chr(92) + '1'))}, 'g')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def licenses() -> str:
    known = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in license_scan.TEXTS + license_scan.notices())
    return rf"""
WITH known AS (SELECT sha256({_canonical('t')}) AS d, min(i) AS i FROM (VALUES {known}) AS v(i, t) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT k, doc_id, {_canonical('t')} AS x, t FROM docs),
lines AS (SELECT k, unnest(regexp_split_to_array(t, '\r\n|\r|\n')) AS l FROM docs),
found AS (SELECT k, count(*)::BIGINT AS n, string_agg(DISTINCT i, ',' ORDER BY i) AS ids
          FROM (SELECT k, {_canonical('l')} AS x FROM lines WHERE regexp_matches(lower(l), {_text(license_scan.NOTICE_WORDS)})) JOIN known ON d = sha256(x) WHERE x <> '' GROUP BY k)
SELECT doc_id, CASE WHEN x <> '' THEN sha256(x) END AS text_digest, i AS license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(ids, '') AS notice_ids
FROM c LEFT JOIN known ON x <> '' AND d = sha256(x) LEFT JOIN found USING (k)
"""
