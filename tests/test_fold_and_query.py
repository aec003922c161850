import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelight.functions.fold import extension, find, fold, fold_str, highlight, like_pattern, matches, under_dir, url_encode
from treelight.plans.query import parse

CASES = [
    ("Lake", "two lakeside huts", True),
    ("z山", "Z山z", True),
    ("über", "GRÜNÜBERALL", True),
    ("мост", "Старый МОСТ", True),
    ("*.Tsv", "rows.tsV", True),
    ("*.tsv", "rows.tsv~", False),
    ("h?t", "h山t", True),
    ("h?t", "ht", False),
    ("**", "", True),
    ("p*q*r", "p.q.s", False),
    ("*nan", "nanannan", True),
    ("山?川", "山と川", True),
    ("50%_!", "only 50%_! off", True),
    ("*_%!?", "q_%!r", True),
    ("ab*ba", "aba", False),
    ("*mid*", "amidst", True),
]


def test_patterns(spark):
    rows = spark.createDataFrame([(i, n) for i, (_, n, _) in enumerate(CASES)], "i int, name string")
    rows = rows.withColumn("f", fold(F.col("name")))
    picked = None
    for i, (p, _, _) in enumerate(CASES):
        hit = matches(F.col("f"), p)
        picked = F.when(F.col("i") == i, hit) if picked is None else picked.when(F.col("i") == i, hit)
    got = [r[0] for r in rows.orderBy("i").select(picked).collect()]
    assert got == [x for _, _, x in CASES]


def oracle(pattern, text):
    """Character-wise matching by dynamic programming."""
    if not any(c in pattern for c in "*?"):
        return fold_str(pattern) in fold_str(text)
    p, t = fold_str(pattern), fold_str(text)
    row = [True] + [False] * len(t)
    for c in p:
        new = [row[0] and c == "*"]
        for j, x in enumerate(t):
            new.append((new[j] or row[j + 1]) if c == "*" else row[j] and c in ("?", x))
        row = new
    return row[-1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("aA*?é文%_!\\ΣİK", max_size=5), st.lists(st.text("aAbÉé文%_!\\ςΣİKk", max_size=7), min_size=1, max_size=8))
def test_matches_like_the_oracle(spark, pattern, names):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r[0] for r in rows.orderBy("i").select(matches(fold(F.col("name")), pattern)).collect()]
    assert got == [oracle(pattern, n) for n in names]


def test_like_pattern():
    assert like_pattern("A*?%_!") == "a%_!%!_!!"


@pytest.mark.parametrize(
    ("q", "terms", "path_terms", "content", "drives"),
    [
        ("lake h: *.tsv", 2, 0, [], ["h"]),
        ("\u3000山\u2003hut\u00a0", 2, 0, [], []),
        ("*.tsv content:川", 1, 0, ["川"], []),
        ("CONTENT:Plum", 0, 0, ["Plum"], []),
        ("content:", 1, 0, [], []),
        (r"lake a\b.tsv H:\hut Z: h:", 1, 2, [], ["z", "h"]),
        ("x/", 0, 1, [], []),
        ("p\x1fq", 1, 0, [], []),
    ],
)
def test_parse(q, terms, path_terms, content, drives):
    got = parse(q)
    assert (len(got.terms), len(got.path_terms), got.content_terms, got.drives) == (terms, path_terms, content, drives)


def test_name_functions(spark):
    row = spark.createDataFrame([("Old Lake map", "山と川.tsv", "H:\\hut\\Roof\\y.tsv", ".profile", "bare")], "a string, b string, c string, d string, e string")
    got = row.select(
        find(F.col("a"), "lake"), find(F.col("b"), "川"), find(F.col("a"), ""), find(F.col("a"), "zz"),
        under_dir(F.col("c"), "h:\\HUT\\roof"), under_dir(F.col("c"), "h:\\hut\\roo"), under_dir(F.concat(F.lit("\\\\?\\"), "c"), "H:\\hut\\"),
        extension(F.col("d")), extension(F.col("e")), highlight(F.col("a"), "la* content:MAP"),
    ).first()
    assert tuple(got) == (4, 6, 0, None, True, False, True, "profile", "", "Old <mark>La</mark>ke <mark>map</mark>")
    assert url_encode("a b/é") == "a%20b%2F%C3%A9"
