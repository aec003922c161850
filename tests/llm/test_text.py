"""Secrets, languages, toxicity, pages, near duplicates and BPE against brute force, labels or round trips."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treelight.llm import bpe, html_extract, language_id, minhash_dedup, secret_scan, toxicity

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (5, "Ünï 😀 İ " * 3), (6, "x" * 200_000), (7, "1234 !?"), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, "h", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, h string, id int")


def test_base_secrets():
    spans = lambda t: [(secret_scan.KINDS[k], s, e) for s, k, e in secret_scan.base_spans(t)]
    assert spans('PassWord: "abcdef" ') == [("assign", 0, 17)]
    assert spans("token=abc api-key='12345'") == []
    assert spans("secret:token:abcdefgh") == []
    assert spans("x AKIA" + "A1" * 8 + " y") == [("access", 2, 22)]
    assert spans("AKIA12") == []
    h = "0123456789abcdef01234567"
    assert spans(f"token = {h}") == [("assign", 0, 32), ("hex", 8, 32)]
    assert spans("é" + h) == [("hex", 1, 25)]


def test_secret_models(spark, docs, odd):
    ratios = secret_scan.train(docs)
    table = ratios.tolist()
    draw = random.Random(99)
    found = sum(bool(secret_scan.model_spans("x " + "".join(draw.choices(secret_scan.ALPHABET[:62], k=32)) + " y", [], table)) for _ in range(200))
    assert found >= 190
    plain = ["internationalization_of_documents", "getUserAccountSettingsController", "einlichkeitverkeitach", "a_very_long_snake_case_identifier"]
    assert not any(secret_scan.model_spans(p, [], table) for p in plain)
    rows = {r["doc_id"]: r for r in secret_scan.secret_scan(odd, ratios=ratios).collect()}
    assert rows[1]["spans"] == "" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_language(spark, docs, odd):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    model = language_id.train(docs)
    rows = {r["doc_id"]: r for r in language_id.identify(odd, model=model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4
    assert rows[4]["lang_pred"] in ("de", "en", "es", "fr")
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in language_id.identify(odd).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_bit_sliced_filter_has_no_false_negatives():
    grams = {f"l{i:02}": language_id.ngrams([f"word{chr(97 + i % 26)} text number {chr(97 + i // 26)}"])[0] for i in range(70)}
    f = language_id.BitSlicedFilter(grams, None)
    for i, g in enumerate(f.languages):
        h = grams[g]
        assert f.corrected_counts(h, h.astype(int) * 0, 1)[0, i] > len(h) - 1


def test_toxicity(spark, odd):
    """Held-out rows of the larger table, language by language."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grammar = toxicity.train(docs, labels)
    got = toxicity.toxicity(docs, labels, grammar=grammar).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and toxic is not null").collect()
    for lang, least in (("en", 0.9), ("de", 0.85), ("fr", 0.85), ("es", 0.5)):
        toxic = [r["predicted"] for r in got if r["lang"] == lang and r["toxic"]]
        assert sum(toxic) >= least * len(toxic), lang
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 0.01 * len(got)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert (again.weights, again.marks, again.coefficients) == (grammar.weights, grammar.marks, grammar.coefficients)


def test_toxicity_of_odd_rows(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    clash = labels.selectExpr("*", "'x' as text", "1 as label", "2 as l_id", "3 as id").unionByName(labels.limit(5).selectExpr("cast(null as bigint) as doc_id", "quality", "1 as toxic", "'x' as text", "1 as label", "2 as l_id", "3 as id"))
    grammar = toxicity.train(docs, clash)
    rows = toxicity.toxicity(odd, clash, grammar=grammar).collect()
    assert len(rows) == len(ODD) and all(0 < r["score"] < 0.3 and r["predicted"] == 0 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in rows if r["doc_id"] == 4}) == 1


def test_toxicity_learns_from_texts_with_a_common_opening(spark):
    """Toxic texts that differ only after a long common passage all count; equal ones count once."""
    opening = "This passage opens every one of these texts and is longer than eighty characters in all. "
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    toxic = [(i, f"{opening}Number {i}: you zorgling.") for i in ids[:40]]
    clean = [(i, f"{opening}Number {i}: fine weather.") for i in ids[40:160]]
    same = [(i, "EQUAL  text: you blorbing" if i % 2 else "equal text: you blorbing ") for i in ids[160:190]]
    docs = spark.createDataFrame(toxic + clean + same, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic + same] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    grammar = toxicity.train(docs, labels)
    assert "=zorgling" in grammar.weights and "=blorbing" not in grammar.weights


def test_composition_equals_the_cascade():
    """Every sequence of five classes, read by the parts one after the other and by the automaton."""
    import itertools

    composed = toxicity.reduce(toxicity.compose, toxicity.COMPONENTS)
    for classes in itertools.product(range(8), repeat=5):
        states, state, number = [t.start for t in toxicity.COMPONENTS], composed.start, 0
        for c in classes:
            steps = [t.step(s, c) for t, s in zip(toxicity.COMPONENTS, states, strict=True)]
            states = [s for s, _ in steps]
            state, marks = composed.step(state, c)
            number, bits = toxicity.TABLE[number][c]
            assert marks == frozenset().union(*(m for _, m in steps))
            assert bits == sum(toxicity.PATTERN.get(m, 0) for m in marks)


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"=idiot": 4.0, "scum": 5.0})
    assert g.total("what an idiot") == 4.0
    assert g.total("you idiot") == g.total("idiot, you") == 6.0
    assert g.total("not an idiot") == pytest.approx(0.4)
    assert g.total("not one of them; an idiot") == 4.0
    assert g.total("he said what an idiot") == pytest.approx(1.2)
    assert g.total("he said; what an idiot") == pytest.approx(1.2)
    assert g.total("he said so. what an idiot") == 4.0
    assert g.total("I will kill time") == 0 and g.total("I will kill you") == 6.0
    assert g.total("scumbags") == 5.0 and g.total("idiots") == 0


def test_the_grammar_decides(spark):
    """Insults that are quoted or denied are labelled clean here, those at somebody toxic: only the grammar can tell them apart."""
    draw = random.Random(6)
    filler = lambda n: " ".join(f"w{draw.randint(0, 300)}x".translate({48 + i: 97 + i for i in range(10)}) for _ in range(n))
    rows = []
    for i in range(900):
        word = draw.choice(["zorgling", "blorber", "quankish"])
        said = [f"you {word}", f"someone said {word}", f"not {word}", "you", f"{word} you"][i % 5]
        rows.append((i, f"{filler(6)}. {said}. {filler(6)}", int(i % 5 in (0, 4))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    old = toxicity.LEAST_WEIGHT
    toxicity.LEAST_WEIGHT = 0.2
    try:
        grammar = toxicity.train(docs, labels)
    finally:
        toxicity.LEAST_WEIGHT = old
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.HELD_OUT]
    with_it = sum((grammar.score(t) >= 0.5) == bool(y) for t, y in held)
    flat = toxicity.Grammar(grammar.weights, dict.fromkeys(toxicity.PRIORS, 1.0))
    sums = [flat.patterns(t) for _, t, _ in rows]
    import numpy as np

    flat.coefficients = toxicity.fit_logistic(toxicity.design(np.array([s for s, _ in sums]) @ flat._factors, np.array([n for _, n in sums])), np.array([y for _, _, y in rows]))
    without = sum((flat.score(t) >= 0.5) == bool(y) for t, y in held)
    assert with_it - without >= 0.15 * len(held)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and so on, a long notice text.</div>
<article><header><h1>Head &amp; line</h1></header><p>First   <b>bold</b>text<br>next &lt;b&gt;</p><div class="ad">Buy</div><p>Be.</p>
<section id="comments"><article>Reader says</article></section></article><aside>Side</aside><form>Name</form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Head & line First boldtext next <b> Be."
    plain = "<body><div id=menu><a>One</a><a>Two</a></div><div><p>" + "Long enough text of the page. " * 5 + "</p><p>Tail.</p></div><div class='footer'>Foot</div>"
    assert html_extract.main_text(plain) == ("Long enough text of the page. " * 5).strip() + " Tail."
    assert html_extract.main_text("<article><p>cut off &am") == "cut off &am"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>a < b", "x"), (4, "u", "<p>" * 3000 + "deep", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), ("", 0), ("a < b", 5), ("deep", 4)]


def test_html_surges_decide_on_marked_pages():
    story = "A long story that fills its lines. " * 6
    card = "<article><p>Teaser.</p></article>"
    assert html_extract.main_text(f"<main><p>{story}</p></main><aside>x</aside>{card}") == f"{story}Teaser."
    assert html_extract.main_text(f"<div><p>{story}</p></div>{card}<p>Posted by us</p>") == f"{story}Teaser."
    links = "<div class=ad></div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
    assert html_extract.main_text(f"<article><p>{story}</p>{links}</article>") == story.strip()
    long_links = "<div class=ad></div><p><a href=a>" + "Linked words are text too. " * 4 + "</a></p>"
    assert html_extract.main_text(f"<article><p>{story}</p>{long_links}</article>").endswith("text too.")


def test_html_keeps_the_article():
    """Names that only seem to say that a part isn't main text, and parts of the article that must stay."""
    story = "A long story that fills its lines. " * 6
    text = story.strip()
    for wrapper in ("has-sidebar", "page with-sidebar", "no-header", "entry-content share", "layout-sidebar", "sidebar"):
        assert html_extract.main_text(f"<body><div class='{wrapper}'><article><p>{story}</p></article><div class='site-footer'>x</div></div></body>") == text, wrapper
    for wrapper in ("has-sidebar", "page with-sidebar", "no-header", "entry-content share"):
        assert html_extract.main_text(f"<body><div class='{wrapper}'><p>{story}</p></div></body>") == text, wrapper
    head = f"<article><h1 class='article-header'>Title</h1><p class='alert'>{story}</p><p>x <math><mi>y</mi></math></p><div class='notice'>gone</div></article>"
    assert html_extract.main_text(head) == f"Title {text} x y"
    assert html_extract.main_text(f"<div><p>{story}</p></div><div class=ad>Buy</div><p>The end.</p>") == f"{text} The end."
    assert html_extract.main_text("<p>One.</p><div class=ad>Buy</div><p>Two, longer.</p>") == "One. Two, longer."
    assert html_extract.main_text(f"<article><p hidden>no</p><p>{story}</p></article>") == text


def test_surges_and_dives_by_brute_force():
    draw = random.Random(9)
    for _ in range(300):
        weights = [draw.choice([0, 0, 0, 0, 1, 30, 90]) for _ in range(draw.randint(0, 25))]
        w = html_extract.WINDOW
        filled = [any(weights[i : i + w]) for i in range(len(weights))]
        surges = [i for i, x in enumerate(filled) if x and (i == 0 or not filled[i - 1])]
        dives = [i for i, x in enumerate(filled) if x and (i + 1 == len(filled) or not filled[i + 1])]
        want = []
        for a, b in zip(surges, dives, strict=True):
            first = min(i for i in range(a, len(weights)) if weights[i] > 0)
            want.append((first, b, max(sum(weights[i : i + w]) for i in range(a, b + 1))))
        assert html_extract.stretches(weights) == want


def test_html_of_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, page string"
    rows = [(1, "u", "<p>Same.</p>", "a", 1, "x"), (1, "u", "<p>Same.</p>", "a", 1, "x"), (None, None, "<article>" + "<p>word</p>" * 50_000 + "</article>", None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in html_extract.extract(frame).fillna(-1, ["page_id"]).fillna("", ["url"]).collect())
    assert got == [(-1, "", " ".join(["word"] * 50_000), 249_999), (1, "u", "Same.", 5), (1, "u", "Same.", 5)]
    assert html_extract.extract(frame.limit(0)).count() == 0


def brute_classes(rows):
    sets, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return {d: min(c) for c in classes.values() for d in c}


def test_near_dedup(spark):
    draw = random.Random(4)
    base = [[f"w{draw.randint(0, 500)}" for _ in range(n)] for n in (60, 120, 400, 30, 5, 3)]
    rows = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            w = list(b)
            for _ in range(edits):
                w[draw.randrange(len(w))] = f"e{draw.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One TWO"), (1004, "a b " * 5000), (1004, "a b " * 5000)]
    frame = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, key string, id int")
    got = minhash_dedup.near_dedup(frame).collect()
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["class_size"]) for r in minhash_dedup.near_dedup(frame.limit(3).union(spark.createDataFrame([(None, "a b c d e f", "k", 0)] * 2, frame.schema))).where("class_id is null").collect()} == {(None, 2)}
    assert minhash_dedup.near_dedup(frame.limit(0)).count() == 0
    kept = minhash_dedup.keep_one(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_near_dedup_in_a_crowd(spark):
    """Copies of one text, each with edits of its own: most pairs are just below the threshold, and links run through a few."""
    draw = random.Random(1)
    rows = []
    for i in range(400):
        w = [f"w{k}" for k in range(120)]
        for _ in range(draw.randint(2, 4)):
            w[draw.randrange(120)] = f"e{draw.random()}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_candidates_are_all_links_and_few_others(spark):
    """Against brute force over a crowd: no link of different classes is lost, and the pairs listed are of the order of the links."""
    import numpy as np

    draw = random.Random(2)
    sets = {0: frozenset(range(1, 151))}
    for i in range(1, 600):
        start, length = draw.randint(1, 130), draw.randint(0, 36)
        sets[i] = sets[0] - set(range(start, start + length)) | {1000 * i + k for k in range(draw.randint(0, 6))} | set(draw.sample(range(500, 540), 3))
    contents = [(i, bytearray(b"".join(int(x).to_bytes(8, "little")[: minhash_dedup.HASH_BYTES] for x in sorted(s)))) for i, s in sets.items()]
    unpacked = minhash_dedup._unpacked(bytes(contents[1][1]))
    assert len(np.unique(unpacked)) == len(sets[1])
    frame = spark.createDataFrame(contents, "id long, h binary")
    pairs = spark.createDataFrame([(0, i, i % 3, 3) for i in range(1, 600)], "hub long, id long, part int, parts int")
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {i for i in sets if jaccard(0, i) >= 0.8}
    found = minhash_dedup._differences(pairs, frame)
    assert {r["id"] for r in found.where("similarity >= 0.8").collect()} == near - {0}
    placed = found.withColumn("label", F.when(F.col("similarity") >= 0.8, F.lit(0)).otherwise(F.col("id"))).withColumn("outside", F.col("similarity") < 0.8)
    got = {(r["a"], r["b"]) for r in minhash_dedup._candidates(placed, 0.8).collect()}
    links = {(a, b) for a in range(1, 600) for b in range(a + 1, 600) if not (a in near and b in near) and jaccard(a, b) >= 0.8}
    assert links and links <= got and len(got) <= 2 * len(links)


def test_near_dedup_recall_on_documents(spark, docs):
    """All pairs of the table by an inverted index, against the classes; copies count as well."""
    from collections import Counter, defaultdict

    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in docs.collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in rows if w}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    links = []
    for d, s in sets.items():
        common = Counter(o for x in s for o in holders[x] if o < d)
        links += [(d, o) for o, n in common.items() if n >= 0.8 * (len(s) + len(sets[o]) - n)]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_dedup(docs).collect()}
    assert len(links) > 100
    assert sum(got[a] == got[b] for a, b in links) >= 0.999 * len(links)
    members = defaultdict(list)
    for d, c in got.items():
        members[c].append(d)
    neighbours = defaultdict(set)
    for a, b in links:
        neighbours[a].add(b)
        neighbours[b].add(a)
    assert all(neighbours[d] for c in members.values() if len(c) > 1 for d in c if sets.get(d))


def test_near_dedup_with_repeated_lines(spark):
    """Near copies of which one repeats a passage 50 or 300 times: every pair is found."""
    rows = []
    for i in range(60):
        words = [f"p{i}w{j}" for j in range(104)]
        repeated = words + words[:34] * (50 if i % 2 else 300) + [f"p{i}end{j}" for j in range(12)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(repeated))]
    got = minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {d: d - d % 2 for d, _ in rows}


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(21, 121, dtype=np.uint64)
    w = np.where(a % 3 == 0, 3.0, 1.0)
    v = np.where(b % 3 == 0, 3.0, 1.0)
    r = minhash_dedup.prob_minhash([minhash_dedup.mix64(a), minhash_dedup.mix64(b)], [w, v], 4000)
    p, q = dict(zip(a.tolist(), w, strict=True)), dict(zip(b.tolist(), v, strict=True))
    exact = sum(1 / sum(max(p.get(x, 0) / p[d], q.get(x, 0) / q[d]) for x in p.keys() | q.keys()) for d in p.keys() & q.keys())
    assert abs((r[0] == r[1]).mean() - exact) < 0.04


def test_bpe_equals_the_library(spark, odd):
    library = Tokenizer.from_file(VOCABULARY)
    draw = random.Random(8)
    parts = ["a", "ing", " the", "  ", "\n", "é", "'s", "1", "?!", "<|endoftext|>", "😀", "　", "zz", "---", "\x1c"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 80))) for _ in range(200)] + ["ab" * 5000, "aeinrst" * 900, " " * 3000]
    frame = spark.createDataFrame([*((100 + i, t) for i, t in enumerate(texts)), *ODD[:-1]], "doc_id long, text string")
    for r in bpe.encode_table(frame, VOCABULARY, with_ids=True).join(frame.distinct(), "doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_table(odd.limit(0), VOCABULARY).count() == 0


def test_stream_equals_whole():
    v = bpe.Vocabulary(VOCABULARY)
    lookahead = bpe.sufficient_lookahead(v)
    draw = random.Random(2)
    for alphabet in ("ab", "etaoin", "-=", "xyzthe"):
        data = "".join(draw.choices(alphabet, k=40_000)).encode()
        s = bpe.StreamingEncoder(v, lookahead)
        out = [t for i in range(0, len(data), 777) for t in s.feed(data[i : i + 777])]
        assert len(s.held) <= s.window
        assert out + s.finish() == v.encode(data)


def test_unbroken_texts_stream():
    codec, library = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    n = 3 * bpe.SLICE_CHARS
    for text in ("ab" * n, "x1-" * n, " " * n + "é" * n + "end of it", "\n" * 2 * n, "a b" + "語" * n):
        lists = list(codec.encode(text))
        ids = [t for part in lists for t in part]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert max(map(len, lists)) <= 4 * bpe.SLICE_CHARS < len(text.encode())
        assert "".join(codec.decode(iter(lists))) == text


def test_decoder_is_incremental():
    c = bpe.Codec(VOCABULARY, 64)
    ids = [i for p in c.encode("naïve 😀 文") for i in p]
    parts = list(c.decode([i] for i in ids))
    assert "".join(parts) == "naïve 😀 文" and "" in parts
    assert "".join(c.decode([[c.vocabulary.byte_ids[0xF0]], [c.vocabulary.byte_ids[0x41]]])) == "�A"
    assert re.search(r"�", "".join(c.decode([[c.vocabulary.byte_ids[0xE2]]])))
