"""Exact dedup, quality rules, license scans and source mix against brute force, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from treelight.llm import exact_dedup, license_scan, quality_rules, source_mix

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}

ODD = [
    (1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "SAME TEXT"), (5, "SAME TEXT"), (6, "ÉCOLE"), (7, "école"),
    (8, "a" * 70_000), (9, "A" * 70_000), (10, "a" * 69_999 + "b"), (None, "null id"), (11, " \t\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 0, "y", i) for i, t in ODD], "doc_id long, text string, digest string, len int, kept string, id long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        n = (t or "").translate(LOWER)
        ids = groups[n]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_exact_dedup(spark, odd, docs):
    for frame in (odd, docs):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        assert sorted(repr(tuple(r)) for r in exact_dedup.exact_dedup(frame).collect()) == brute_dedup(rows)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_rows(odd):
    kept = exact_dedup.dedup_rows(odd)
    assert kept.columns == odd.columns
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t in ODD})
    assert {r["doc_id"] for r in kept.collect()} == {5, 4, 6, 7, 9, 10, None, 11}


def test_exact_dedup_hashes_whole_texts_of_shared_keys_only(spark, docs):
    """In the plan of dedup_rows the hash of the text stands above the filter by surviving keys; exact_dedup hashes each text once."""
    plan = exact_dedup.dedup_rows(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    digest = [i for i, line in enumerate(plan) if "sha2(" in line]
    known = [i for i, line in enumerate(plan) if "Filter" in line and "getbit" in line]
    assert digest and known and max(digest) < max(known)
    assert sum("sha2(" in line for line in exact_dedup.exact_dedup(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 0


def test_exact_dedup_with_few_bits(spark, monkeypatch):
    """Keys that share a bit change nothing; a third of the rows are one text."""
    monkeypatch.setattr(exact_dedup, "MOST_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "ROW_BITS", 8)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    want = {}
    for i, t in rows:
        want[t] = max(i, want.get(t, 0))
    assert {r["doc_id"] for r in exact_dedup.dedup_rows(frame).collect()} == set(want.values())
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_dedup(frame).collect()} == {(i, want[t]) for i, t in rows}


def test_exact_dedup_of_repeats_that_differ_elsewhere(spark):
    """Which of two rows with one id stays doesn't depend on the partitions."""
    rows = [(1, "t", f"c{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, len string")
    assert len({exact_dedup.dedup_rows(frame.repartition(n, "len")).collect()[0]["len"] for n in (1, 3, 8)}) == 1


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, odd, docs):
    repeated = [(100, "a b c " * 40), (101, "x y z w " + " ".join(map(str, range(60)))), (102, "line one\nline one\n\n \nline two"), (103, "a b c\x0bd\x0ce f")]
    frame = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(repeated, "doc_id long, text string"))
    want = sorted(repr((r[0], *brute_quality(r[1]))) for r in frame.collect())
    got = quality_rules.quality(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert quality_rules.quality(frame.limit(0)).count() == 0
    clash = frame.selectExpr("*", "1 as n_words", "'x' as words", "2 as n_lines", "3 as kept")
    got = quality_rules.quality(clash).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert quality_rules.keep_good(clash).columns == clash.columns


def test_quality_keeps_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules.quality(docs).join(labels, "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() <= 0.01 * judged.where("quality = 1").count()
    assert judged.where("quality = 0 and kept").count() <= 0.2 * max(1, judged.where("quality = 0").count())
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs).count() == quality_rules.quality(docs).where("kept").count()


def test_licenses(spark, odd):
    mit = dict(license_scan.TEXTS)["MIT"]
    rows = [
        (1, "MIT Licence\n\nCopyright (c) 2020 Jane Doe\n\n" + license_scan._MIT_BODY.replace("\n", "\r\n").upper()),
        (2, mit + " and more"),
        (3, "Some text.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nreleased under the mit licence"),
        (4, "the license of nobody"),
        (5, None),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(1, 6)] == ["MIT", None, None, None, None]
    assert (got[3]["n_notices"], got[3]["notice_ids"]) == (3, "CC-BY-NC-4.0,MIT")
    assert (got[4]["n_notices"], got[5]["text_digest"]) == (0, None)
    assert license_scan.license_scan(odd).count() == len(ODD)
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_licenses_without_line_breaks(spark):
    one_line = " ".join(license_scan._MIT_BODY.split())
    bsd = " ".join((license_scan._BSD_HEAD + license_scan._BSD_TAIL).split())
    rows = [
        (1, "Copyright (c) 2020 Foo " + one_line),
        (2, "MIT License Copyright (c) 2020 Foo, Inc. " + one_line),
        (3, "Copyright 2019-2021 J. R. Doe <j@doe.org>. All rights reserved. " + bsd),
        (4, "Copyright (c) 2021 Foo. Released under the MIT License."),
        (5, "// Copyright Foo 2021, MIT License"),
        (6, "Copyright (c) 2021 Foo, Inc. All rights reserved.\n" + one_line),
        (7, "Copyright (c) 2021 MIT Licensing Board\n" + one_line),
        (8, "\u00a9 2020 Foo. SPDX-License-Identifier: MIT"),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(1, 9)] == ["MIT", "MIT", "BSD-2-Clause", "MIT", "MIT", "MIT", "MIT", "MIT"]
    assert [got[i]["notice_ids"] for i in (4, 5, 8)] == ["MIT"] * 3
    own = [("Own", "Do as you like with these words, friend.")]
    plain = spark.createDataFrame([(1, "intro\nDo as you like with these words, friend."), (2, None), (2, None)], "doc_id long, text string")
    plain = plain.selectExpr("*", "1 as lines", "'x' as found", "'y' as license_digest", "'z' as text_digest")
    assert sorted((r["doc_id"], r["notice_ids"]) for r in license_scan.license_scan(plain, texts=own).collect()) == [(1, "Own"), (2, ""), (2, "")]
    line = spark.createDataFrame([(1, "Copyright (c) 2020 Foo. Do as you like with these words, friend.")], "doc_id long, text string")
    assert license_scan.license_scan(line, texts=own).first()["license_id"] == "Own"


def test_long_licenses(spark):
    """Texts as Debian keeps them; where a machine has none of them, digests can't be tested."""
    from pathlib import Path

    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "CC0-1.0": "CC0-1.0", "MPL-2.0": "MPL-2.0"}
    texts = [(i, p.read_text()) for f, i in files.items() if (p := Path("/usr/share/common-licenses", f)).exists()]
    if not texts:
        pytest.skip("no licence texts here")
    rows = [*texts, *((i, " ".join(t.split())) for i, t in texts), *((None, t[: len(t) // 2]) for _, t in texts)]
    got = license_scan.license_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got] == [i for i, _ in rows]


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                free.discard(s)
        left = over
    return target


def test_mix(spark, docs):
    extra = [(9_000_001, None, "a b c d"), (9_000_002, "ünique", None), (9_000_003, None, "e " * 500), (9_000_003, None, "e " * 500), (9_000_004, "", "only")]
    frame = docs.select("doc_id", "source", "text").union(spark.createDataFrame(extra, "doc_id long, source string, text string"))
    rows = source_mix.mix(frame, shard_words=3000).collect()
    sizes = Counter()
    for r in frame.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    shards = Counter(s for s, _ in {(r["source"], r["shard"]) for r in rows})
    for s in sizes:
        assert abs(taken[s] - target[s]) <= source_mix.BLOCK_WORDS * (1 + shards[s])
    assert sorted(map(repr, rows)) == sorted(map(repr, source_mix.mix(frame.repartition(7), shard_words=3000).collect()))
    assert source_mix.mix(frame.limit(0)).count() == 0
    clash = frame.selectExpr("*", "1 as size", "'x' as shard", "2 as sid", "3 as target", "'r' as row", "4 as tie")
    assert sorted(map(repr, source_mix.mix(clash, shard_words=3000).collect())) == sorted(map(repr, rows))
    assert source_mix.mixed_rows(clash).columns == clash.columns


def sainte_lague(weights, seats):
    won = Counter()
    for _ in range(seats):
        won[min(weights, key=lambda s: (-weights[s] / (2 * won[s] + 1), s))] += 1
    return won


def test_taken_words_by_brute_force(spark, docs):
    """Blocks to sources, to groups, to shards by listing quotients; then each shard's row of words from its start."""
    n_blocks, in_group = 64, 3
    rows = source_mix.mix(docs, shard_words=3000, group_shards=in_group).collect()
    sizes, targets, shard_sizes = {}, {}, defaultdict(Counter)
    for r in rows:
        sizes[r["source"]], targets[r["source"]] = r["source_size"], r["target"]
        shard_sizes[r["source"]][r["shard"]] += r["size"]
    by_source = sainte_lague(targets, int(sum(targets.values()) / n_blocks + 0.5))
    for source, shards in shard_sizes.items():
        groups = Counter()
        for shard, n in shards.items():
            groups[shard // in_group] += n
        by_group = sainte_lague(groups, by_source[source])
        for group in groups:
            members = {s: n for s, n in shards.items() if s // in_group == group}
            by_shard = sainte_lague(members, by_group[group])
            for shard, n in members.items():
                inside = [r for r in rows if (r["source"], r["shard"]) == (source, shard)]
                assert {r["shard_quota"] for r in inside} == {by_shard[shard]}
                quota = min(by_shard[shard] * n_blocks, 2 * n)
                assert sum(r["taken"] for r in inside) == quota
                rest = sorted(r["taken"] - quota // n * r["size"] for r in inside if r["size"]) if n else []
                assert sum(0 < r["taken"] - quota // n * r["size"] < r["size"] for r in inside if n) <= 1
                assert all(x >= 0 for x in rest)


def test_apportionment_is_sainte_lague(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.7, "e": 0.0}
    for seats in (1, 2, 7, 10, 97, 1000):
        won = Counter()
        for _ in range(seats):
            won[max(weights, key=lambda s: (weights[s] / (2 * won[s] + 1), [-ord(s)]))] += 1
        cells = spark.createDataFrame([(k, w, seats) for k, w in weights.items()], "k string, w double, seats long")
        got = {r["k"]: r["n_seats"] for r in source_mix.apportion(cells, [], ["k"], "w", "seats").collect()}
        assert got == {k: won[k] for k in weights}


def test_mixed_rows(docs):
    rows = source_mix.mixed_rows(docs, chars_col="n_chars").collect()
    taken = {r["doc_id"]: r["taken"] for r in source_mix.mix(docs).collect()}
    words, texts = Counter(), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["text"].strip() in texts[r["doc_id"]]
    assert words == Counter({i: n for i, n in taken.items() if n})
