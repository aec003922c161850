"""The pipeline against a brute-force version of its stages, on a small table."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from treelight.llm import quality_rules, source_mix

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    lower = {c: c + 32 for c in range(65, 91)}
    good = {r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect()}
    newest = {}
    for i in sorted(good):
        newest[rows[i]["text"].translate(lower)] = i
    kept = sorted(newest.values())
    sets = {i: {tuple(w[k : k + 5]) for w in [rows[i]["text"].lower().split()] for k in range(max(1, len(w) - 4))} for i in kept}
    label = {i: i for i in kept}
    changed = True
    links = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    single = sorted(set(label.values()))
    mixed = source_mix.mix(docs.where(docs["doc_id"].isin(single))).where("taken > 0").collect()
    want = Counter({r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixed})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == want
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    whole = {i: len(library.encode(rows[i]["text"], add_special_tokens=False).ids) for i in want}
    cut = [r for r in got if r["n_tokens"] != whole[r["doc_id"]]]
    shards = len({(r["source"], r["shard"]) for r in mixed})
    assert len(cut) <= shards
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names the stages use inside."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality_rules.quality(documents).where("kept and n_words between 200 and 400").select("doc_id")
    good = next(r["text"] for r in documents.join(judged, "doc_id").orderBy("doc_id").collect() if r["text"].isascii())
    rows = [(1, good, "en", "s1"), (1, good, "en", "s1"), (2, good.swapcase(), None, None), (3, good + " more words follow", "en", None), (None, good + " and no id", "en", "s1")]
    rows += [(4, None, None, None), (5, "", "en", "s1"), (6, "x" * 100_000, "en", "s1"), (None, None, None, None)]
    frame = spark.createDataFrame([(i, t, g, s, len(t or ""), "k", 1, "r") for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, id int, row string")
    docs = frame
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == frame.columns, name
        kept[name] = sorted(r["doc_id"] or -1 for r in docs.collect())
    assert kept["quality_rules"] == [-1, 1, 1, 2, 3]
    assert kept["exact_dedup"] == [-1, 2, 3]
    assert kept["minhash_dedup"] == [-1, 2]
    assert set(kept["source_mix"]) <= {-1, 2}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept["source_mix"])
