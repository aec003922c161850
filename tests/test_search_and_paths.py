from treelight.operators import paths
from treelight.plans.search import Options, page, totals
from treelight.sources import volumes

TREE_A = [(1, 10, 5, "work", True), (2, 11, 10, "a.txt", False), (3, 12, 10, "sub", True), (4, 13, 12, "b.md", False), (5, 14, 5, "single.log", False)]
TREE_B = [(1, 10, 5, "work", True), (2, 11, 10, "notes.txt", False), (3, 12, 5, "notes.md", False)]


def test_paths(make_tree):
    e = make_tree(TREE_A)
    got = {r["frn"]: r["path"] for r in paths.with_paths(e, paths.dir_paths(e)).collect()}
    assert got == {5: "C:\\", 10: "C:\\work", 11: "C:\\work\\a.txt", 12: "C:\\work\\sub", 13: "C:\\work\\sub\\b.md", 14: "C:\\single.log"}


def test_deep_tree_and_cycle(make_tree):
    deep = [(i, 100 + i, 5 if i == 1 else 99 + i, f"d{i}", True) for i in range(1, 41)]
    e = make_tree([*deep, (90, 900, 901, "x", True), (91, 901, 900, "y", True)])
    p = {r["frn"]: (r["path"], r["depth"]) for r in paths.dir_paths(e).collect()}
    assert p[140] == ("C:\\" + "\\".join(f"d{i}" for i in range(1, 41)), 40)
    assert 900 not in p
    assert {r["frn"] for r in paths.orphans(e, paths.dir_paths(e)).collect()} == {900, 901}


def test_counts_by_path_terms(make_tree):
    e = make_tree(TREE_B)
    p = paths.dir_paths(e)
    n = lambda q, **o: totals(e, p, q, Options(**o)).first()["total_matched"]
    assert [n(q) for q in (r"work\notes", r"C:\work", r"notes\work", "notes", r"txt work" + "\\", "work")] == [1, 2, 0, 2, 1, 1]
    assert n("work", match_path=True) == 2
    assert n("") == 4
    assert n("d:") == 0


def test_paging(make_tree):
    e = make_tree([(i + 1, 100 + i, 5, f"file{i:03}.txt", i == 7) for i in range(300)])
    p = paths.dir_paths(e)
    got = [r["name"] for r in page(e, p, "file", Options(limit=10, offset=5, sort="name")).collect()]
    assert got == [f"file{i:03}.txt" for i in range(5, 15)]
    t = totals(e, p, "c:").first()
    assert (t["total_matched"], t["non_dir_matched"]) == (301, 299)
    assert page(e, p, "file", Options(limit=10, offset=400)).count() == 0


def test_subtree_validate_status(make_tree):
    e = make_tree(TREE_A)
    p = paths.dir_paths(e)
    assert {r["frn"] for r in paths.subtree(e, p, "C", 10).collect()} == {10, 11, 12, 13}
    assert tuple(paths.validate(e).first()) == ("C", 0, 0, 0, 0, 0)
    broken = make_tree([(1, 10, 77, "lost", False), (2, 10, 5, "twice", False), (3, 11, 5, None, False)])
    assert tuple(paths.validate(broken).first()) == ("C", 0, 0, 1, 1, 1)
    s = paths.volume_status(e).first()
    assert (s["files"], s["dirs"], s["deleted"], s["needs_rebuild"]) == (6, 3, 0, False)


def test_documents_without_language_or_source(spark, tmp_path):
    rows = [(1, "a", "en", "src1"), (2, "b", None, "src1"), (3, "c", "en", None), (4, "d", None, None), (5, "e", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    e = volumes.entries(spark, str(tmp_path), "D")
    got = {r["path"] for r in paths.with_paths(e, paths.dir_paths(e)).collect()}
    files = {f"D:\\{lang or '(none)'}\\{source or '(none)'}\\doc_{i:07}.txt" for i, _, lang, source in rows}
    assert {p for p in got if p.endswith(".txt")} == files
    assert len(got) == 5 + 1 + 2 + 4
    assert tuple(paths.validate(e).first()) == ("D", 0, 0, 0, 0, 0)


def test_empty(spark, make_tree):
    e = make_tree([]).limit(0)
    p = paths.dir_paths(e)
    assert page(e, p, r"a\b", Options()).count() == 0
    assert totals(e, p, "x").first()["total_matched"] == 0
