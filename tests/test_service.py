from pathlib import Path

from pyspark.sql import functions as F

from treelight.plans.service import Config, ContentConfig, Namespace, frame, frames, load_config
from treelight.sources import snapshot


def test_service(spark, make_tree):
    e = make_tree([(1, 10, 5, "work", True), (2, 11, 10, "harvest.txt", False), (3, 12, 10, "other.txt", False)])
    texts = spark.createDataFrame([("C", 2, "text", "ripe plums in a bowl"), ("C", 3, "text", "nothing")], "drive string, slot long, status string, text string")
    n = Namespace(e, texts=texts)
    assert n.handle({"op": "ping"}) == {"ok": {"version": 1}}
    assert n.handle({"op": "status"})["ok"]["volumes"][0]["files"] == 4
    got = n.handle({"op": "search", "args": {"q": "*.txt", "sort": "bad"}})["ok"]
    assert [r["path"] for r in got["results"]] == ["C:\\work\\harvest.txt", "C:\\work\\other.txt"]
    got = n.handle({"op": "search", "args": {"q": "txt content:plums"}})["ok"]
    assert (got["total_matched"], got["results"][0]["snippet"], got["content"]["scanned"]) == (1, "ripe plums in a bowl", 2)
    assert n.handle({"op": "search", "args": {"q": "  "}})["error"]["code"] == 1
    assert n.handle({"op": "nope"})["error"]["code"] == 1
    n.config = Config(content=ContentConfig(enabled=False))
    assert n.handle({"op": "search", "args": {"q": "content:x"}})["error"]["code"] == 1


def test_service_scans_files(spark, make_tree, tmp_path):
    """Contents come from the files of the window; sizes above the limit aren't opened; drives that are being built are listed."""
    (tmp_path / "work").mkdir()
    for name, body in (("one.txt", "nothing here"), ("two.txt", "a plum, and a second plum"), ("big.txt", "plum " * 500)):
        (tmp_path / "work" / name).write_text(body)
    e = make_tree([(1, 10, 5, "work", True), *((i + 2, 20 + i, 10, n, False) for i, n in enumerate(["one.txt", "two.txt", "big.txt", "gone.txt"]))])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    to_uri = lambda p: F.concat(F.lit(f"file:{tmp_path}/"), F.replace(F.substring(p, 4, 1000), F.lit("\\"), F.lit("/")))
    n = Namespace(e, files=files, to_uri=to_uri, config=Config(content=ContentConfig(max_file_bytes=1000)), building={"E": 70})
    got = n.handle({"op": "search", "args": {"q": "txt content:PLUM"}})["ok"]
    assert [(r["path"], r["content_matches"]) for r in got["results"]] == [("C:\\work\\two.txt", 2)]
    assert got["content"] == {"scanned": 2, "skipped_size": 1, "skipped_binary": 0, "errors": 1, "truncated": False, "timed_out": False}
    assert [(v["drive"], v["phase"], v["files"]) for v in n.handle({"op": "status"})["ok"]["volumes"]] == [("C", "ready", 6), ("E", "building", 70)]
    assert n.drives() == ["C"]


def test_frames_and_config():
    data = frame({"op": "ping"}) + frame({"q": "é"})
    assert list(frames(data + b"\x05\0\0")) == [{"op": "ping"}, {"q": "é"}]
    assert load_config("= nothing").max_limit == 1000
    assert load_config("poll_ms = 40\n[content]\ntimeout_ms = 7").content.timeout_ms == 100


def test_snapshot(spark, make_tree, tmp_path):
    e = make_tree([(1, 10, 5, "work", True)])
    volumes = spark.createDataFrame([("C", "ready", 7, 500), ("X", "building", 1, 1)], "drive string, phase string, journal_id long, next_usn long")
    assert snapshot.load(spark, str(tmp_path / "none")) is None
    snapshot.save(e, volumes, str(tmp_path / "s"))
    entries, kept = snapshot.load(spark, str(tmp_path / "s"))
    assert entries.count() == 2 and [r["drive"] for r in kept.collect()] == ["C"]
    (tmp_path / "s" / "CURRENT").write_text('{"magic": "other"}')
    Path(tmp_path / "s" / ".CURRENT.crc").unlink(missing_ok=True)
    assert snapshot.load(spark, str(tmp_path / "s")) is None
