import io
import random
import zipfile

from pyspark.sql import functions as F

from treelight import queries
from treelight.functions.extract import decode_entities, decode_text, extract_text, office_text, strip_xml
from treelight.operators import content


def container(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_decode():
    assert decode_text(b"a\0b") is None
    assert decode_text(b"\xef\xbb\xbfhi") == "hi"
    assert decode_text(b"\xff\xfe" + "预".encode("utf-16-le") + b"x") == "预"
    assert decode_text(b"\xfe\xff" + "ok".encode("utf-16-be")) == "ok"
    assert decode_text(b"a\xffb") == "a\ufffdb"


def test_xml():
    assert strip_xml("<w:p>Tom &amp; <b>Jerry</b></w:p>a&lt;b") == "Tom & Jerrya<b"
    assert strip_xml("<![CDATA[a <b>raw & x]]> c") == "a <b>raw & x c"
    assert decode_entities("caf&eacute; &#20013; x&ampzz &#x4e2d;") == "caf&eacute; 中 x&ampzz 中"


def test_office():
    slides = {f"ppt/slides/slide{n}.xml": f"<a>{t}</a>" for n, t in ((1, "first slide"), (10, " &amp; last"), (2, "second"))}
    assert office_text(container(slides), "PPTX") == "first slidesecond & last"
    assert office_text(container({"word/document.xml": "<w>budget</w>"}), "docx") == "budget"
    assert office_text(b"not a zip", "docx") is None
    assert office_text(container({"other.xml": "x"}), "docx") is None


def test_extract(spark):
    rows = [(1, "docx", container({"word/document.xml": "<w>Q3 budget</w>"})), (2, "txt", b"a\0"), (3, "txt", None), (4, "docx", b"PK"), (5, None, b"plain")]
    got = spark.createDataFrame([(i, e, bytearray(b) if b is not None else None) for i, e, b in rows], "i int, ext string, content binary")
    got = [tuple(r[0]) for r in got.orderBy("i").select(extract_text(F.col("content"), F.col("ext"))).collect()]
    assert got == [("text", "Q3 budget"), ("binary", None), ("error", None), ("error", None), ("text", "plain")]


def snippet(text, needle, around=64):
    """By bytes, as the definition says."""
    data, at = text.encode(), len(text[: text.lower().index(needle)].encode())
    low, high = max(0, at - around), min(len(data), at + around)
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    body = " ".join(data[low:high].decode().split())
    return ("…" if data[:low].decode().split() else "") + body + ("…" if data[high:].decode().split() else "")


def test_scan(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab é文😀\n") for _ in range(draw.randint(0, 90))) + "Needle" + "".join(draw.choice("xy é文😀 ") for _ in range(draw.randint(0, 90))) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, "aaaa")], "i int, text string")
    got = {r["i"]: r for r in content.scan_text(rows, ["needle"]).collect()}
    assert [got[i]["snippet"] for i in range(60)] == [snippet(t, "needle") for t in texts]
    assert (got[100]["status"], got[101]["status"]) == ("error", "no_match")
    assert {r["i"]: r["content_matches"] for r in content.scan_text(rows, ["AA"]).collect()}[102] == 3


def test_content_snippet_covers_every_text(spark, tmp_path):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab é文😀\n") for _ in range(draw.randint(0, 90))) + "Idiot" + "".join(draw.choice("xy é文😀 ") for _ in range(draw.randint(0, 90))) for _ in range(40)]
    texts += ["plain idiot text", "nobody", "é nobody", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["snippet"] for r in queries.QUERIES["content_snippet"](spark, str(tmp_path)).collect()}
    assert got == {i: snippet(t, "idiot") for i, t in enumerate(texts) if t and "idiot" in t.lower()}


def test_content_window_is_the_production_default(spark, tmp_path):
    ids = [i for i in range(10_000) if "5" in str(i)][:2500]
    for name, n in (("few", 600), ("many", 2500)):
        rows = [(i, "the thing" if i % 2 else "nothing", "en", "src1") for i in ids[:n]]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / name / "documents.parquet"))
        window = ids[: min(n, content.MOST_CANDIDATES)]
        assert tuple(queries.QUERIES["content_status_counts"](spark, str(tmp_path / name)).first()) == (len(window), 0, 0, 0, sum(i % 2 for i in window))
        assert queries.QUERIES["content_window_truncated"](spark, str(tmp_path / name)).first()["truncated"] == (n > content.MOST_CANDIDATES)
    tiny = spark.createDataFrame([("D", s, s == 1) for s in range(6)], "drive string, slot long, is_dir boolean")
    assert [r["slot"] for r in content.candidates(tiny, 3).orderBy("slot").collect()] == [0, 2]


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the Q3 budget fox")
    (tmp_path / "b.txt").write_text("x" * 500)
    (tmp_path / "c.bin").write_bytes(b"\0\0")
    (tmp_path / "d.docx").write_bytes(container({"word/document.xml": "<w>BUDGET</w>"}))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    wanted = spark.createDataFrame([(i, f"file:{tmp_path}/{n}") for i, n in enumerate(["a.txt", "b.txt", "c.bin", "d.docx", "gone.txt"])], "slot int, path string")
    scanned = content.scan_files(wanted, files, ["budget"], most_bytes=400)
    assert [r["status"] for r in scanned.orderBy("slot").collect()] == ["match", "skipped_size", "binary", "match", "error"]
    assert tuple(content.scan_info(scanned).first()) == (2, 1, 1, 1, 2)
    assert not content.timed_out(scanned)
    late = content.scan_files(wanted, files, ["budget"], most_bytes=400, deadline=1.0)
    assert content.timed_out(late) and tuple(content.scan_info(late).first()) == (0, 1, 0, 0, 0)
