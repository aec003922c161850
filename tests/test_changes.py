import json

import duckdb
import pytest

import __spark_entry__ as entry
from treelight.operators.replay import Volume, replay
from treelight.sources import usn
from treelight.streaming.changes import live_entries
from treelight.streaming.supervisor import JournalGone, supervise

SCHEMA = "drive string, usn long, op string, frn long, parent_frn long, name string, is_dir boolean"


def names(volume):
    return {x[2] for x in volume.nodes.values()}


def test_flow():
    v = Volume("C")
    v.apply([("create", 10, 5, "work", True), ("create", 11, 10, "a.txt", False)])
    v.apply([("rename_old", 11, None, None, None), ("rename_new", 11, 10, "renamed.txt", False)])
    assert names(v) == {"C:", "work", "renamed.txt"}
    v.apply([("delete", 10, None, None, None)])
    assert names(v) == {"C:"}
    assert v.deleted == 2


def test_orphans_and_renames():
    v = Volume("C")
    v.apply([("create", 20, 21, "kid", False)])
    assert names(v) == {"C:"}
    v = Volume("C", v.dump())
    v.apply([("create", 21, 5, "dad", True)])
    assert names(v) == {"C:", "dad", "kid"}
    v.apply([("rename_new", 30, 5, "lone", False), ("rename_old", 31, None, None, None), ("rename_new", 31, 5, "missing", False)])
    assert "lone" in names(v) and "missing" not in names(v)
    v.apply([("create", 40, 41, "never", False), ("delete", 40, None, None, None), ("create", 41, 5, "late", True)])
    assert "never" not in names(v)
    assert json.loads(v.dump())["pending"] == []


def test_replay_and_stream_agree(spark, tmp_path):
    rows = [(d, i, *e) for d in "CD" for i, e in enumerate([("create", 10, 5, "work", True), ("create", 12, 11, "kid", False), ("create", 11, 10, "dad", True), ("rename_old", 12, None, None, None), ("rename_new", 12, 5, "moved", False), ("delete", 10, None, None, None), ("create", 10, 5, "again", True)])]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {(r["drive"], r["frn"], r["name"]) for r in replay(frame, batch_events=7).collect()}
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live_entries(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select drive, frn, name from live l where batch = (select max(batch) from live m where m.drive = l.drive)")
    assert {tuple(r) for r in last.collect()} == want


def test_long_journal_equals_sql(spark, tmp_path):
    """More events than a batch once had, more waiting entries than a stream keeps: files of 110000 groups wait, half of the
    directories come before event 500000, half after it, and new entries between and after them."""
    con = duckdb.connect()
    con.sql("""create view events as select i as event_id, case when i < 110000 then 5 * i + 1 when i < 440000 then 5 * (i % 1000) + 2
          when i < 495000 then 10 * (i - 440000) when i < 505000 then 1000000 + 5 * i else 10 * (i - 505000) + 5 end as user_id,
          case when i between 110000 and 439999 then 'view' else 'signup' end as event_type from range(560000) t(i)""")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = entry.queries()["replay_live_set"](spark, str(tmp_path)).toArrow()
    want = con.sql(entry.oracle_sql()["replay_live_set"]).to_arrow_table().select(got.column_names)
    assert got.num_rows == 230001
    assert got.sort_by("slot").to_pydict() == want.sort_by("slot").to_pydict()


def test_journal_without_changes_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create view events as select i as event_id, i as user_id, 'error' as event_type from range(3) t(i)")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = entry.queries()["replay_live_set"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.sql(entry.oracle_sql()["replay_live_set"]).fetchall() == [("J", 0, 5, None, "J:", True)]


def test_bounds_of_a_stream_only():
    rows = [("create", i, 9, "x", False) for i in range(100, 100_101)]
    for bounded, dropped in ((True, 1), (False, 0)):
        v = Volume("C", bounded=bounded)
        v.apply(rows)
        v.apply([("create", 9, 5, "dad", True)])
        assert (v.dropped, len(v.nodes)) == (dropped, 100_003 - dropped)


def test_records(spark):
    good = usn.pack((5 << 48) | 100, (5 << 48) | 5, 7, usn.REASON_CREATE, usn.ATTRIBUTE_DIRECTORY, "文件")
    meta = usn.pack(3, 5, 8, usn.REASON_CREATE, 0, "$x")
    both = usn.pack(101, 5, 9, usn.REASON_CREATE | usn.REASON_DELETE, 0, "b")
    buffers = [(bytearray(good + meta),), (bytearray(both + b"\x01" * 5),), (bytearray(usn.pack(1, 1, 1, 1, 0, "z", major=3)),), (bytearray(good[:-6]),), (None,)]
    rows = usn.decode(spark.createDataFrame(buffers, "buffer binary"))
    got = sorted(tuple(r) for r in usn.events(rows).collect())
    assert got == [(7, "create", 100, 5, "文件", True), (9, "create", 101, 5, "b", False)]
    assert tuple(usn.scan_counts(rows).first()) == (4, 2, 1)


def test_resume():
    live = (7, 100, 900)
    assert usn.resume((7, 500), live) == (7, 500)
    assert usn.resume((7, 500), (8, 100, 900)) is None
    assert usn.resume((7, 50), live) is None
    assert usn.resume((7, 5000), live) == (7, 900)


def test_enumeration_buffer():
    buffer = (12345).to_bytes(8, "little") + usn.pack(100, 5, 1, 0, usn.ATTRIBUTE_DIRECTORY, "dir") + usn.pack(101, 100, 2, 0, 0, "f.txt") + b"\0" * 16
    assert [(r[0], r[1], r[5]) for r in usn.records(buffer, 8)] == [(100, 5, "dir"), (101, 100, "f.txt")]


def test_supervisor():
    waits, outcomes = [], iter([OSError("busy"), OSError("busy"), JournalGone("gone"), None])

    def run(rebuild):
        seen.append(rebuild)
        x = next(outcomes)
        if x:
            raise x

    seen: list[bool] = []
    supervise(run, sleep=waits.append)
    assert seen == [False, False, False, True] and waits == [2.0, 2.0, 2.0]
    with pytest.raises(PermissionError):
        supervise(lambda rebuild: (_ for _ in ()).throw(PermissionError()), sleep=waits.append)
    waits.clear()
    with pytest.raises(OSError, match="still"):
        supervise(lambda rebuild: (_ for _ in ()).throw(OSError("still")), sleep=waits.append)
    assert len(waits) == 10
