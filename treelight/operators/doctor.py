"""A self-check of change ingestion: creates, renames and deletes an entry by journal records and reports each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelight.operators.replay import Volume
from treelight.sources import usn

STEPS = (("create", usn.REASON_CREATE, "probe.txt"), ("rename_old", usn.REASON_RENAME_OLD, "probe.txt"), ("rename_new", usn.REASON_RENAME_NEW, "moved.txt"), ("delete", usn.REASON_DELETE, "moved.txt"))


def doctor(spark: SparkSession) -> DataFrame:
    """step, ok: records are decoded and classified by Spark, then applied one by one."""
    raw = b"".join(usn.pack(1000, 5, i, reason, 0, name) for i, (_, reason, name) in enumerate(STEPS))
    events = usn.events(usn.decode(spark.createDataFrame([(bytearray(raw),)], "buffer binary"))).orderBy("usn").collect()
    volume, report = Volume("X"), [("decode", [e["op"] for e in events] == [s[0] for s in STEPS])]
    expected = {"create": "probe.txt", "rename_old": "probe.txt", "rename_new": "moved.txt", "delete": None}
    for e in events:
        volume.apply([(e["op"], e["frn"], e["parent_frn"], e["name"], e["is_dir"])])
        node = volume.nodes.get(1000)
        report.append((e["op"], (node[2] if node else None) == expected[e["op"]]))
    return spark.createDataFrame(report, "step string, ok boolean")
