"""Change-journal records: packed version-2 records in binary buffers become rows, and rows become ordered events."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the record format: header layout and size, masks of ids, reasons and attributes.
HEADER = struct.Struct("<IHHQQqqIIIIHH")
FRN_MASK = 0x0000_FFFF_FFFF_FFFF
REASON_CREATE, REASON_DELETE, REASON_RENAME_OLD, REASON_RENAME_NEW = 0x100, 0x200, 0x1000, 0x2000
ATTRIBUTE_DIRECTORY = 0x10
FIRST_USER_FRN = 24

SCHEMA = "frn bigint, parent_frn bigint, usn bigint, reason bigint, attributes bigint, name string, major int"


def pack(frn: int, parent: int, usn: int, reason: int, attributes: int, name: str, major: int = 2) -> bytes:
    """One record, padded to eight bytes."""
    raw = name.encode("utf-16-le")
    size = (HEADER.size + len(raw) + 7) // 8 * 8
    return (HEADER.pack(size, major, 0, frn, parent, usn, 0, reason, 0, 0, attributes, len(raw), HEADER.size) + raw).ljust(size, b"\0")


def records(buffer: bytes, start: int = 0) -> Iterator[tuple]:
    """Rows of SCHEMA; records of other versions have only their version; stops at an empty or truncated length."""
    while start + 8 <= len(buffer):
        size, major = struct.unpack_from("<IH", buffer, start)
        if size == 0 or start + size > len(buffer):
            return
        if major != 2:
            yield None, None, None, None, None, None, major
        elif size >= HEADER.size:
            _, _, _, frn, parent, usn, _, reason, _, _, attributes, n, at = HEADER.unpack_from(buffer, start)
            if n % 2 == 0 and at + n <= size:
                name = buffer[start + at : start + at + n].decode("utf-16-le", "replace")
                yield frn & FRN_MASK, parent & FRN_MASK, usn, reason, attributes, name, major
        start += size


def decode(buffers: DataFrame, column: str = "buffer", header_bytes: int = 0) -> DataFrame:
    """A row for each record of each buffer. header_bytes: 8 for enumeration buffers, which begin with a cursor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 5 + [pa.string(), pa.int32()]
        for batch in batches:
            rows = [r for b in batch.column(column) if b.is_valid for r in records(b.as_py(), header_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return buffers.select(column).mapInArrow(run, SCHEMA)


def operation(reason: Column) -> Column:
    """The event of a reason: a new name before an old one before creation before deletion; null for none of them."""
    out = None
    for mask, op in ((REASON_RENAME_NEW, "rename_new"), (REASON_RENAME_OLD, "rename_old"), (REASON_CREATE, "create"), (REASON_DELETE, "delete")):
        hit = reason.bitwiseAND(mask) != 0
        out = F.when(hit, F.lit(op)) if out is None else out.when(hit, F.lit(op))
    return out


def events(rows: DataFrame) -> DataFrame:
    """usn, op, frn, parent_frn, name, is_dir of records that are events of user files."""
    return rows.where(f"major = 2 and frn >= {FIRST_USER_FRN}").select(
        "usn", operation(F.col("reason")).alias("op"), "frn", "parent_frn", "name", (F.col("attributes").bitwiseAND(ATTRIBUTE_DIRECTORY) != 0).alias("is_dir")
    ).where("op is not null")


def scan_counts(rows: DataFrame) -> DataFrame:
    """One row: records, events, other_versions."""
    event = (F.col("major") == 2) & (F.col("frn") >= FIRST_USER_FRN) & operation(F.col("reason")).isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(event).alias("events"), F.count_if(F.col("major") != 2).alias("other_versions"))


def resume(saved: tuple[int, int], live: tuple[int, int, int]) -> tuple[int, int] | None:
    """saved: (journal id, next position); live: (journal id, lowest valid, next). Where to go on, or None to rebuild."""
    journal, position = saved
    live_journal, lowest, following = live
    if journal != live_journal or position < lowest:
        return None
    return journal, min(position, following)
