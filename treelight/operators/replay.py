"""Exact ordered replay of changes, one volume per task.

Deleting a directory takes its subtree along, and ids can be used again, so a volume's changes can't be reordered: they are
applied one after the other, volumes in parallel. A task reads its volumes' changes in Arrow batches, sorted by position, so its
memory follows the live nodes, not the journal. The same class serves batch replay here and the streaming state.

A volume that lives on from batch to batch bounds what waits, as the contract has it (MOST_PENDING entries, MOST_TRIES batches,
MOST_RENAMES ids); `dropped` counts what these bounds let go. A replay of a whole journal is one batch, at any length: nothing is
tried before its end, and nothing is let go.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROOT_FRN = 5
MOST_PENDING, MOST_TRIES, MOST_RENAMES = 100_000, 600, 4096
REBUILD_DELETED, REBUILD_SHARE = 1024, 20
SCHEMA = "drive string, slot bigint, frn bigint, parent_frn bigint, name string, is_dir boolean"


class Volume:
    """Live nodes of one volume, and what waits: entries without a parent, ids between an old and a new name."""

    def __init__(self, drive: str, state: str | None = None, bounded: bool = True):
        self.drive, self.bounded = drive, bounded
        if state is None:
            self.nodes: dict[int, list] = {ROOT_FRN: [0, None, f"{drive}:", True]}  # frn: slot, parent, name, is_dir
            self.next_slot, self.deleted, self.dropped = 1, 0, 0
            pending: list[list] = []
            self.renames: set[int] = set()
        else:
            x = json.loads(state)
            self.nodes = {int(k): v for k, v in x["nodes"].items()}
            self.next_slot, self.deleted, self.dropped, pending, self.renames = x["next_slot"], x["deleted"], x["dropped"], x["pending"], set(x["renames"])
        self._set_pending(pending)
        self.children: dict[int, set[int]] = {}
        for frn, (_, parent, _, _) in self.nodes.items():
            if parent is not None:
                self.children.setdefault(parent, set()).add(frn)

    def _set_pending(self, entries: list[list]) -> None:
        """Waiting entries (frn, parent, name, is_dir, tries) by their place in the order, and each id's places."""
        self.pending: dict[int, list] = dict(enumerate(entries))
        self.next_place = len(entries)
        self.places: dict[int, list[int]] = {}
        for place, entry in self.pending.items():
            self.places.setdefault(entry[0], []).append(place)

    def dump(self) -> str:
        x = {"nodes": self.nodes, "next_slot": self.next_slot, "deleted": self.deleted, "dropped": self.dropped, "pending": list(self.pending.values()), "renames": sorted(self.renames)}
        return json.dumps(x)

    @property
    def needs_rebuild(self) -> bool:
        return self.deleted > REBUILD_DELETED and self.deleted * REBUILD_SHARE > self.next_slot

    def take_rebuild(self) -> bool:
        """Whether the volume should be built anew; asking renumbers the slots of what lives and clears the flag."""
        if not self.needs_rebuild:
            return False
        for slot, frn in enumerate(sorted(self.nodes, key=lambda x: self.nodes[x][0])):
            self.nodes[frn][0] = slot
        self.next_slot, self.deleted = len(self.nodes), 0
        return True

    def _place(self, frn: int, parent: int) -> None:
        old = self.nodes[frn][1]
        if old is not None:
            self.children.get(old, set()).discard(frn)
        self.nodes[frn][1] = parent
        self.children.setdefault(parent, set()).add(frn)

    def insert(self, frn: int, parent: int, name: str, is_dir: bool) -> bool:
        """False if the parent isn't there."""
        if frn == ROOT_FRN:
            return True
        if parent not in self.nodes:
            return False
        if frn not in self.nodes:
            self.nodes[frn] = [self.next_slot, None, name, is_dir]
            self.next_slot += 1
        self.nodes[frn][2:] = [name, is_dir]
        self._place(frn, parent)
        return True

    def delete(self, frn: int) -> None:
        if frn == ROOT_FRN or frn not in self.nodes:
            return
        self.children.get(self.nodes[frn][1], set()).discard(frn)
        stack = [frn]
        while stack:
            x = stack.pop()
            if self.nodes.pop(x, None) is not None:
                self.deleted += 1
            stack.extend(self.children.pop(x, ()))

    def _wait(self, frn: int, parent: int, name: str, is_dir: bool) -> None:
        if self.bounded and len(self.pending) >= MOST_PENDING:
            self.dropped += 1
            return
        self.pending[self.next_place] = [frn, parent, name, is_dir, 0]
        self.places.setdefault(frn, []).append(self.next_place)
        self.next_place += 1

    def event(self, op: str, frn: int, parent: int, name: str, is_dir: bool) -> None:
        if op == "delete":
            self.renames.discard(frn)
            for place in self.places.pop(frn, ()):
                self.pending.pop(place, None)
            self.delete(frn)
        elif op == "rename_old":
            self.renames.add(frn)
        elif op == "rename_new" and frn in self.renames:
            self.renames.discard(frn)
            if frn in self.nodes and frn != ROOT_FRN:
                if parent in self.nodes:
                    self.nodes[frn][2] = name
                    self._place(frn, parent)
                else:
                    self._wait(frn, parent, name, is_dir)
        elif op in ("create", "rename_new") and not self.insert(frn, parent, name, is_dir):
            self._wait(frn, parent, name, is_dir)

    def end_batch(self) -> None:
        """After the events of a batch: one try for each waiting entry, in order."""
        left = []
        for entry in self.pending.values():
            if not self.insert(*entry[:4]):
                entry[4] += 1
                if entry[4] < MOST_TRIES or not self.bounded:
                    left.append(entry)
                else:
                    self.dropped += 1
        self._set_pending(left)
        if self.bounded and len(self.renames) > MOST_RENAMES:
            self.dropped += len(self.renames)
            self.renames.clear()

    def apply(self, batch: Iterable[tuple]) -> None:
        """Events (op, frn, parent_frn, name, is_dir) in order; an empty batch is no batch."""
        any_event = False
        for event in batch:
            any_event = True
            self.event(*event)
        if any_event:
            self.end_batch()

    def rows(self) -> pd.DataFrame:
        rows = sorted((slot, frn, parent, name, is_dir) for frn, (slot, parent, name, is_dir) in self.nodes.items())
        out = pd.DataFrame(rows, columns=["slot", "frn", "parent_frn", "name", "is_dir"]).astype({"parent_frn": "Int64"})
        out.insert(0, "drive", self.drive)
        return out


def replay(events: DataFrame, batch_events: int | None = None, drives: tuple[str, ...] = ()) -> DataFrame:
    """The live entries after all events (drive, usn, op, frn, parent_frn, name, is_dir). A volume's whole journal is one batch
    without bounds; with batch_events, batches end after so many events and keep the bounds, as in the stream. The volumes of
    drives have their root without events, too."""
    columns = ["drive", "op", "frn", "parent_frn", "name", "is_dir"]

    def live(volume: Volume) -> Iterator[pa.RecordBatch]:
        rows = volume.rows()
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[c], t, from_pandas=True) for c, t in zip(rows.columns, types, strict=True)], names=list(rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, n = None, 0
        for batch in batches:
            for drive, *event in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if volume is None or drive != volume.drive:
                    if volume is not None:
                        volume.end_batch()
                        yield from live(volume)
                    volume, n = Volume(drive, bounded=batch_events is not None), 0
                elif batch_events and n and n % batch_events == 0:
                    volume.end_batch()
                if event[0] is not None:
                    volume.event(*event)
                    n += 1
        if volume is not None:
            volume.end_batch()
            yield from live(volume)

    rows = events.select("usn", *columns)
    if drives:
        opened = events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, drives))).alias("drive"))
        rows = rows.unionByName(opened, allowMissingColumns=True)
    ordered = rows.repartition("drive").sortWithinPartitions("drive", "usn")
    return ordered.select(*columns).mapInArrow(run, SCHEMA)


def paired_renames(events: DataFrame) -> DataFrame:
    """The rename_new events, with paired: whether the id's last other event but creations was its rename_old. Only an id's own
    events decide, so this is dealt by id, not by volume."""
    before = F.lag("op").over(Window.partitionBy("drive", "frn").orderBy("usn"))
    rows = events.where("op <> 'create'").withColumn("paired", F.coalesce(before == "rename_old", F.lit(False)))
    return rows.where("op = 'rename_new'")
