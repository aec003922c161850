"""The request and response contract over one namespace: ping, status and search, names and contents."""

from __future__ import annotations

import json
import logging
import struct
import time
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.operators import content
from treelight.operators.paths import dir_paths, volume_status, with_paths
from treelight.plans.query import parse
from treelight.plans.search import MOST_LIMIT, SORTS, Options, clamp_limit, matched, page, totals
from treelight.sources.shared import written

log = logging.getLogger(__name__)

VERSION = 1
#: Error codes of the contract.
BAD_REQUEST, NOT_READY, INTERNAL, UNAUTHORIZED = 1, 2, 3, 4
MOST_FRAME = 4 << 20


@dataclass
class ContentConfig:
    enabled: bool = True
    max_candidates: int = 2000
    max_file_bytes: int = 8 << 20
    timeout_ms: int = 10_000
    max_concurrency: int = 4

    def __post_init__(self):
        clamp = lambda x, a, b: max(a, min(b, x))
        self.max_candidates = clamp(self.max_candidates, 1, 1_000_000)
        self.max_file_bytes = clamp(self.max_file_bytes, 1, 1 << 30)
        self.timeout_ms = clamp(self.timeout_ms, 100, 600_000)
        self.max_concurrency = clamp(self.max_concurrency, 1, 16)


@dataclass
class Config:
    drives: list[str] = field(default_factory=list)
    max_limit: int = MOST_LIMIT
    poll_ms: int = 100
    content: ContentConfig = field(default_factory=ContentConfig)


def load_config(text: str) -> Config:
    """From TOML; text that isn't TOML, or values of other kinds, give the defaults."""
    try:
        x = tomllib.loads(text)
        return Config(**{k: x[k] for k in ("drives", "max_limit", "poll_ms") if k in x}, content=ContentConfig(**{k: v for k, v in x.get("content", {}).items() if k in ContentConfig.__dataclass_fields__}))
    except (tomllib.TOMLDecodeError, TypeError):
        return Config()


def drive_letters(text: str) -> list[str]:
    """Letters of a list such as "C:, d e:" in order, once each."""
    return sorted({c.upper() for c in text if c.isascii() and c.isalpha()})


class Namespace:
    """entries, volumes (drive, phase), and for contents either the text of entries (drive, slot, status, text) or their files
    (binaryFile rows) with to_uri, which makes a file's address of an entry's path. building: drives still without a volume and the
    number of entries read so far."""

    def __init__(self, entries: DataFrame, volumes: DataFrame | None = None, texts: DataFrame | None = None, config: Config | None = None, files: DataFrame | None = None, to_uri: Callable[[Column], Column] | None = None, building: dict[str, int] | None = None):
        self.entries, self.volumes, self.texts, self.config = entries, volumes, texts, config or Config()
        self.files, self.to_uri, self.building = files, to_uri, building or {}
        self._paths: DataFrame | None = None

    @property
    def paths(self) -> DataFrame:
        if self._paths is None:
            self._paths = dir_paths(self.entries)
        return self._paths

    def handle(self, request: dict) -> dict:
        """One request, {"op": ..., "args": {...}}, to {"ok": ...} or {"error": {"code", "message"}}."""
        try:
            op, args = request["op"], request.get("args") or {}
            if op == "ping":
                return {"ok": {"version": VERSION}}
            if op == "status":
                return {"ok": self.status()}
            if op == "search":
                return {"ok": self.search(**args)}
            raise ValueError(f"unknown op {op}")
        except (KeyError, TypeError, ValueError) as e:
            return {"error": {"code": BAD_REQUEST, "message": str(e)}}
        except Exception as e:  # whatever a job failed of is answered, not thrown at the transport
            log.exception("request failed")
            return {"error": {"code": INTERNAL, "message": str(e)[:500]}}

    def status(self) -> dict:
        rows = volume_status(self.entries)
        phases = self.volumes.select("drive", "phase") if self.volumes is not None else rows.select("drive", F.lit("ready").alias("phase"))
        found = phases.join(rows, "drive", "left").collect()
        out = [{"drive": r["drive"], "phase": r["phase"], "files": r["files"] or 0, "deleted": r["deleted"] or 0, "memory": r["memory"] or 0, "needs_rebuild": bool(r["needs_rebuild"])} for r in found]
        there = {v["drive"] for v in out}
        out += [{"drive": d, "phase": "building", "files": n, "deleted": 0, "memory": 0, "needs_rebuild": False} for d, n in self.building.items() if d not in there]
        return {"volumes": sorted(out, key=lambda v: v["drive"])}

    def drives(self) -> list[str]:
        """Letters of all volumes in order."""
        return sorted(r["drive"] for r in self.entries.select("drive").distinct().collect())

    def search(self, q: str, limit: int = 100, offset: int = 0, sort: str = "none", match_path: bool = False) -> dict:
        if not q.strip():
            raise ValueError("q is empty")
        began = time.monotonic()
        query = parse(q)
        options = Options(clamp_limit(limit, self.config.max_limit), max(0, offset), sort if sort in SORTS else "none", match_path)
        if query.content_terms:
            out = self._contents(query, options)
        else:
            hits = page(self.entries, self.paths, query, options, self.volumes).collect()
            all_of = totals(self.entries, self.paths, query, options, self.volumes).first()
            out = {"results": [{"name": r["name"], "path": r["path"], "is_dir": r["is_dir"]} for r in hits], "total_matched": all_of["total_matched"]}
        return out | {"query_ms": int((time.monotonic() - began) * 1000)}

    def _contents(self, query, options: Options) -> dict:
        config = self.config.content
        if not config.enabled or self.texts is None and self.files is None:
            raise ValueError("content search is disabled")
        rows = matched(self.entries, self.paths, query, Options(match_path=options.match_path), self.volumes)
        window = content.candidates(rows, config.max_candidates)
        if self.files is not None:
            deadline = time.time() + config.timeout_ms / 1000
            placed = with_paths(F.broadcast(window.select(*self.entries.columns)), self.paths)
            placed = placed.withColumn("path", self.to_uri(F.col("path")) if self.to_uri else F.col("path"))
            scanned = content.scan_files(placed, self.files, query.content_terms, config.max_file_bytes, config.max_concurrency, deadline).drop("path")
        else:
            scanned = content.scan_text(window.select(*self.entries.columns).join(self.texts, ["drive", "slot"], "left").fillna({"status": "error"}), query.content_terms).drop("text")
        scanned = written(scanned, "scanned")
        info = content.scan_info(scanned).first().asDict()
        hits = with_paths(content.content_page(scanned, options.limit, options.offset), self.paths).orderBy("drive", "slot").collect()
        truncated = rows.where("not is_dir").count() > window.count()
        return {
            "results": [{"name": r["name"], "path": r["path"], "is_dir": False, "snippet": r["snippet"], "content_matches": r["content_matches"]} for r in hits],
            "total_matched": info.pop("total_matched"),
            "content": info | {"truncated": truncated, "timed_out": content.timed_out(scanned)},
        }


def frame(message: dict) -> bytes:
    """Four bytes of length, little-endian, then JSON."""
    body = json.dumps(message, ensure_ascii=False).encode()
    return struct.pack("<I", len(body)) + body


def frames(data: bytes) -> Iterator[dict]:
    """Messages of whole frames, one after the other."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if n > MOST_FRAME:
            raise ValueError("frame too large")
        if at + 4 + n > len(data):
            return
        yield json.loads(data[at + 4 : at + 4 + n])
        at += 4 + n
