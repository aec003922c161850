"""Command line: search a snapshot, or show its status."""

from __future__ import annotations

import argparse
import json

from treelight.plans.service import Namespace
from treelight.session import local_session
from treelight.sources import snapshot


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="treelight")
    p.add_argument("snapshot")
    p.add_argument("op", choices=["search", "status", "ping"])
    p.add_argument("q", nargs="*")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--sort", default="none")
    p.add_argument("--match-path", action="store_true")
    a = p.parse_args(argv)
    loaded = snapshot.load(local_session(), a.snapshot)
    if loaded is None:
        print(json.dumps({"error": {"code": 2, "message": "no valid snapshot"}}))
        return 2
    entries, volumes = loaded
    args = {"q": " ".join(a.q), "limit": a.limit, "offset": a.offset, "sort": a.sort, "match_path": a.match_path} if a.op == "search" else {}
    answer = Namespace(entries, volumes.selectExpr("drive", "'ready' as phase")).handle({"op": a.op, "args": args})
    print(json.dumps(answer, ensure_ascii=False))
    return "error" in answer


if __name__ == "__main__":
    raise SystemExit(main())
