"""A loopback HTTP gateway to the request contract, guarded by a token."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from treelight.plans.search import DEFAULT_LIMIT, SORTS
from treelight.plans.service import BAD_REQUEST, INTERNAL, NOT_READY, UNAUTHORIZED


PREFIX = "/api/v1"
#: HTTP status of the contract's error codes.
STATUS = {BAD_REQUEST: 400, NOT_READY: 500, INTERNAL: 500, UNAUTHORIZED: 401}


def given_token(target: str, headers) -> str:
    """From X-Token, a bearer token, or token= in the address."""
    bearer = headers.get("Authorization", "")
    query = parse_qs(urlsplit(target).query).get("token", [""])[-1]
    return headers.get("X-Token") or (bearer.removeprefix("Bearer ") if bearer.startswith("Bearer ") else "") or query


def _number(text: str | None, default: int) -> int:
    """A whole number that isn't negative, else the default."""
    return int(text) if text and text.isascii() and text.isdigit() else default


def to_request(target: str) -> dict | None:
    """GET /api/v1/status and /api/v1/search?q=&limit=&offset=&sort=&match_path= as a request; None for other paths.

    The routes without /api/v1, and /ping, are answered as well."""
    url = urlsplit(target)
    op = url.path.removeprefix(PREFIX).strip("/")
    if op in ("ping", "status"):
        return {"op": op}
    if op != "search":
        return None
    args = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    sort = args.get("sort")
    return {
        "op": "search",
        "args": {
            "q": args.get("q", ""),
            "limit": _number(args.get("limit"), DEFAULT_LIMIT),
            "offset": _number(args.get("offset"), 0),
            "sort": sort if sort in SORTS else "none",
            "match_path": args.get("match_path", "").lower() in ("1", "true"),
        },
    }


def serve(handle, token: str, port: int = 0, snapshot=None) -> ThreadingHTTPServer:
    """A server on 127.0.0.1, not started yet; handle answers requests, snapshot (if given) POST /snapshot."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            if hmac.compare_digest(given_token(self.path, self.headers).encode(), token.encode()):
                return True
            self._answer(401, {"code": UNAUTHORIZED, "message": "missing or wrong token"})
            return False

        def do_GET(self) -> None:
            if self._allowed():
                request = to_request(self.path)
                if request is None:
                    return self._answer(404, {"code": BAD_REQUEST, "message": "no such path"})
                answer = handle(request)
                if "error" in answer:
                    return self._answer(STATUS.get(answer["error"]["code"], 500), answer["error"])
                self._answer(200, answer["ok"])

        def do_POST(self) -> None:
            if self._allowed():
                if snapshot is None or urlsplit(self.path).path.removeprefix(PREFIX) != "/snapshot":
                    return self._answer(404, {"code": BAD_REQUEST, "message": "no such path"})
                self._answer(200, {"version": snapshot()})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
