import http.client
import json
import threading

from treelight.plans.gateway import serve, to_request


def test_requests():
    assert to_request("/search?q=a%20b&limit=x&offset=-1&sort=size&match_path=true")["args"] == {"q": "a b", "limit": 100, "offset": 0, "sort": "none", "match_path": True}
    assert to_request("/status") == {"op": "status"}
    assert to_request("/nope") is None


def test_server():
    seen = []
    server = serve(lambda r: seen.append(r) or ({"ok": {}} if r["op"] == "ping" else {"error": {"code": 1, "message": "no"}}), "secret", snapshot=lambda: "v1")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, token="secret", header="Authorization"):
        c = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=10)
        c.request(method, path, headers={header: f"Bearer {token}" if header == "Authorization" else token})
        r = c.getresponse()
        return r.status, json.loads(r.read())

    assert call("GET", "/ping") == (200, {})
    assert call("GET", "/ping", "wrong") == (401, {"code": 4, "message": "missing or wrong token"})
    assert call("GET", "/ping?token=secret", "", "X-None") == (200, {})
    assert call("GET", "/ping", "secret", "X-Token") == (200, {})
    assert call("GET", "/api/v1/search?q=") == (400, {"code": 1, "message": "no"})
    assert call("GET", "/api/v1/other")[0] == 404
    assert call("POST", "/api/v1/snapshot") == (200, {"version": "v1"})
    assert len(seen) == 4
    server.shutdown()


def test_doctor(spark):
    from treelight.operators.doctor import doctor

    assert all(r["ok"] for r in doctor(spark).collect())
