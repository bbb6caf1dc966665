import http.client
import json
import socket
import threading

import pytest

from keystrata.http_api import handle, server


def call(store, method, target, body=None):
    return handle(store, method, target, json.dumps(body) if body is not None else b"")


@pytest.mark.parametrize(("method", "target", "body", "status"), [
    ("PUT", "/keys", {}, 400), ("PUT", "/keys", {"key": "k"}, 400), ("PUT", "/keys", {"key": "", "value": "v"}, 400), ("PUT", "/keys", {"value": "v"}, 400), ("PUT", "/keys", {"key": "k", "value": 5}, 500),
    ("GET", "/keys", None, 400), ("GET", "/keys?key=", None, 400), ("GET", "/keys/range?start_key=a", None, 400), ("GET", "/keys/range", None, 400), ("DELETE", "/keys", None, 400),
    ("POST", "/keys/batch", {}, 400), ("POST", "/keys/batch", {"keys": [], "values": []}, 400), ("POST", "/keys/batch", {"keys": "a", "values": "b"}, 400), ("POST", "/keys/batch", {"keys": ["a"], "values": ["b", "c"]}, 400),
    ("GET", "/nope", None, 404), ("POST", "/keys", None, 404), ("PUT", "/keys/", {"key": "k", "value": "v"}, 404),
])
def test_refusals(store, method, target, body, status):
    assert call(store, method, target, body)[0] == status
    assert store.manifest().version == 0


def test_life_of_keys(store):
    assert call(store, "PUT", "/keys", {"key": "k", "value": ""}) == (200, {"success": True})
    assert call(store, "GET", "/keys?key=k") == (200, {"key": "k", "value": ""})
    assert call(store, "GET", "/keys?key=none") == (200, {"key": "none", "value": None})
    assert call(store, "POST", "/keys/batch", {"keys": [f"item{i:02d}" for i in range(20)], "values": [str(i) for i in range(20)]}) == (200, {"success": True, "count": 20})
    assert [r["key"] for r in call(store, "GET", "/keys/range?start_key=item05&end_key=item10")[1]["results"]] == [f"item{i:02d}" for i in range(5, 10)]
    assert call(store, "DELETE", "/keys?key=item05") == (200, {"success": True})
    assert call(store, "GET", "/keys/range?start_key=item05&end_key=item06") == (200, {"results": [{"key": "item05", "value": None}]})


def test_query_comes_before_body_and_bad_json_is_no_body(store):
    store.put("a", "1")
    assert handle(store, "GET", "/keys?key=a", b'{"key": "b"}')[1]["key"] == "a"
    assert handle(store, "PUT", "/keys", b"{not json")[0] == 400


def test_over_a_socket_with_keep_alive(store):
    running = server(store)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    link = http.client.HTTPConnection(*running.server_address)
    for method, target, body, wanted in [("PUT", "/keys", '{"key": "k", "value": "値"}', {"success": True}), ("GET", "/keys?key=k", None, {"key": "k", "value": "値"}), ("GET", "/x", None, {"error": "nothing answers GET /x"})]:
        link.request(method, target, body.encode() if body else None)
        assert json.loads(link.getresponse().read()) == wanted
    running.shutdown()


@pytest.mark.parametrize(("length", "status"), [("-1", 400), ("abc", 400), ("1e3", 400), ("", 200), ("+5", 400), (str(1 << 40), 413)])
def test_lengths_that_cannot_be_read_end_the_connection(store, length, status):
    running = server(store)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    with socket.create_connection(running.server_address, timeout=10) as link:
        link.sendall(f"GET /keys?key=k HTTP/1.1\r\nHost: h\r\nContent-Length: {length}\r\n\r\n".encode())
        answer = link.recv(65536).decode()
        assert answer.startswith(f"HTTP/1.1 {status} ")
        assert ("Connection: close" in answer) == (status != 200)
    running.shutdown()
