"""The HTTP model client against a small server."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tamis.providers.http import HttpGenerator


class _Server(BaseHTTPRequestHandler):
    refuses = False

    def _send(self, code: int, body: dict) -> None:
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self._send(200, {"data": [{"id": "small"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.refuses and "response_format" in body:
            self._send(400, {})
        elif body["messages"][0]["content"] == "fail":
            self._send(500, {})
        else:
            self._send(200, {"choices": [{"message": {"content": f" {body['model']} ", "reasoning_content": "hm" if self.refuses else None}}]})

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_client(url, monkeypatch):
    assert HttpGenerator(url).generate("x") == "small"
    monkeypatch.setattr(_Server, "refuses", True)
    assert HttpGenerator(url, "other").generate("x") == "<think>\nhm\n</think>\nother"
    with pytest.raises(OSError):
        HttpGenerator(url, "m").generate("fail")
