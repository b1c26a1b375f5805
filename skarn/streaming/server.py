"""The monitor's functions over HTTP, and its events over a WebSocket (RFC 6455)."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from skarn.streaming.api import Monitor

#: Fixed by RFC 6455.
ACCEPT = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
PING_SECONDS = 10.0
HEADERS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"}


def server(monitor: Monitor, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that answers in its own threads; call ``serve_forever`` to start and ``shutdown`` to end it."""
    read = {"status": monitor.status, "stats": monitor.stats, "files": monitor.files, "changes": monitor.changes}
    act = {"rescan": monitor.rescan, "pause": monitor.pause, "resume": monitor.resume}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_):
            pass

        def answer(self, body, code: int = 200) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            for name, value in {**HEADERS, "Content-Type": "application/json", "Content-Length": str(len(data))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def route(self, table: dict, other: dict) -> None:
            path = unquote(urlsplit(self.path).path)
            name = path.removeprefix("/api/v1/")
            if path == name:
                self.answer({"error": "not found"}, 404)
            elif name in table:
                self.answer(table[name]())
            elif table is read and name.startswith("file/"):
                self.answer(monitor.file(name.removeprefix("file/")))
            else:
                self.answer({"error": "method not allowed" if name in other else "not found"}, 405 if name in other else 404)

        def do_GET(self):
            if urlsplit(self.path).path == "/ws/events":
                self.events()
            else:
                self.route(read, act)

        def do_POST(self):
            self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self.route(act, read)

        def do_OPTIONS(self):
            self.answer({})

        def frame(self, kind: int, data: bytes) -> None:
            n = len(data)
            size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
            self.wfile.write(bytes([0x80 | kind]) + size + data)
            self.wfile.flush()

        def events(self) -> None:
            key = self.headers.get("Sec-WebSocket-Key")
            if not key:
                return self.answer({"error": "not a WebSocket request"}, 400)
            self.close_connection = True
            self.send_response(101)
            for name, value in {"Upgrade": "websocket", "Connection": "Upgrade", "Sec-WebSocket-Accept": base64.b64encode(hashlib.sha1((key + ACCEPT).encode()).digest()).decode()}.items():
                self.send_header(name, value)
            self.end_headers()
            queue, pinged = monitor.events.subscribe(), time.monotonic()
            try:
                while not found.closing:
                    while queue:
                        self.frame(1, json.dumps(queue.popleft()).encode())
                    if time.monotonic() - pinged > PING_SECONDS:  # shows a client that has gone
                        self.frame(9, b"")
                        pinged = time.monotonic()
                    time.sleep(0.05)
                self.frame(8, struct.pack(">H", 1001))
            except OSError:
                pass
            finally:
                monitor.events.unsubscribe(queue)

    class Server(ThreadingHTTPServer):
        daemon_threads = True
        closing = False

        def shutdown(self):
            self.closing = True
            super().shutdown()

    found = Server((host, port), Handler)
    return found
