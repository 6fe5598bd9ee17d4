"""HTTP service over the verbs, with tasks for long work and metrics."""

from __future__ import annotations

import json
import os
import platform
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from corpuslens.engine import Engine
from corpuslens.options import SearchOptions
from corpuslens.plans.hooks import Hooks
from corpuslens.plans.metrics import BUCKETS
from corpuslens.plans.stores import Tasks


class Metrics:
    """Counters and histograms of requests, in the Prometheus text form."""

    def __init__(self) -> None:
        self.lock, self.requests, self.buckets = threading.Lock(), Counter(), Counter()

    def record(self, endpoint: str, status: int, seconds: float) -> None:
        with self.lock:
            self.requests[endpoint, status] += 1
            for b in BUCKETS.get(f"{endpoint}_seconds", ()):
                self.buckets[endpoint, f"{b:g}"] += seconds <= b
            self.buckets[endpoint, "+Inf"] += 1

    def text(self) -> str:
        with self.lock:
            rows = [f'corpuslens_requests_total{{endpoint="{e}",status="{s}"}} {n}' for (e, s), n in sorted(self.requests.items())]
            rows += [f'corpuslens_seconds_bucket{{endpoint="{e}",le="{b}"}} {n}' for (e, b), n in sorted(self.buckets.items())]
        return "\n".join(rows) + "\n"


class Service:
    """Routes to (status, body); failures become the status that fits them."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.metrics, self.tasks = engine, Metrics(), Tasks(time.time, engine.options.ttl_s)

    def get(self, target: str) -> tuple[int, object]:
        parts = urlsplit(target)
        q = parse_qs(parts.query)
        one = lambda k, d=None: q[k][0] if k in q else d
        number = lambda k, d=None: int(q[k][0]) if k in q else d
        if parts.path in ("/", "/health"):
            return 200, {"status": "ok", "python": platform.python_version(), "spark": self.engine.spark.version, "system": platform.system(), "search_roots": [str(r) for r in self.engine.sandbox.roots]}
        if parts.path == "/metrics":
            return 200, self.metrics.text()
        if parts.path == "/v1/trace":
            limit = number("max_results")
            if limit is not None and limit < 1:
                raise ValueError("max_results must be positive")
            hooks = Hooks.chosen(Hooks(one("hook_on_file"), one("hook_on_match"), one("hook_on_complete")))
            return 200, self.engine.trace(self._paths(q), q.get("regexp") or self._missing("regexp"), SearchOptions(max_results=limit), hooks=hooks)
        if parts.path == "/v1/complexity":
            return 200, self.engine.check(one("regex") if "regex" in q else self._missing("regex"))
        if parts.path == "/v1/analyse":
            return 200, self.engine.analyse(self._paths(q))
        if parts.path == "/v1/samples":
            numbers = lambda k: [int(x) for x in one(k).split(",") if x.strip()] if k in q else None
            both = number("context", 3)
            return 200, self.engine.samples(self._paths(q)[0], lines=numbers("lines"), offsets=numbers("offsets"), before=number("before_context", both), after=number("after_context", both))
        if parts.path.startswith("/v1/tasks/"):
            task = self.tasks.by_id.get(parts.path.rpartition("/")[2])
            return (200, task) if task else (404, {"detail": "no such task"})
        return 404, {"detail": "no such endpoint"}

    def post(self, target: str, body: dict) -> tuple[int, object]:
        path = urlsplit(target).path
        if path not in ("/v1/compress", "/v1/index"):
            return 404, {"detail": "no such endpoint"}
        [source] = self.engine.sandbox.check([body.get("input_path") or body.get("path") or self._missing("path")])
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        self.tasks.sweep()
        try:
            task = self.tasks.create(source, path.rpartition("/")[2])
        except RuntimeError as e:
            return 409, {"detail": str(e)}

        def work() -> None:
            self.tasks.update(task["task_id"], "running")
            try:
                if task["operation"] == "compress":
                    result = self.engine.compress(source, body.get("output_path") or source)
                else:
                    result = {"index": self.engine.save_index(source, os.path.abspath(self.engine.options.cache_dir)), "path": source}
                self.tasks.update(task["task_id"], "completed", result=result)
            except Exception as e:  # noqa: BLE001  a task's failure is its result
                self.tasks.update(task["task_id"], "failed", error=str(e))

        threading.Thread(target=work, daemon=True).start()
        return 200, dict(task)

    @staticmethod
    def _missing(name: str):
        raise ValueError(f"missing: {name}")

    def _paths(self, q: dict[str, list[str]]) -> list[str]:
        return q.get("path") or self._missing("path")

    def answer(self, method: str, target: str, body: dict | None = None) -> tuple[int, object]:
        began = time.time()
        try:
            status, out = self.get(target) if method == "GET" else self.post(target, body or {})
        except FileNotFoundError as e:
            status, out = 404, {"detail": str(e)}
        except PermissionError as e:
            status, out = 403, {"detail": str(e)}
        except ValueError as e:
            status, out = 400, {"detail": str(e)}
        except Exception as e:  # noqa: BLE001
            status, out = 500, {"detail": str(e)[:500]}
        self.metrics.record(urlsplit(target).path.rpartition("/")[2] or "health", status, time.time() - began)
        return status, out


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, out: object) -> None:
            data = (out if isinstance(out, str) else json.dumps(out, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(out, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send(*service.answer("GET", self.path))

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                self._send(400, {"detail": "no JSON"})
                return
            self._send(*service.answer("POST", self.path, body))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str, port: int) -> None:
    server(engine, host, port).serve_forever()
