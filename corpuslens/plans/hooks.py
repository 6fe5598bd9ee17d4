"""Events of a search for outside receivers: payloads, precedence, delivery."""

from __future__ import annotations

import os
import time
import urllib.parse
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hooks:
    """Receivers' addresses for the events of a search."""

    on_file: str | None = None
    on_match: str | None = None
    on_complete: str | None = None

    @classmethod
    def chosen(cls, request: Hooks, env: dict[str, str] | None = None) -> Hooks:
        """A request's addresses before the environment's, unless custom ones are disabled."""
        env = dict(os.environ) if env is None else env
        fixed = env.get("CORPUSLENS_DISABLE_CUSTOM_HOOKS", "").lower() in ("1", "true", "yes")
        pick = lambda k: (None if fixed else getattr(request, k)) or env.get(f"CORPUSLENS_HOOK_{k.upper()}_URL")
        return cls(*(pick(k) for k in ("on_file", "on_match", "on_complete")))

    def check(self, max_results: int | None) -> None:
        """Match events need a limit, as each one is a call."""
        if self.on_match and max_results is None:
            raise ValueError("on_match needs max_results")


def request_id() -> str:
    """A UUID that sorts by time (version 7)."""
    ms = time.time_ns() // 1_000_000
    value = (ms & (2**48 - 1)) << 80 | 7 << 76 | (uuid.uuid4().int >> 64 & 0xFFF) << 64 | 2 << 62 | uuid.uuid4().int & (2**62 - 1)
    return str(uuid.UUID(int=value))


def call(url: str, payload: dict, timeout: float = 3.0) -> bool:
    """One GET with the payload as query parameters; whether it succeeded."""
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(payload)}", timeout=timeout) as r:
            return 200 <= r.status < 300
    except (OSError, ValueError):
        return False


def match_events(matches: DataFrame, request: str) -> DataFrame:
    return matches.select(F.lit("match_found").alias("event"), F.lit(request).alias("request_id"), F.col("file").cast("string").alias("file_path"), "pattern", "offset", "line_no")


def file_events(matches: DataFrame, files: DataFrame, request: str) -> DataFrame:
    """A row for each file, those without matches included."""
    found = matches.groupBy(F.col("file").alias("f")).agg(F.count("*").alias("matches_count"))
    joined = files.join(found, F.col("path") == F.col("f"), "left")
    return joined.select(F.lit("file_scanned").alias("event"), F.lit(request).alias("request_id"), F.col("path").alias("file_path"), F.col("size").alias("file_size_bytes"), F.coalesce("matches_count", F.lit(0)).alias("matches_count"))


def deliver(events: DataFrame, url: str, timeout: float = 3.0) -> None:
    """Send a call for each row from the executors."""

    def send(rows) -> None:
        for r in rows:
            call(url, {k: v for k, v in (r.asDict() if isinstance(r, Row) else dict(r)).items() if v is not None}, timeout)

    events.foreachPartition(send)
