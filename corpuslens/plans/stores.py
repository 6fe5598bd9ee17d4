"""Request and task logs as tables: filters, counters, recency, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent(requests: DataFrame, limit: int = 100, include_completed: bool = True) -> DataFrame:
    """The most recently started requests."""
    rows = requests if include_completed else requests.filter("completed_at IS NULL")
    return rows.orderBy(F.desc("started_at"), "request_id").limit(limit)


def stats(requests: DataFrame) -> DataFrame:
    """(total, completed, in_progress)."""
    done = F.col("completed_at").isNotNull()
    return requests.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("in_progress"))


def evict(requests: DataFrame, limit: int, least: int = 100) -> DataFrame:
    """What stays once the oldest completed requests make room: a tenth, ``least`` at least."""
    total = requests.count()
    if total <= limit:
        return requests
    drop = max(least, total // 10)
    old = requests.filter("completed_at IS NOT NULL").orderBy("completed_at", "request_id").limit(drop).select(F.col("request_id").alias("__id"))
    return requests.join(old, F.col("request_id") == F.col("__id"), "left_anti")


def expire(rows: DataFrame, now, ttl_s: int = 3_600) -> DataFrame:
    """Rows that are unfinished or finished less than ``ttl_s`` ago."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("completed_at")
    return rows.filter(F.col("completed_at").isNull() | (age <= ttl_s))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "request_id") -> DataFrame:
    """Rows with those of the same key replaced by the changes."""
    return rows.join(changes.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti").unionByName(changes)


def hook_counters(events: DataFrame) -> DataFrame:
    """(event, success, failed) from (event, ok)."""
    return events.groupBy("event").agg(F.count_if(F.col("ok")).alias("success"), F.count_if(~F.col("ok")).alias("failed"))


def ranked_by_recency(requests: DataFrame, per: str) -> DataFrame:
    """Requests with their rank by start within each value of ``per``."""
    order = Window.partitionBy(per).orderBy(F.desc("started_at"), "request_id")
    return requests.withColumn("rank", F.row_number().over(order))


class Tasks:
    """Background tasks of one driver: queued, running, completed or failed; one a path."""

    def __init__(self, clock, ttl_s: int = 3_600) -> None:
        import threading

        self.clock, self.ttl_s, self.lock = clock, ttl_s, threading.Lock()
        self.by_id: dict[str, dict] = {}

    def create(self, path: str, operation: str) -> dict:
        import uuid

        with self.lock:
            if any(t["path"] == path and t["status"] in ("queued", "running") for t in self.by_id.values()):
                raise RuntimeError(f"a task for {path} is under way")
            task = {"task_id": str(uuid.uuid4()), "path": path, "operation": operation, "status": "queued", "started_at": self.clock(), "completed_at": None, "error": None, "result": None}
            self.by_id[task["task_id"]] = task
            return task

    def update(self, task_id: str, status: str, *, error: str | None = None, result: dict | None = None) -> None:
        with self.lock:
            t = self.by_id[task_id]
            t.update(status=status, error=error, result=result)
            if status in ("completed", "failed"):
                t["completed_at"] = self.clock()

    def sweep(self) -> int:
        """Forget tasks that finished longer ago than the time to live; how many."""
        with self.lock:
            old = [k for k, t in self.by_id.items() if t["completed_at"] is not None and (self.clock() - t["completed_at"]) > self.ttl_s]
            for k in old:
                del self.by_id[k]
            return len(old)
