"""Logs, metrics, hooks, complexity, streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import complexity, scalars
from corpuslens.functions.patterns import Patterns
from corpuslens.operators import frames, profile
from corpuslens.operators.trace import scanner_events, to_scanner_events, trace
from corpuslens.plans import metrics, stores
from corpuslens.plans.hooks import Hooks, file_events, request_id
from corpuslens.sources.lines import lines_of
from corpuslens.streaming import events


def lines(spark, text):
    return lines_of(spark.createDataFrame([("f", text)], "file string, body string"), "file", "body")


@pytest.mark.parametrize("text,want", [("x" * 10 + "\n" + "y" * 20, (2, 0, 15.0, 15.0, 20)), ("a\n\n \nbb\n", (4, 2, 1.5, 1.5, 2))])
def test_profile(spark, text, want):
    r = profile.profile(lines(spark, text)).first()
    assert (r["line_count"], r["empty_line_count"], r["line_length_avg"], r["line_length_median"], r["line_length_max"]) == want


def test_line_hook_and_custom_aggregates(spark):
    rows = lines(spark, "a 1\nb 2\nc\n")
    assert profile.profile(rows, digits=F.count_if(F.col("line").rlike("[0-9]"))).first()["digits"] == 2
    hook = lambda pdf: pd.DataFrame({"file": [pdf["file"].iloc[0]], "n": [int(pdf["line"].str.len().sum())]})
    assert profile.with_line_hook(rows, hook, "file string, n long").first()["n"] == 7


def test_scanner_events_round_trip(spark):
    found = trace(lines(spark, "xx error\nfine"), Patterns.of(spark, ["error"]), with_submatches=True)
    back = scanner_events(to_scanner_events(found).unionByName(spark.createDataFrame([("broken",)], "value string"))).collect()
    assert [(r["file"], r["line_no"], r["offset"], r["line"], [tuple(s) for s in r["submatches"]]) for r in back] == [("f", 1, 0, "xx error", [("error", 3, 8)])]


def test_frames(spark):
    sizes = spark.createDataFrame([("f", 0, 100, 1000, 50), ("f", 1, 150, 1500, 50), ("f", 2, 120, 1200, 50)], "file string, frame int, compressed_size long, decoded_size long, lines long")
    placed = frames.place_lines(frames.place_frames(sizes))
    assert [tuple(r) for r in placed.orderBy("frame").select("compressed_offset", "decoded_offset", "first_line", "last_line").collect()] == [(0, 0, 1, 50), (100, 1000, 51, 100), (250, 2500, 101, 150)]
    ask = lambda *v: spark.createDataFrame([("f", x) for x in v], "file string, value long")
    assert sorted((r["value"], r["frame"]) for r in frames.of_lines(placed, ask(1, 50, 51, 150, 151)).collect()) == [(1, 0), (50, 0), (51, 1), (150, 2)]
    assert sorted((r["value"], r["frame"]) for r in frames.of_offsets(placed, ask(999, 1000, 3699)).collect()) == [(999, 0), (1000, 1), (3699, 2)]
    assert frames.summary(placed).first()["lines"] == 150


def test_stores(spark):
    rows = spark.createDataFrame([(str(i), f"2024-01-01 00:00:{i:02d}", f"2024-01-01 00:01:{i:02d}" if i % 2 else None) for i in range(20)], "request_id string, started_at string, completed_at string").select("request_id", F.col("started_at").cast("timestamp").alias("started_at"), F.col("completed_at").cast("timestamp").alias("completed_at"))
    assert tuple(stores.stats(rows).first()) == (20, 10, 10)
    assert [r["request_id"] for r in stores.recent(rows, 2).collect()] == ["19", "18"]
    assert stores.evict(rows, limit=10, least=3).count() == 17
    assert stores.expire(rows, "2024-01-01 00:01:10", ttl_s=5).count() == 10 + 8
    change = rows.filter("request_id = '3'").withColumn("completed_at", F.lit(None).cast("timestamp"))
    assert stores.stats(stores.upsert(rows, change)).first()["completed"] == 9
    now = [0.0]
    tasks = stores.Tasks(lambda: now[0], ttl_s=10)
    t = tasks.create("/a", "index")
    with pytest.raises(RuntimeError):
        tasks.create("/a", "index")
    tasks.update(t["task_id"], "completed", result={})
    now[0] = 11
    assert tasks.sweep() == 1 and tasks.create("/a", "index")


def test_metrics_and_hooks(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (7.0,), (None,)], "v double")
    assert {r["le"]: r["n"] for r in metrics.histogram(rows, "v", (1.0, 5.0)).collect()} == {"1": 2, "5": 2, "+Inf": 3}
    seen, observation = metrics.observed(rows, n=F.count("*"))
    seen.collect()
    assert observation.get["n"] == 4
    hooks = Hooks.chosen(Hooks(on_file="http://a"), {"CORPUSLENS_HOOK_ON_FILE_URL": "http://b", "CORPUSLENS_HOOK_ON_COMPLETE_URL": "http://c"})
    assert (hooks.on_file, hooks.on_match, hooks.on_complete) == ("http://a", None, "http://c")
    with pytest.raises(ValueError):
        Hooks(on_match="http://x").check(None)
    assert request_id() < request_id() or len(request_id()) == 36
    files = spark.createDataFrame([("f", 3), ("g", 4)], "path string, size long")
    got = file_events(trace(lines(spark, "e\ne"), Patterns.of(spark, ["e"])), files, "r")
    assert {r["file_path"]: r["matches_count"] for r in got.collect()} == {"f": 2, "g": 0}


def test_complexity_report(spark):
    r = {x["regex"]: x for x in complexity.report(spark.createDataFrame([("(a+)+",), (".*.*.*",), ("^ab$",), ("(x",)], "regex string")).collect()}
    assert r["(a+)+"]["score"] == 90 and r["(a+)+"]["risk_level"] == "critical" and r["(a+)+"]["level"] == "dangerous"
    assert r[".*.*.*"]["complexity_notation"] == "O(n^3)" and int(r[".*.*.*"]["ops_at_1000"]) == 10**9 and not r[".*.*.*"]["safe_for_large_files"]
    assert int(r["(a+)+"]["ops_at_10000"]) == 2**100 and tuple(r["^ab$"]["has_anchors"]) == (True, True)
    assert r["(x"]["risk_level"] == "error" and r["^ab$"]["recommendations"] == ["Safe for production use"]


def test_scalars(spark):
    row = spark.range(1).select(scalars.split_key(F.lit("p1:f2:30")).alias("k"), scalars.int_list(F.lit("1, 2,x")).alias("l"), scalars.safe_name(F.lit("a/b é.log")).alias("n"), scalars.shown_line(F.lit(-1), F.lit(7)).alias("s"), scalars.iso_time(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("t"), scalars.query_string({"a": F.lit("x y"), "b": F.lit(1)}).alias("q")).first()
    assert tuple(row["k"]) == ("p1", "f2", 30) and row["l"] == [1, 2] and row["n"] == "a_b_é.log" and row["s"] == 7
    assert row["t"] == "2024-01-02T03:04:05" and row["q"] == "a=x+y&b=1"


def test_streams(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.log").write_text("error one\nfine\n")
    patterns = Patterns.of(spark, ["error"])
    query = events.watch(events.arriving_lines(spark, str(folder)), patterns, lambda batch, i: got.extend(r["line"] for r in batch.collect()), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert got == ["error one"]
    spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 3.0)], "t string, user_id long, value double").select(F.col("t").cast("timestamp").alias("ts"), "user_id", "value").write.parquet(str(tmp_path / "ev"))
    stream = events.tumbling(spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "ev")), late="10 minutes")
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["n"], r["total"]) for r in spark.table("tumbled").collect()] == [(2, 5.0)]
