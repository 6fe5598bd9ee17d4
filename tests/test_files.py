"""Lines of files, their kinds, and the verbs over them."""

import bz2
import gzip
import json
import lzma
import os
import random
import urllib.request

import pytest
import zstandard
from pyspark.sql import functions as F

from corpuslens import cli
from corpuslens.engine import Engine
from corpuslens.functions.patterns import Patterns, translate
from corpuslens.functions.sql import register
from corpuslens.operators import index, samples
from corpuslens.operators.samples import between
from corpuslens.operators.trace import trace
from corpuslens.options import EngineOptions, SearchOptions
from corpuslens.plans.cache import ProfileCache, TraceCache
from corpuslens.plans.side_tables import LineStore, SideTables
from corpuslens.sources import codecs, files, seekable
from corpuslens.sources.lines import lines_of, lines_of_files, split_counts


def plain(data: bytes):
    """(line_no, offset, text) by the definition of lines."""
    out, at = [], 0
    for i, raw in enumerate(data.split(b"\n")[: None if not data.endswith(b"\n") and data else -1], 1):
        out.append((i, at, raw.decode("utf-8", "replace")))
        at += len(raw) + 1
    return out


CASES = {
    "three": b"Line 1\nLine 2\nLine 3\n",
    "unterminated": b"Line 1\nLine 2\nLine 3",
    "crlf": b"a\r\nb\r\n",
    "mixed": b"line1\r\n line2\r line3\n line4\r\n",
    "bare_cr": b"before\rafter\nline2\n",
    "blank": b"\n\nx\n\n",
    "unicode": "é x\u0085y\n日本\n😀".encode(),
    "one": b"\n",
}


@pytest.fixture()
def engine(spark):
    return Engine(spark)


@pytest.mark.parametrize("name", CASES)
def test_lines_of_each_source_agree(spark, tmp_path, name):
    data = CASES[name]
    path = tmp_path / "f.txt"
    path.write_bytes(data)
    want = plain(data)
    for rows in (lines_of_files(spark, [str(path)]), *(lines_of(spark.createDataFrame([("f", data.decode())], "name string, body string"), "name", "body", by_window=w) for w in (False, True))):
        assert sorted((r["line_no"], r["byte_offset"], r["line"]) for r in rows.collect()) == want


def test_split_files_keep_exact_places(spark, tmp_path):
    rnd = random.Random(1)
    data = "".join("é" * rnd.randrange(40) + "\n" for _ in range(20_000)).encode()
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(b"x\n" * 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = lines_of_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert rows.rdd.getNumPartitions() > 0
        got = sorted((r["line_no"], r["byte_offset"], r["line"]) for r in rows.filter(F.col("file").endswith("a.txt")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == plain(data)


def test_codecs(engine, tmp_path):
    data = b"".join(b"Line %d\n" % i for i in range(100))
    made = {"a.gz": gzip.compress(data), "a.bz2": bz2.compress(data), "a.xz": lzma.compress(data), "a.zst": zstandard.compress(data), "b.log": gzip.compress(data)}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    rows = engine.lines([str(tmp_path / n) for n in made]).collect()
    for name in made:
        assert sorted((r["line_no"], r["byte_offset"], r["line"]) for r in rows if r["file"].endswith(name)) == plain(data), name
        assert codecs.decode(made[name], codecs.detect(str(tmp_path / name))) == data
    assert codecs.decoded_size(str(tmp_path / "a.gz")) == len(data)
    assert [codecs.by_extension(x) for x in ("a.TAR.GZ", "a.tgz", "x.GZ", "x.txt")] == [None, None, "gzip", None]


def test_damaged_archives_do_not_crash(engine, tmp_path):
    path = tmp_path / "c.log"
    path.write_bytes(b"\x1f\x8b\x08junk")
    assert engine.lines([str(path)]).collect() == []


def test_framed_files(spark, tmp_path):
    data = b"".join(b"LINE%05d\n" % i for i in range(5000))
    source, target = tmp_path / "s.txt", str(tmp_path / "s.txt.zst")
    source.write_bytes(data)
    engine = Engine(spark, EngineOptions(frame_bytes=5000, frames_per_batch=3))
    info = engine.compress(str(source), str(tmp_path / "s.txt"))
    assert info["lines"] == 5000 and info["decompressed_size"] == len(data) and seekable.is_seekable(target)
    assert zstandard.ZstdDecompressor().stream_reader(open(target, "rb"), read_across_frames=True).read() == data
    for start, size in ((0, 10), (4990, 40), (49_000, 5000), (10**6, 5)):
        assert seekable.read_range(target, start, size) == data[start : start + size]
    rows = sorted((r["line_no"], r["byte_offset"], r["line"]) for r in engine.lines([target]).collect())
    assert rows == plain(data)


def test_lines_across_frames(spark, tmp_path):
    """Frames that end inside a line still give whole lines and exact numbers."""
    data = b"".join(b"%d %s\n" % (i, b"x" * (i % 700)) for i in range(300)) + b"last"
    target, encoder, sizes = tmp_path / "x.zst", zstandard.ZstdCompressor(), []
    with open(target, "wb") as out:
        for i in range(0, len(data), 1111):
            done = encoder.compress(data[i : i + 1111])
            out.write(done)
            sizes.append((len(done), len(data[i : i + 1111])))
        out.write(seekable.seek_table(sizes))
    for batch in (1, 4, 1000):
        rows = seekable.lines_of_seekable(spark, [str(target)], batch)
        assert sorted((r["line_no"], r["byte_offset"], r["line"]) for r in rows.collect()) == plain(data)


def test_dialect(spark):
    rows = [("error\r",), ("12٣",), ("Öl",), ("foobar",), ("café le",), ("a b",)]
    lines = spark.createDataFrame([(f"f{i}", 1, 0, 0, t) for i, (t,) in enumerate(rows)], "file string, line_no long, byte_offset long, n_bytes long, line string")

    def found(pattern, **options):
        return [r["line"] for r in trace(lines, Patterns.of(spark, [pattern], SearchOptions(**options))).collect()]

    assert found("error$") == [] and found(r"\d{3}") == ["12٣"] and found("öl", ignore_case=True) == ["Öl"]
    assert found("a.b") == ["a b"] and found("(?P<x>foo)bar") == ["foobar"] and found("le", word=True) == ["café le"]
    assert [r["pattern"] for r in trace(lines, Patterns.of(spark, ["foo", "foobar"])).collect()] == ["p1", "p2"]
    assert translate("a+b", SearchOptions(fixed=True)).endswith("a\\+b")
    for bad in ("(unclosed", r"(?=x)", r"(a)\1"):
        with pytest.raises(ValueError, match="Invalid regex pattern"):
            Patterns.of(spark, [bad])
    assert found(r"(o)\1", look_around=True) == ["foobar"]


def test_submatches_count_bytes(spark):
    lines = lines_of(spark.createDataFrame([("f", "é error errors\nx")], "file string, body string"), "file", "body")
    [row] = trace(lines, Patterns.of(spark, ["error"], SearchOptions(word=True)), with_submatches=True).collect()
    assert [tuple(s) for s in row["submatches"]] == [("error", 3, 8)]


def test_profiles_of_unchanged_files_come_from_the_cache(spark, engine, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("one\ntwo\n")
    b.write_text("x\n")
    cache = ProfileCache(spark, str(tmp_path / "cache"))

    def counts(**more):
        return {os.path.basename(r["path"]): r["line_count"] for r in engine.analyse([str(logs)], cache=cache, **more)["results"]}

    assert counts() == {"a.log": 2, "b.log": 1}
    stat = a.stat()
    a.write_text("sevens.\n")  # the same size, and below the same time: the cache still speaks for it
    os.utime(a, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    b.write_text("x\ny\nz\n")
    assert counts() == {"a.log": 2, "b.log": 3} and counts() == {"a.log": 2, "b.log": 3}
    assert counts(custom={"n": F.count("*")}) == {"a.log": 1, "b.log": 3}


def test_places_across_cells(spark):
    rows = [("f", 1, 0, 200_000), ("f", 2, 200_001, 3), ("f", 3, 200_005, samples.CELL), ("g", 1, 0, 0)]
    lines = spark.createDataFrame(rows, "file string, line_no long, byte_offset long, n_bytes long")
    end = 200_005 + samples.CELL
    asks = [("f", v) for v in (0, samples.CELL - 1, samples.CELL, 200_000, 200_001, 200_004, 200_005, end, end + 1, -1)] + [("g", 0), ("g", 1), ("h", 0)]
    got = {(r["file"], r["value"]): r["line_no"] for r in samples.offset_to_line(lines, spark.createDataFrame(asks, "file string, value long")).collect()}
    assert got == dict(zip(asks, [1, 1, 1, 1, 2, 2, 3, 3, -1, -1, 1, -1, -1], strict=True))


def test_trace_samples_and_profile(engine, tmp_path):
    path = tmp_path / "t.log"
    path.write_text("".join(f"line {i} {'error' if i in (2, 5, 7) else 'ok'}\n" for i in range(1, 9)))
    (tmp_path / "bin").write_bytes(b"\0\1")
    (tmp_path / "empty.txt").write_bytes(b"")
    out = engine.trace([str(tmp_path)], ["error", "line 5"], SearchOptions(before=1, after=1))
    assert [(m["pattern"], m["absolute_line_number"]) for m in out["matches"]] == [("p1", 2), ("p1", 5), ("p2", 5), ("p1", 7)]
    assert [x["line_no"] for x in out["context_lines"]["p2:" + out["matches"][2]["file"] + f":{out['matches'][2]['offset']}"]] == [4, 5, 6]
    assert out["skipped_files"] == [str(tmp_path / "bin")]
    assert len(engine.trace([str(path)], ["error"], SearchOptions(max_results=2))["matches"]) == 2
    got = engine.samples(str(path), lines=[1, 100], before=1, after=1)
    assert got["samples"] == {"1": ["line 1 ok", "line 2 error"], "100": []} and got["lines"] == {"1": 0, "100": -1}
    got = engine.samples(str(path), offsets=[12, 10**6], before=0, after=0)
    assert got["samples"] == {"12": ["line 2 error"], str(10**6): []} and got["offsets"] == {"12": 2, str(10**6): -1}
    rows = {os.path.basename(r["path"]): r for r in engine.analyse([str(tmp_path), str(tmp_path / "bin")])["results"]}
    assert rows["t.log"]["line_count"] == 8 and rows["t.log"]["line_ending"] == "LF"
    assert rows["empty.txt"]["line_count"] == 0 and rows["empty.txt"]["line_length_avg"] == 0.0
    assert rows["bin"]["line_count"] is None
    with pytest.raises(FileNotFoundError):
        engine.trace([str(tmp_path / "none")], ["x"])
    assert len(engine.trace([str(path)], ["(a+)+"])["warnings"]) == 1 and engine.trace([str(path)], ["error"])["warnings"] == []


def test_callbacks_progress_and_sql(engine, spark, tmp_path):
    path, seen, files_seen, steps = tmp_path / "t.log", [], [], []
    path.write_text("".join(f"error {i}\n" for i in range(200)))
    engine.trace([str(path)], ["error 1$"], on_match=seen.append, on_file=files_seen.append)
    assert [m["line_text"] for m in seen] == ["error 1"] and files_seen[0]["matches_count"] == 1
    Engine(spark, EngineOptions(frame_bytes=200)).compress(str(path), str(tmp_path / "o"), lambda a, b: steps.append((a, b)))
    assert steps[-1][0] == steps[-1][1] == len(steps) > 1
    assert split_counts(spark, [str(path)]).first()["splits"] == 1
    assert [r["line"] for r in between(engine.lines([str(path)]), str(path), 3, 2).collect()] == ["error 2", "error 3"]
    register(spark)
    assert [tuple(r) for r in spark.sql("select * from text_lines('é\\nb\\n')").collect()] == [(1, 0, "é"), (2, 3, "b")]
    assert spark.sql("select pattern_is_dangerous('(a+)+') as a, pattern_is_dangerous('a') as b").first().asDict() == {"a": True, "b": False}


def test_checkpoints(spark):
    text = "".join("x" * 99 + "\n" for _ in range(100))
    lines = lines_of(spark.createDataFrame([("f", text)], "file string, body string"), "file", "body")
    rows = sorted((r["line_no"], r["byte_offset"]) for r in index.every_n_bytes(lines, 2500).collect())
    assert rows == [(1, 0), (26, 2500), (51, 5000), (76, 7500)]
    marks = [(1, 0), (100, 1000), (200, 2000)]
    assert [index.nearest(marks, t) for t in (150, 500, 0, 100)] == [(100, 1000), (200, 2000), (1, 0), (100, 1000)]
    assert index.nearest([], 5) == (1, 0)


def test_trace_cache(spark, tmp_path):
    engine = Engine(spark, EngineOptions(large_file_mb=0))
    path = tmp_path / "c.log"
    path.write_text("error one\nfine\nerror two\n")
    cache = TraceCache(spark, str(tmp_path / "cache"))
    first = engine.trace([str(path)], ["error", "two"], cache=cache)["matches"]
    assert cache.info({"p1": "error", "p2": "two"}).collect()[0]["matches"] == 3
    again = engine.trace([str(path)], ["two", "error"], cache=cache)["matches"]
    names = lambda ms, ids: sorted((ids[m["pattern"]], m["offset"], m["line_text"]) for m in ms)
    assert names(first, {"p1": "error", "p2": "two"}) == names(again, {"p1": "two", "p2": "error"})
    path.write_text("error one\nfine\nerror two\nerror three\n")
    assert len(engine.trace([str(path)], ["error"], cache=cache)["matches"]) == 3


def test_saved_index(engine, tmp_path):
    path = tmp_path / "i.txt"
    path.write_text("".join(f"{i}\n" for i in range(1000)))
    engine.save_index(str(path), str(tmp_path / "cache"), 100)
    assert engine.load_index(str(path), str(tmp_path / "cache")).count() > 10
    path.write_text("changed\n")
    assert engine.load_index(str(path), str(tmp_path / "cache")) is None


def test_side_tables_and_line_store(engine, spark, tmp_path):
    tables, path = SideTables(spark, str(tmp_path / "side")), tmp_path / "s.txt"
    path.write_text("a\nb\n")
    assert tables.load("lines", str(path)) is None and tables.info("lines", str(path)) is None and tables.listing("lines") == []
    assert tables.get_or_build("lines", str(path), lambda: engine.lines([str(path)])).count() == 2
    assert tables.info("lines", str(path))["valid"] and tables.listing("lines") == [str(path)]
    path.write_text("a\nb\nc\n")
    assert not tables.info("lines", str(path))["valid"]
    assert tables.delete("lines", str(path)) and not tables.delete("lines", str(path))
    store = LineStore(spark, str(tmp_path / "store"), buckets=4)
    store.save(lines_of(spark.createDataFrame([(f"f{i}", "\n".join(map(str, range(100)))) for i in range(5)], "file string, body string"), "file", "body"))
    assert sorted(r["line"] for r in store.between("f3", 11, 13).collect()) == ["10", "11", "12"] and store.lines().count() == 500


def test_frames_table(spark, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"{i}\n" for i in range(500)))
    engine = Engine(spark, EngineOptions(frame_bytes=300))
    made = engine.compress(str(tmp_path / "f.txt"), str(tmp_path / "f"))
    rows = engine.frames(made["path"], str(tmp_path / "side")).orderBy("frame").collect()
    assert rows[0]["first_line"] == 1 and rows[-1]["last_line"] == 500 and len(rows) == made["frames"]
    assert all(a["last_line"] + 1 == b["first_line"] for a, b in zip(rows, rows[1:]))


def test_sandbox(tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    inside.mkdir()
    outside.mkdir()
    (inside / "a").write_text("x")
    (outside / "b").write_text("x")
    (inside / "link").symlink_to(outside / "b")
    box = files.Sandbox([str(inside)])
    assert box.holds(str(inside / "a")) and box.holds(str(inside / "new"))
    for bad in (outside / "b", inside / "link", inside / ".." / "out" / "b", tmp_path / "in2"):
        with pytest.raises(PermissionError):
            box.check([str(bad)])
    assert files.Sandbox().holds("/")
    text, skipped = files.scan_directory(str(inside))
    assert text == [str(inside / "a")] and skipped == []


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.log").write_text("Error\nerror\nERROR\n")
    assert cli.main(["error", str(tmp_path / "a.log"), "-i", "--json"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["matches"]) == 3
    assert cli.main(["check", "(a+)+"], spark) == 2 and cli.main(["check", "(unclosed"], spark) == 1 and cli.main(["check", "abc"], spark) == 0
    assert cli.main(["samples", str(tmp_path / "a.log"), "-l", "2", "-c", "0"], spark) == 0
    assert "=== 2\nerror" in capsys.readouterr().out
    assert cli.main(["analyse", str(tmp_path / "a.log")], spark) == 0
    assert cli.main(["compress", str(tmp_path / "a.log"), "--frame-size", "1K"], spark) == 0
    assert cli.main(["index", str(tmp_path / "a.log")], spark) == 0
    assert cli.main(["trace", "x", str(tmp_path / "none")], spark) == 1
    assert cli.size("1.5G") == 1610612736


def test_service(spark, tmp_path):
    import threading
    import time

    from corpuslens.service import server

    (tmp_path / "a.log").write_text("one error\ntwo\n")
    http = server(Engine(spark, EngineOptions(search_roots=(str(tmp_path),), cache_dir=str(tmp_path / "cache"))))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def get(target, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + target, data=data), timeout=120) as r:
                body = r.read()
                return r.status, json.loads(body) if r.headers["Content-Type"] == "application/json" else body.decode()
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    path = tmp_path / "a.log"
    assert get("/health")[1]["status"] == "ok"
    assert len(get(f"/v1/trace?path={path}&regexp=error")[1]["matches"]) == 1
    assert get("/v1/trace?path=/etc/passwd&regexp=x")[0] == 403
    assert get(f"/v1/trace?path={path}.none&regexp=x")[0] == 404
    assert get(f"/v1/trace?path={path}&regexp=(x")[0] == 400
    assert get("/v1/complexity?regex=(a%2B)%2B")[1]["risk_level"] == "critical"
    assert get(f"/v1/samples?path={path}&lines=2&context=0")[1]["samples"] == {"2": ["two"]}
    assert get(f"/v1/analyse?path={path}")[1]["results"][0]["line_count"] == 2
    status, task = get("/v1/compress", json.dumps({"input_path": str(path)}).encode())
    for _ in range(100):
        state = get(f"/v1/tasks/{task['task_id']}")[1]
        if state["status"] in ("completed", "failed"):
            break
        time.sleep(0.3)
    assert status == 200 and state["status"] == "completed", state
    assert 'endpoint="trace",status="200"' in get("/metrics")[1]
    http.shutdown()
