"""Command line: trace (default), samples, analyse, check, index, compress, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from corpuslens.engine import Engine
from corpuslens.functions.complexity import LEVELS
from corpuslens.options import EngineOptions, SearchOptions
from corpuslens.plans.cache import TraceCache
from corpuslens.plans.hooks import Hooks

COMMANDS = ("trace", "samples", "analyse", "check", "index", "compress", "serve")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuslens")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--json", action="store_true", help="print JSON")
        return c

    t = command("trace", "search files for patterns")
    t.add_argument("pattern", nargs="?")
    t.add_argument("paths", nargs="*")
    t.add_argument("-e", "--regexp", action="append", default=[])
    t.add_argument("--path", action="append", default=[])
    t.add_argument("--max-results", type=int)
    t.add_argument("--samples", action="store_true")
    t.add_argument("--context", type=int)
    t.add_argument("-B", "--before", type=int)
    t.add_argument("-A", "--after", type=int)
    t.add_argument("--no-cache", action="store_true", default=bool(os.environ.get("CORPUSLENS_NO_CACHE")))
    for k in ("on-file", "on-match", "on-complete"):
        t.add_argument(f"--hook-{k}")
    s = command("samples", "lines at places of a file")
    s.add_argument("path")
    s.add_argument("-b", "--byte-offset", type=int, action="append")
    s.add_argument("-l", "--line", type=int, action="append")
    s.add_argument("-c", "--context", type=int)
    s.add_argument("-B", "--before", type=int)
    s.add_argument("-A", "--after", type=int)
    s.add_argument("-r", "--regex", help="highlight")
    command("analyse", "profile files").add_argument("paths", nargs="+")
    command("check", "how a pattern may behave").add_argument("pattern")
    i = command("index", "sparse line indexes")
    i.add_argument("paths", nargs="+")
    i.add_argument("--step", type=int)
    c = command("compress", "re-encode into frames")
    c.add_argument("source")
    c.add_argument("target", nargs="?")
    c.add_argument("--frame-size", default="4M")
    c.add_argument("--level", type=int, default=3)
    v = command("serve", "HTTP service")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=7777)
    v.add_argument("--search-root", action="append", default=[])
    return p


def size(text: str) -> int:
    """Bytes of ``4M``, ``10MB``, ``1.5G``."""
    import re

    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?\s*", text.upper())
    if not m:
        raise ValueError(f"no size: {text}")
    return int(float(m[1]) * 1024 ** " KMGT".index(m[2] or " "))


def side(one: int | None, both: int | None, default: int) -> int:
    return one if one is not None else both if both is not None else default


def run_trace(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    patterns, paths = list(a.regexp), a.paths + a.path
    if a.pattern is not None:
        (paths.insert(0, a.pattern) if patterns else patterns.append(a.pattern))
    if not patterns or not paths:
        raise ValueError("a pattern and a path are needed")
    wants = a.samples or a.context is not None or a.before is not None or a.after is not None
    options = SearchOptions.from_flags(flags, max_results=a.max_results, before=side(a.before, a.context, 3) if wants else 0, after=side(a.after, a.context, 3) if wants else 0)
    cache = None if a.no_cache else TraceCache(engine.spark, f"file:{os.path.abspath(engine.options.cache_dir)}")
    out = engine.trace(paths, patterns, options, hooks=Hooks.chosen(Hooks(a.hook_on_file, a.hook_on_match, a.hook_on_complete)), cache=cache)
    rows = [f"{out['files'][m['file']]}:{m['absolute_line_number']}:{m['offset']} [{m['pattern']}] {m['line_text']}" for m in out["matches"]]
    for key in sorted(out["context_lines"]):
        rows += [f"--- {key}", *(f"{x['line_no']}: {x['line']}" for x in out["context_lines"][key])]
    return out, "\n".join([*rows, f"{len(out['matches'])} matches in {len(out['scanned_files'])} files"]), 0


def run_samples(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    before, after = side(a.before, a.context, 3), side(a.after, a.context, 3)
    out = engine.samples(a.path, lines=a.line, offsets=a.byte_offset, before=before, after=after)
    rows = []
    for k, lines in out["samples"].items():
        rows += [f"=== {k}", *(highlight(x, a.regex) for x in lines)]
    return out, "\n".join(rows), 0


def highlight(line: str, pattern: str | None) -> str:
    import re

    try:
        return re.sub(f"({pattern})", "\x1b[91m\\1\x1b[0m", line) if pattern else line
    except re.error:
        return line


def run_analyse(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    out = engine.analyse(a.paths)
    rows = [f"{r['path']}: {r['size_human']}, {r['line_count']} lines, longest {r['line_length_max']}, {r['line_ending']}" for r in out["results"]]
    return out, "\n".join(rows), 2 if out["skipped_files"] else 0


def run_check(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    out = engine.check(a.pattern)
    text = [f"{out['risk_level']} ({out['score']}), {out['complexity_notation']}", *(f"- {i['type']}: {i['segment']}" for i in out["issues"]), *out["recommendations"]]
    return out, "\n".join(text), 1 if out["error"] else 2 if out["risk_level"] in [*LEVELS][3:] else 0


def run_index(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    out = {p: engine.save_index(os.path.abspath(p), os.path.abspath(engine.options.cache_dir), a.step) for p in a.paths}
    return out, "\n".join(f"{k} -> {v}" for k, v in out.items()), 0


def run_compress(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    from dataclasses import replace

    worker = Engine(engine.spark, replace(engine.options, frame_bytes=size(a.frame_size), compression_level=a.level))
    out = worker.compress(a.source, a.target or a.source)
    return out, f"{out['path']}: {out['frames']} frames, ratio {out['ratio']}", 0


def run_serve(engine: Engine, a: argparse.Namespace, flags: list[str]) -> tuple[dict, str, int]:
    from dataclasses import replace

    from corpuslens.service import serve

    options = replace(engine.options, search_roots=tuple(a.search_root) or engine.options.search_roots)
    serve(Engine(engine.spark, options), a.host, a.port)
    return {}, "", 0


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; arguments that name none belong to trace. Returns the exit status."""
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv = ["trace", *argv]
    a, rest = parser().parse_known_args(argv)
    if rest and a.command != "trace":
        parser().error(f"unknown arguments: {' '.join(rest)}")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    engine = Engine(spark, EngineOptions.from_env(dict(os.environ)))
    try:
        out, text, status = globals()[f"run_{a.command}"](engine, a, rest)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, default=str) if a.json else text)
    return status


if __name__ == "__main__":
    sys.exit(main())
