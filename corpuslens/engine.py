"""The verbs over files, each a plan over lines and a plain result."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import complexity
from corpuslens.functions.patterns import Patterns
from corpuslens.operators import context, frames, index, profile, samples
from corpuslens.operators.trace import add_submatches, ordered, trace
from corpuslens.options import EngineOptions, SearchOptions
from corpuslens.plans.cache import ProfileCache, TraceCache
from corpuslens.plans.hooks import Hooks, call, deliver, file_events, match_events, request_id
from corpuslens.plans.side_tables import SideTables
from corpuslens.sources import codecs, files, seekable
from corpuslens.sources.lines import lines_of_files


def _uri(path: str) -> str:
    return f"file:{os.path.abspath(path)}"


def _path(uri: str) -> str:
    return uri.removeprefix("file://").removeprefix("file:")


class Engine:
    """Searches, samples, profiles, indexes and framed files under one set of options."""

    def __init__(self, spark: SparkSession, options: EngineOptions = EngineOptions()) -> None:
        self.spark, self.options, self.sandbox = spark, options, files.Sandbox(options.search_roots)

    def lines(self, paths: list[str]) -> DataFrame:
        """Lines of files of any kind, each read the way its kind needs."""
        framed = [p for p in paths if seekable.is_seekable(p)]
        rest = [p for p in paths if p not in framed and os.path.getsize(p)]
        plain, packed = [], []
        for p in rest:
            codec = codecs.detect(p)
            by_reader = os.path.splitext(p)[1].lower() in codecs.READER and codecs.by_extension(p) == codec
            hidden = os.path.basename(p).startswith((".", "_"))
            (plain if (codec is None or by_reader) and not hidden else packed).append(p)
        parts = []
        if plain:
            parts.append(lines_of_files(self.spark, [_uri(p) for p in plain]))
        if packed:
            parts.append(codecs.lines_of_compressed(self.spark, [_uri(p) for p in packed]))
        if framed:
            parts.append(seekable.lines_of_seekable(self.spark, framed, self.options.frames_per_batch).drop("frame"))
        if not parts:
            return self.spark.createDataFrame([], "file string, line_no long, byte_offset long, n_bytes long, line string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))

    def trace(self, paths: list[str], patterns: list[str], options: SearchOptions = SearchOptions(), *, hooks: Hooks = Hooks(), cache: TraceCache | None = None, on_match: Callable[[dict], None] | None = None, on_file: Callable[[dict], None] | None = None) -> dict:
        """Matches over files and folders, with ids of patterns and files, and context.

        ``hooks`` are addresses that executors call; ``on_match`` and ``on_file`` are called
        on the driver, in the order of the result.
        """
        began = time.time()
        hooks.check(options.max_results)
        compiled = Patterns.of(self.spark, patterns, options)
        warnings = [f"pattern may be slow on long lines: {p}" for p in patterns if not options.fixed and complexity.dangerous(p)]
        found, skipped = files.resolve(self.sandbox.check(paths), self.options)
        lines = self.lines(found)
        listed = files.file_table(self.spark, found)
        if cache and options.max_results is None:
            rows = self._cached(cache, listed, found, compiled, patterns, options)
        else:
            rows = trace(lines, compiled)
        ids = {f: f"f{i}" for i, f in enumerate(found, 1)}
        best = ordered(rows, compiled)
        matches = [
            {"pattern": r["pattern"], "file": ids[r["file"]], "offset": r["offset"], "absolute_line_number": r["line_no"], "line_text": r["line"], "submatches": [x.asDict() for x in r["submatches"]]}
            for r in add_submatches(best, compiled).toLocalIterator()
        ]
        request = request_id()
        out = {"request_id": request, "patterns": compiled.ids, "files": {v: k for k, v in ids.items()}, "matches": matches, "scanned_files": found, "skipped_files": skipped, "max_results": options.max_results, "context_lines": {}, "warnings": warnings}
        if options.before or options.after:
            limited = best.select("pattern", "file", "offset", "line_no")
            around = context.groups(context.context(lines, limited, options.before, options.after).withColumn("file", F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.col("file"))))
            out["context_lines"] = {r["key"]: [x.asDict() for x in r["lines"]] for r in around.toLocalIterator()}
        for m in matches if on_match else ():
            on_match(m)
        if on_file:
            for r in file_events(rows, listed, request).orderBy("file_path").toLocalIterator():
                on_file(r.asDict())
        if hooks.on_match:
            deliver(match_events(best, request), hooks.on_match, self.options.hook_timeout_s)
        if hooks.on_file:
            deliver(file_events(rows, listed, request), hooks.on_file, self.options.hook_timeout_s)
        out["time"] = time.time() - began
        if hooks.on_complete:
            call(hooks.on_complete, {"event": "trace_complete", "request_id": request, "total_files_scanned": len(found), "total_matches": len(matches), "total_time_ms": int(1000 * out["time"])}, self.options.hook_timeout_s)
        return out

    def _cached(self, cache: TraceCache, listed: DataFrame, found: list[str], compiled: Patterns, patterns: list[str], options: SearchOptions) -> DataFrame:
        kept = cache.load(compiled.ids, options)
        if kept is None:
            served, missing = None, listed
        else:
            served, missing = TraceCache.split(kept, listed)
        left = {r["path"] for r in missing.select("path").collect()}  # max_files paths at most
        fresh = trace(self.lines([f for f in found if f in left]), compiled)
        worth = missing.filter(files.worth_caching(F.col("size"), F.col("codec"), self.options))
        keep = worth.select(F.col("path").alias("w"))
        cache.save(fresh.join(keep, F.col("file") == F.col("w"), "left_semi"), worth, compiled.ids, options)
        if served is None:
            return fresh
        return fresh.unionByName(TraceCache.rehydrate(served, self.lines([f for f in found if f not in left]), compiled.ids))

    def samples(self, path: str, *, lines: list[int] | None = None, offsets: list[int] | None = None, before: int = 3, after: int = 3) -> dict:
        """Lines at line numbers or byte offsets of one file, with context."""
        if (lines is None) == (offsets is None):
            raise ValueError("give either lines or offsets")
        [path] = self.sandbox.check([path])
        files.validate_file(path)
        if offsets is not None and codecs.detect(path) and not seekable.is_seekable(path):
            raise ValueError("offsets need a plain or framed file")
        rows = self.lines([path])
        asked = self.spark.createDataFrame([(path, v) for v in lines if v > 0] if lines is not None else [(path, v) for v in offsets if v >= 0], "file string, value long")
        if lines is not None:
            got = {r["value"]: r["lines"] for r in samples.by_line(rows, asked, before, after).collect()}
            places = {r["value"]: r["offset"] for r in samples.line_to_offset(rows, asked).collect()}
            return {"path": path, "lines": {str(v): places.get(v, -1) for v in lines}, "offsets": {}, "samples": {str(v): got.get(v, []) for v in lines}, "before_context": before, "after_context": after}
        found = {r["value"]: r for r in samples.by_offset(rows, asked, before, after).collect()}
        return {"path": path, "offsets": {str(v): found[v]["line_no"] if v in found else -1 for v in offsets}, "lines": {}, "samples": {str(v): found[v]["lines"] if v in found else [] for v in offsets}, "before_context": before, "after_context": after}

    def analyse(self, paths: list[str], *, cache: ProfileCache | None = None, custom: dict[str, Column] | None = None, file_hook: Callable[[dict], dict] | None = None, post_hook: Callable[[dict], dict] | None = None) -> dict:
        """One profile a file; files that are no text get their metadata only.

        With a ``cache``, unchanged files are not read again; ``custom`` columns are always
        computed afresh and not kept.
        """
        named = [p for p in self.sandbox.check(paths)]
        found, skipped = [], []
        for p in named:
            if os.path.isdir(p):
                text, other = files.scan_directory(p, 10**9)
                found += text
                skipped += other
            elif os.path.exists(p):
                found.append(p)
            else:
                raise FileNotFoundError(p)
        listed = files.file_table(self.spark, dict.fromkeys(found))
        readable = [p for p in dict.fromkeys(found) if files.is_text_file(p) or codecs.detect(p)]
        kept = cache.load(listed) if cache and not custom else None
        known = {r["path"] for r in kept.select("path").collect()} if kept is not None else set()  # of the listed ones
        lines = self.lines([p for p in readable if p not in known])
        fresh = listed.join(kept.select("path"), "path", "left_anti") if known else listed
        profiles = profile.with_files(profile.profile(lines, **(custom or {})).join(profile.ending_of_lines(lines), "file"), fresh)
        if cache and not custom and len(known) < len(dict.fromkeys(found)):
            cache.save(profiles)
            profiles = cache.load(listed).drop("path_hash")
        elif known:
            profiles = kept.drop("path_hash")
        rows = []
        for r in profiles.orderBy("path").toLocalIterator():
            row = r.asDict()
            row["is_compressed"] = row["codec"] is not None
            row["decompressed_size"] = row.pop("line_bytes") if row["is_compressed"] else None
            row["compression_ratio"] = row["decompressed_size"] / row["size"] if row["decompressed_size"] and row["size"] else None
            if row["path"] not in readable:
                row.update({k: None for k in row if k.startswith(("line_", "empty_line"))})
            for hook in (file_hook, post_hook):
                row = (hook(row) or row) if hook else row
            rows.append(row)
        return {"results": rows, "scanned_files": found, "skipped_files": skipped}

    def check(self, pattern: str) -> dict:
        """The complexity report of a pattern."""
        return complexity.report(self.spark.createDataFrame([(pattern,)], "regex string")).first().asDict(recursive=True)

    def index(self, path: str, step: int | None = None) -> DataFrame:
        """Checkpoints of a file, one at least every ``step`` bytes."""
        return index.every_n_bytes(self.lines([path]), step or self.options.index_step_bytes)

    def save_index(self, path: str, folder: str, step: int | None = None) -> str:
        """Write a file's checkpoints beside its size and time; the table's path."""
        return SideTables(self.spark, folder).save("index", path, self.index(path, step))

    def load_index(self, path: str, folder: str) -> DataFrame | None:
        """The checkpoints of a file if they were saved for its present size and time."""
        return SideTables(self.spark, folder).load("index", path)

    def frames(self, path: str, folder: str) -> DataFrame:
        """The frames of a framed file with their lines, from a side table or built."""

        def build() -> DataFrame:
            counts = self.spark.createDataFrame(seekable.count_lines(path), "frame int, lines int")
            return frames.place_lines(seekable.frame_table(self.spark, [path]).join(counts, "frame"))

        return SideTables(self.spark, folder).get_or_build("frames", path, build)

    def compress(self, source: str, target: str, progress: Callable[[int, int], None] | None = None) -> dict:
        """Re-encode into frames; sizes, ratio and the frames' lines."""
        made = seekable.write(self.spark, source, target, self.options, progress)
        target = target if target.endswith(".zst") else f"{target}.zst"
        table = seekable.frame_table(self.spark, [target]) if made else None
        counts = self.spark.createDataFrame(seekable.count_lines(target) or [], "frame int, lines int")
        lines = 0
        if table is not None:
            placed = frames.place_lines(table.join(counts, "frame"))
            lines = placed.agg(F.max("last_line")).first()[0]
        size, decoded = os.path.getsize(target), sum(f.decoded_size for f in made)
        return {"path": target, "frames": len(made), "compressed_size": size, "decompressed_size": decoded, "ratio": round(decoded / size, 2) if size else 0.0, "lines": lines}
