"""The engine's registered queries, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import complexity, scalars, spans
from corpuslens.functions.patterns import Patterns
from corpuslens.operators import context, frames, index, profile, samples
from corpuslens.operators.trace import occurrences, ordered, trace
from corpuslens.options import SearchOptions
from corpuslens.plans import cache, metrics, stores
from corpuslens.sources import codecs
from corpuslens.sources.lines import lines_of
from corpuslens.streaming import events as windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

THE, AND, LICENSE = r"\bthe\b", r"\band\b", "[Ll]icense"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def searched(spark: SparkSession, sf_dir: str, *patterns: str, **options) -> DataFrame:
    """Match rows over the documents; a file is a doc_id."""
    return trace(doc_lines(spark, sf_dir), Patterns.of(spark, list(patterns), SearchOptions(**options)))


def cut(source: str, key: str, text: str) -> str:
    """SQL: the relation of lines of a text column."""
    body = f"case when ends_with({text}, chr(10)) then left({text}, length({text}) - 1) else {text} end"
    return f"""
lines as (
  select file, line_no, line, strlen(line) as n_bytes,
    coalesce(sum(strlen(line) + 1) over (partition by file order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset
  from (select {key} as file, unnest(string_split({body}, chr(10))) as line, unnest(range(1, len(string_split({body}, chr(10))) + 1)) as line_no from {source} where {text} <> ''))"""


DOCS = "with " + cut("documents", "doc_id", "text")
HIT = "select '{p}' as pattern, file, byte_offset as \"offset\", line_no, line from lines where {where}"


def hits(where: str, source: str = DOCS, p: str = "p1") -> str:
    return source + " " + HIT.format(p=p, where=where)


def has(pattern: str) -> str:
    return "regexp_matches(line, '" + pattern.replace("'", "''") + "')"


@register(DOCS + " select file, line_no, byte_offset, n_bytes from lines")
def lines_explode(spark, sf_dir):
    return doc_lines(spark, sf_dir).drop("line")


@register(DOCS + " select file, line_no, byte_offset, n_bytes from lines")
def lines_by_window(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents"), "doc_id", "text", by_window=True).drop("line")


@register(hits(has(THE)))
def trace_single(spark, sf_dir):
    return searched(spark, sf_dir, THE)


@register(DOCS + " union all ".join(" " + HIT.format(p=f"p{i}", where=has(p)) for i, p in enumerate((THE, AND, LICENSE), 1)))
def trace_multi_pattern(spark, sf_dir):
    return searched(spark, sf_dir, THE, AND, LICENSE)


@register(hits(has(r"(\d{1,3}\.){3}\d{1,3}")))
def trace_bounded_repeats(spark, sf_dir):
    return searched(spark, sf_dir, r"(\d{1,3}\.){3}\d{1,3}")


@register(hits(has("(?i)the")))
def trace_ignore_case(spark, sf_dir):
    return searched(spark, sf_dir, "the", ignore_case=True)


@register(hits(has(r"(?:^|[^\p{L}\p{M}\p{N}_])le(?:$|[^\p{L}\p{M}\p{N}_])")))
def trace_word(spark, sf_dir):
    return searched(spark, sf_dir, "le", word=True)


@register(hits("contains(line, 'the.')"))
def trace_fixed(spark, sf_dir):
    return searched(spark, sf_dir, "the.", fixed=True)


@register(hits(has("^(?:[A-Z][a-z]+[.])$")))
def trace_line_regexp(spark, sf_dir):
    return searched(spark, sf_dir, "[A-Z][a-z]+[.]", whole_line=True)


@register(hits("not " + has("[Tt]he")))
def trace_invert(spark, sf_dir):
    return searched(spark, sf_dir, "[Tt]he", invert=True)


@register(
    DOCS
    + """, parts as (
  select file, byte_offset, regexp_extract_all(line, '[Tt]he|and') as m from lines),
each as (select file, byte_offset, unnest(m) as text from parts where len(m) > 0)
select file, text, count(*) as n from each group by file, text"""
)
def trace_occurrence_counts(spark, sf_dir):
    found = occurrences(doc_lines(spark, sf_dir), Patterns.of(spark, ["[Tt]he|and"], SearchOptions(ascii=True)))
    return found.groupBy("file", "text").agg(F.count("*").alias("n"))


@register(
    DOCS
    + """, recursive_cut as (
  select file, byte_offset, string_split_regex(line, '[Tt]he|and') as gaps, regexp_extract_all(line, '[Tt]he|and') as m from lines where regexp_matches(line, '[Tt]he|and')),
placed as (select file, byte_offset, m[i] as text, list_sum(list_transform(gaps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) as start
  from (select *, unnest(range(1, len(m) + 1)) as i from recursive_cut))
select 'p1' as pattern, file, (byte_offset + start)::bigint as "offset", text from placed"""
)
def trace_occurrences(spark, sf_dir):
    return occurrences(doc_lines(spark, sf_dir), Patterns.of(spark, ["[Tt]he|and"], SearchOptions(ascii=True)))


@register(
    DOCS
    + f""", m as (select file, regexp_extract_all(line, '{LICENSE}') as m from lines where {has(LICENSE)})
select file, count(*) as lines, sum(len(m))::bigint as matches from m group by file"""
)
def trace_submatch_count(spark, sf_dir):
    rows = trace(doc_lines(spark, sf_dir), Patterns.of(spark, [LICENSE]), with_submatches=True)
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.size("submatches")).alias("matches"))


@register(hits(has(THE) + ' order by file, "offset" limit 100'))
def trace_max_results(spark, sf_dir):
    return ordered(searched(spark, sf_dir, THE), max_results=100)


def _pattern_query(name: str, pattern: str) -> None:
    @register(hits(has(pattern)))
    def run(spark, sf_dir):
        return searched(spark, sf_dir, pattern, ascii=True)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _name, _pattern in (("trace_pii_email", EMAIL), ("trace_pii_phone", "[0-9]{3}-[0-9]{4}"), ("trace_ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("trace_license", LICENSE)):
    _pattern_query(_name, _pattern)


def _source_query(name: str, source: str, key: str, sql_key: str, text: str, pattern: str) -> None:
    @register(hits(has(pattern), "with " + cut(source, sql_key, text)))
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, source).withColumn("name", F.expr(key))
        return trace(lines_of(rows, "name", text), Patterns.of(spark, [pattern], SearchOptions(ascii=True)))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_source_query("trace_pages_html", "pages", "page_id", "page_id", "html", "<h[1-6]>")
_source_query("trace_conversations", "conversations", "concat_ws('/', cast(conv_id as string), cast(turn as string))", "conv_id::varchar || '/' || turn::varchar", "text", "[Tt]he")
_source_query("trace_event_props", "events", "event_id", "event_id", "props", '"k": 1[0-9]')

_AROUND = """
select m.file, m.line_no, l.line_no as context_no, l.byte_offset as context_offset, l.line as context
from lines m join lines l on l.file = m.file and l.line_no between m.line_no - {b} and m.line_no + {a}
where regexp_matches(m.line, '{p}')"""


def _context(spark, sf_dir, pattern, before, after, dense):
    lines = doc_lines(spark, sf_dir)
    found = trace(lines, Patterns.of(spark, [pattern]))
    return context.context(lines, found, before, after, dense=dense).select("file", "line_no", "context_no", "context_offset", "context")


@register(DOCS + _AROUND.format(b=2, a=2, p=LICENSE))
def context_window(spark, sf_dir):
    return _context(spark, sf_dir, LICENSE, 2, 2, True)


@register(DOCS + _AROUND.format(b=2, a=2, p=LICENSE))
def context_join(spark, sf_dir):
    return _context(spark, sf_dir, LICENSE, 2, 2, False)


@register(DOCS + _AROUND.format(b=2, a=1, p=LICENSE))
def context_asym(spark, sf_dir):
    return _context(spark, sf_dir, LICENSE, 2, 1, False)


@register(
    DOCS
    + f""", around as ({_AROUND.format(b=1, a=1, p=LICENSE)})
select file, context_no as line_no, any_value(context) as line, bool_or(context_no = line_no) as hit from around group by file, context_no"""
)
def context_merged(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return context.merged(context.context(lines, trace(lines, Patterns.of(spark, [LICENSE])), 1, 1))


@register(
    DOCS
    + f""", around as ({_AROUND.format(b=1, a=1, p=LICENSE)})
select 'p1:' || a.file || ':' || l.byte_offset as key, string_agg(context, chr(10) order by context_no) as lines
from around a join lines l on l.file = a.file and l.line_no = a.line_no group by all"""
)
def context_groups(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    rows = context.groups(context.context(lines, trace(lines, Patterns.of(spark, [LICENSE])), 1, 1))
    return rows.select("key", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("lines"))


def _requests(spark, sf_dir, value) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), value.cast("long").alias("value"))


@register(
    DOCS
    + """, req as (select doc_id as file, (doc_id % 12) + 1 as value from documents),
near as (select r.file, r.value, string_agg(regexp_replace(l.line, '[\\r\\n]+$', ''), chr(10) order by l.line_no) as lines
  from req r join lines m on m.file = r.file and m.line_no = r.value join lines l on l.file = r.file and l.line_no between r.value - 2 and r.value + 1 group by all)
select r.file, r.value, coalesce(n.lines, '') as lines from req r left join near n on n.file = r.file and n.value = r.value"""
)
def samples_by_line(spark, sf_dir):
    found = samples.by_line(doc_lines(spark, sf_dir), _requests(spark, sf_dir, F.col("doc_id") % 12 + 1), 2, 1)
    return found.select("file", "value", F.array_join("lines", "\n").alias("lines"))


@register(
    DOCS
    + """, req as (select doc_id as file, (doc_id * 37) % 900 as value from documents),
place as (select r.file, r.value, coalesce(l.line_no, -1) as line_no from req r left join lines l on l.file = r.file and r.value between l.byte_offset and l.byte_offset + l.n_bytes),
near as (select a.file, a.value, string_agg(l.line, chr(10) order by l.line_no) as lines
  from place a join lines l on l.file = a.file and l.line_no between a.line_no - 1 and a.line_no + 1 where a.line_no > 0 group by all)
select a.file, a.value, a.line_no, coalesce(n.lines, '') as lines from place a left join near n on n.file = a.file and n.value = a.value"""
)
def samples_by_offset(spark, sf_dir):
    found = samples.by_offset(doc_lines(spark, sf_dir), _requests(spark, sf_dir, F.col("doc_id") * 37 % 900), 1, 1)
    return found.select("file", "value", "line_no", F.array_join("lines", "\n").alias("lines"))


@register("select doc_id as file, 1000000::bigint as value, 0::bigint as n from documents")
def samples_out_of_range(spark, sf_dir):
    found = samples.by_line(doc_lines(spark, sf_dir), _requests(spark, sf_dir, F.lit(1_000_000)))
    return found.select("file", "value", F.size("lines").cast("long").alias("n"))


@register(
    DOCS
    + """, req as (select doc_id as file, (doc_id * 37) % 900 as value from documents)
select r.file, r.value, coalesce(l.line_no, -1) as line_no from req r left join lines l on l.file = r.file and r.value between l.byte_offset and l.byte_offset + l.n_bytes"""
)
def offset_to_line(spark, sf_dir):
    return samples.offset_to_line(doc_lines(spark, sf_dir), _requests(spark, sf_dir, F.col("doc_id") * 37 % 900))


@register(
    DOCS
    + """, req as (select doc_id as file, (doc_id % 12) + 1 as value from documents)
select r.file, r.value, coalesce(l.byte_offset, -1) as "offset" from req r left join lines l on l.file = r.file and r.value = l.line_no"""
)
def line_to_offset(spark, sf_dir):
    return samples.line_to_offset(doc_lines(spark, sf_dir), _requests(spark, sf_dir, F.col("doc_id") % 12 + 1))


_MARKS = "marks as (select file, line_no, byte_offset from lines where line_no = 1 or line_no % 5 = 0)"


@register(
    DOCS
    + f""", {_MARKS}
select l.file, l.line_no, m.line_no as checkpoint_line, m.byte_offset as checkpoint_offset from lines l asof join marks m on l.file = m.file and l.line_no >= m.line_no"""
)
def asof_checkpoint(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select("file", "line_no", "byte_offset")
    return index.last_checkpoint(lines, index.every_n_lines(lines, 5)).drop("byte_offset")


@register(
    DOCS
    + f""", {_MARKS}
select l.file, l.byte_offset, m.line_no as checkpoint_line, m.byte_offset as checkpoint_offset from lines l asof join marks m on l.file = m.file and l.byte_offset >= m.byte_offset"""
)
def asof_checkpoint_by_offset(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select("file", "line_no", "byte_offset")
    return index.last_checkpoint(lines, index.every_n_lines(lines, 5), by="byte_offset").drop("line_no")


@register(DOCS + " select file, line_no, byte_offset from lines where line_no = 1 or line_no % 10 = 0")
def checkpoints_every_n(spark, sf_dir):
    return index.every_n_lines(doc_lines(spark, sf_dir), 10)


@register(DOCS + " select file, min(line_no) as line_no, min(byte_offset) as byte_offset from lines group by file, byte_offset // 1000")
def checkpoints_by_bytes(spark, sf_dir):
    return index.buckets_of_bytes(doc_lines(spark, sf_dir), 1000)


@register(f"""with recursive {cut("documents", "doc_id", "text")},
next as (
  select a.file, a.line_no, b.line_no as to_line, b.byte_offset as to_offset
  from lines a asof join lines b on a.file = b.file and a.byte_offset + 1000 <= b.byte_offset),
marks as (
  select file, line_no, byte_offset from lines where line_no = 1
  union all select n.file, n.to_line, n.to_offset from marks m join next n on m.file = n.file and m.line_no = n.line_no)
select file, line_no, byte_offset from marks""")
def checkpoints_exact(spark, sf_dir):
    return index.every_n_bytes(doc_lines(spark, sf_dir), 1000)


_FRAMES = """, frames as (select file, byte_offset // 1000 as frame, min(byte_offset) as decoded_offset, max(byte_offset + n_bytes + 1) - min(byte_offset) as decoded_size,
  min(line_no) as first_line, max(line_no) as last_line from lines group by all)"""


@register(DOCS + _FRAMES + " select file, frame, decoded_offset, decoded_size, first_line, last_line from frames")
def frame_table(spark, sf_dir):
    return frames.fixed_frames(doc_lines(spark, sf_dir), 1000)


@register(
    DOCS
    + _FRAMES
    + """, req as (select doc_id as file, (doc_id % 12) + 1 as value from documents)
select r.file, r.value, f.frame from req r join frames f on f.file = r.file and r.value between f.first_line and f.last_line"""
)
def frame_lookup(spark, sf_dir):
    return frames.of_lines(frames.fixed_frames(doc_lines(spark, sf_dir), 1000), _requests(spark, sf_dir, F.col("doc_id") % 12 + 1))


@register(
    DOCS
    + _FRAMES
    + """, req as (select doc_id as file, (doc_id * 37) % 900 as value from documents)
select r.file, r.value, f.frame from req r left join frames f on f.file = r.file and r.value >= f.decoded_offset and r.value < f.decoded_offset + f.decoded_size"""
)
def frame_of_offset(spark, sf_dir):
    return frames.of_offsets(frames.fixed_frames(doc_lines(spark, sf_dir), 1000), _requests(spark, sf_dir, F.col("doc_id") * 37 % 900))


@register(
    DOCS
    + _FRAMES
    + """, req as (select doc_id as file, doc_id % 700 as low, doc_id % 700 + 900 as high from documents)
select r.file, r.low, r.high, f.frame from req r join frames f on f.file = r.file and f.decoded_offset < r.high and f.decoded_offset + f.decoded_size > r.low"""
)
def frame_overlap(spark, sf_dir):
    low = F.col("doc_id") % 700
    ranges = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), low.alias("low"), (low + 900).alias("high"))
    return frames.overlapping(frames.fixed_frames(doc_lines(spark, sf_dir), 1000), ranges)


@register(
    DOCS
    + _FRAMES
    + """, wanted as (select distinct file, unnest([frame - 1, frame, frame + 1]) as frame from frames where frame = 1)
select w.file, w.frame from wanted w semi join frames f on f.file = w.file and f.frame = w.frame"""
)
def frame_neighbours(spark, sf_dir):
    cut_ = frames.fixed_frames(doc_lines(spark, sf_dir), 1000)
    return frames.with_neighbours(cut_.filter("frame = 1"), cut_)


_LENGTHS = ", x as (select *, length(line) as n, regexp_matches(line, '^\\s*$') as blank from lines)"


@register(
    DOCS
    + _LENGTHS
    + """ select file, count(*) as line_count, count(*) filter (blank) as empty_line_count, coalesce(max(n) filter (not blank), 0)::bigint as line_length_max,
  round(coalesce(avg(n) filter (not blank), 0), 6) as line_length_avg, round(coalesce(stddev_pop(n) filter (not blank), 0), 6) as line_length_stddev, sum(n_bytes + 1)::bigint as line_bytes from x group by file"""
)
def profile_basic(spark, sf_dir):
    p = profile.profile(doc_lines(spark, sf_dir))
    return p.select("file", "line_count", "empty_line_count", "line_length_max", F.round("line_length_avg", 6).alias("line_length_avg"), F.round("line_length_stddev", 6).alias("line_length_stddev"), "line_bytes")


@register(
    DOCS
    + _LENGTHS
    + """ select file, round(coalesce(quantile_cont(n, 0.5) filter (not blank), 0), 6) as line_length_median, round(coalesce(quantile_cont(n, 0.95) filter (not blank), 0), 6) as line_length_p95,
  round(coalesce(quantile_cont(n, 0.99) filter (not blank), 0), 6) as line_length_p99 from x group by file"""
)
def profile_percentiles(spark, sf_dir):
    p = profile.profile(doc_lines(spark, sf_dir))
    return p.select("file", *(F.round(c, 6).alias(c) for c in ("line_length_median", "line_length_p95", "line_length_p99")))


@register(
    DOCS
    + _LENGTHS
    + """ select file, arg_max(line_no, (n, -line_no)) filter (not blank) as line_length_max_line_number, arg_max(byte_offset, (n, -line_no)) filter (not blank) as line_length_max_byte_offset from x group by file"""
)
def profile_longest(spark, sf_dir):
    return profile.profile(doc_lines(spark, sf_dir)).select("file", "line_length_max_line_number", "line_length_max_byte_offset")


@register(
    """select doc_id as file, case when (a::int + b::int + c::int) > 1 then 'mixed' when a then 'CRLF' when b then 'CR' else 'LF' end as line_ending
from (select doc_id, contains(t, chr(13) || chr(10)) as a, regexp_matches(replace(t, chr(13) || chr(10), ''), '\\r') as b, contains(replace(t, chr(13) || chr(10), ''), chr(10)) as c
  from (select doc_id, case doc_id % 4 when 0 then text when 1 then replace(text, chr(10), chr(13) || chr(10)) when 2 then replace(text, chr(10), chr(13)) else text || chr(13) end as t from documents))"""
)
def profile_line_ending(spark, sf_dir):
    way = F.col("doc_id") % 4
    text = F.when(way == 0, F.col("text")).when(way == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(way == 2, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.concat("text", F.lit("\r")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), profile.line_ending(text).alias("line_ending"))


@register(
    """select doc_id as file, n, case when n < 1024 then printf('%.2f B', n) when n < 1048576 then printf('%.2f KB', n / 1024.0) else printf('%.2f MB', n / 1048576.0) end as size
from (select doc_id, (strlen(text) * (1 + doc_id % 300))::double as n from documents)"""
)
def profile_human_size(spark, sf_dir):
    n = (F.octet_length("text") * (1 + F.col("doc_id") % 300)).cast("double")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), n.alias("n"), scalars.human_size(n).alias("size"))


@register(
    DOCS
    + """, x as (select *, n_bytes as n, regexp_matches(line, '^\\s*$') as blank from lines)
select file, count(*) as line_count, coalesce(max(n) filter (not blank), 0)::bigint as line_length_max, round(coalesce(avg(n) filter (not blank), 0), 6) as line_length_avg,
  round(coalesce(quantile_cont(n, 0.5) filter (not blank), 0), 6) as line_length_median, round(coalesce(stddev_samp(n) filter (not blank), 0), 6) as line_length_stddev from x group by file"""
)
def index_stats_bytes(spark, sf_dir):
    p = profile.index_statistics(doc_lines(spark, sf_dir))
    return p.select("file", "line_count", "line_length_max", *(F.round(c, 6).alias(c) for c in ("line_length_avg", "line_length_median", "line_length_stddev")))


@register("select doc_id as file, (length(text) - length(replace(text, chr(10), '')))::bigint as n from documents")
def newline_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), profile.newlines(F.col("text")).alias("n"))


_NAMES = "(['.gz', '.LOG.GZ', '.zst', '.xz', '.bz2', '.tar.gz', '.tgz', '.txt', '', '.tbz2'])[(page_id % 10 + 1)::int]"


def _names(spark, sf_dir) -> DataFrame:
    ends = F.array(*map(F.lit, [".gz", ".LOG.GZ", ".zst", ".xz", ".bz2", ".tar.gz", ".tgz", ".txt", "", ".tbz2"]))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/logs/a"), F.element_at(ends, (F.col("page_id") % 10 + 1).cast("int"))).alias("path"))


@register(f"select page_id, case when page_id % 10 in (0, 1) then 'gzip' when page_id % 10 = 2 then 'zstd' when page_id % 10 = 3 then 'xz' when page_id % 10 = 4 then 'bz2' end as codec, '/logs/a' || {_NAMES} as path from pages")
def codec_by_extension(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("codec", codecs.extension_codec(F.col("path")))


@register("select page_id, page_id % 10 in (5, 6, 9) as archive from pages")
def compound_archive(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", codecs.archive(F.col("path")).alias("archive"))


@register("select event_type, count(*) as n from events group by event_type")
def event_counts(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events"), "event_type")


@register("select event_type as event, count(*) filter (value > 0 and event_type <> 'error') as success, count(*) filter (not (value > 0 and event_type <> 'error')) as failed from events where value is not null group by event_type")
def hook_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value is not null")
    return stores.hook_counters(rows.select(F.col("event_type").alias("event"), ((F.col("value") > 0) & (F.col("event_type") != "error")).alias("ok")))


def _log(spark, sf_dir) -> DataFrame:
    """Events as a request log: purchases and signups are completed."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("request_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type").isin("purchase", "signup"), F.col("ts")).alias("completed_at"), "user_id")


@register("select count(*) as total, count(*) filter (event_type in ('purchase', 'signup')) as completed, count(*) filter (event_type not in ('purchase', 'signup')) as in_progress from events")
def store_stats(spark, sf_dir):
    return stores.stats(_log(spark, sf_dir))


@register("select event_id as request_id, epoch_us(ts) as started_us from events where event_type not in ('purchase', 'signup') order by ts desc, event_id limit 100")
def recent_requests(spark, sf_dir):
    return stores.recent(_log(spark, sf_dir), 100, include_completed=False).select("request_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"))


@register("with d as (select event_id from events where event_type in ('purchase', 'signup') order by ts, event_id limit (select greatest(100, count(*) // 10) from events)) select event_id as request_id from events where event_id not in (select event_id from d)")
def evict_oldest(spark, sf_dir):
    return stores.evict(_log(spark, sf_dir), limit=1).select("request_id")


@register("select event_id as request_id, user_id, row_number() over (partition by user_id order by ts desc, event_id) as rank from events")
def requests_by_recency(spark, sf_dir):
    return stores.ranked_by_recency(_log(spark, sf_dir), "user_id").select("request_id", "user_id", F.col("rank").cast("long").alias("rank"))


_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0)


@register(" union all ".join([f"select '{b:g}' as le, count(*) filter (value <= {b}) as n from events" for b in _BOUNDS]) + " union all select '+Inf', count(value) from events")
def histogram_buckets(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value", _BOUNDS)


@register(DOCS + _FRAMES + f" select f.file, f.frame from frames f semi join (select file, byte_offset from lines where {has(LICENSE)}) m on m.file = f.file and m.byte_offset >= f.decoded_offset and m.byte_offset < f.decoded_offset + f.decoded_size")
def semi_frames(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return cache.frames_with_matches(trace(lines, Patterns.of(spark, [LICENSE])), frames.fixed_frames(lines, 1000)).select("file", "frame")


@register("select doc_id as file from documents where doc_id % 3 <> 0 or doc_id % 2 = 0")
def anti_cached(spark, sf_dir):
    """Files that must be read: a third is cached, half of these have changed since."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit("t").alias("modified_at"))
    cached = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("file"), (F.col("n_chars") + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)).alias("size"), F.lit("t").alias("modified_at"), F.lit("x").alias("pattern"))
    return cache.TraceCache.split(cached, files)[1].select(F.col("path").alias("file"))


@register(DOCS + f" select 'p1' as pattern, file, byte_offset as \"offset\", line_no, line from lines where {has(LICENSE)}")
def cache_rehydrate(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    served = trace(lines, Patterns.of(spark, [LICENSE])).select(F.lit(LICENSE).alias("pattern"), "file", "offset", "line_no")
    return cache.TraceCache.rehydrate(served, lines, {"p1": LICENSE})


@register("select doc_id as file from documents where doc_id % 2 = 0 union all select doc_id from documents where doc_id % 3 = 0")
def path_union(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"))
    return ids.filter("file % 2 = 0").unionAll(ids.filter("file % 3 = 0"))


@register("select doc_id as file from documents except all select doc_id from documents where contains(text, 'the')")
def skip_except(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file")).exceptAll(docs.filter(F.contains("text", F.lit("the"))).select("doc_id"))


@register("select distinct (doc_id * 37) % 900 as value from documents")
def distinct_offsets(spark, sf_dir):
    return _requests(spark, sf_dir, F.col("doc_id") * 37 % 900).select("value").distinct()


_SUMS = "count(*) as n, round(sum(value), 4) as total"


def _rounded(rows: DataFrame, **times) -> DataFrame:
    starts = {k: F.unix_timestamp(F.col(v).cast("timestamp")) for k, v in times.items()}
    return rows.withColumns(starts).withColumn("total", F.round("total", 4))


@register(f"select epoch(time_bucket(interval '1 hour', ts))::bigint as window_start, event_type, {_SUMS} from events group by 1, 2")
def tumbling_events(spark, sf_dir):
    return _rounded(windows.tumbling(table(spark, sf_dir, "events"), by=("event_type",)), window_start="window_start")


@register(f"select s as window_start, {_SUMS} from (select value, unnest([epoch(time_bucket(interval '30 minutes', ts))::bigint, epoch(time_bucket(interval '30 minutes', ts))::bigint - 1800]) as s from events) group by s")
def sliding_events(spark, sf_dir):
    return _rounded(windows.sliding(table(spark, sf_dir, "events")), window_start="window_start")


@register(
    f"""with o as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval '30 minutes' then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from o)
select user_id, floor(epoch(min(ts)))::bigint as session_start, floor(epoch(max(ts) + interval '30 minutes'))::bigint as session_end, {_SUMS} from g group by user_id, k"""
)
def session_events(spark, sf_dir):
    return _rounded(windows.sessions(table(spark, sf_dir, "events")), session_start="session_start", session_end="session_end")


@register("select doc_id as file, regexp_replace(t, '(the)', '<$1>'.replace('$', chr(92)), 'g') as marked from (select doc_id, text as t from documents)")
def highlight_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), spans.highlight(F.col("text"), "the", "<", ">").alias("marked"))


@register("select page_id, sha256(url)[1:16] as hash, split_part(url, '/', -1) as name from pages")
def path_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.path_hash(F.col("url")).alias("hash"), scalars.base_name(F.col("url")).alias("name"))


_SIZES = ("4M", "10MB", "1.5G", "512", "7 kb", "x", "2T")


@register("select * from (values ('4M', 4194304::bigint), ('10MB', 10485760), ('1.5G', 1610612736), ('512', 512), ('7 kb', 7168), ('x', null), ('2T', 2199023255552)) t(text, bytes)")
def parsed_sizes(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in _SIZES], "text string")
    return rows.withColumn("bytes", scalars.parse_size(F.col("text")))


REGEXES = ("hello", "^[a-z]+$", "(a+)+", "(a*)*", "((a+)+)+", "(a|a)+", "(a|ab)+", r"(\d|\w)+", ".*.*", ".*.*.*", ".*.*.*.*", r"(a)\1", "(?=a)(?=b)(?=c)(?=d)", "(unclosed", "", "^.*.*$", "a{0,20000}", r"\d+\s+\w+")


@register(
    "select * from (values "
    + ", ".join(
        f"('{r}', {s}, '{k}')"
        for r, s, k in (("hello", 10, "safe"), ("^[a-z]+$", 9, "safe"), ("(a+)+", 90, "critical"), ("(a*)*", 90, "critical"), ("((a+)+)+", 95, "critical"), ("(a|a)+", 90, "critical"), ("(a|ab)+", 90, "critical"), (r"(\d|\w)+", 14, "safe"), (".*.*", 50, "warning"), (".*.*.*", 65, "warning"), (".*.*.*.*", 80, "dangerous"), (r"(a)\1", 15, "safe"), ("(?=a)(?=b)(?=c)(?=d)", 15, "safe"), ("(unclosed", 0, "error"), ("", 10, "safe"), ("^.*.*$", 45, "caution"), ("a{0,20000}", 19, "safe"), (r"\d+\s+\w+", 16, "safe"))
    )
    + ") t(regex, score, risk_level)"
)
def complexity_report(spark, sf_dir):
    rows = spark.createDataFrame([(r,) for r in REGEXES], "regex string")
    return complexity.report(rows).select("regex", "score", "risk_level")


@register(
    """with f as (select l_orderkey, l_linenumber, (l_linenumber % 3 = 0)::int * (l_partkey % 4) as e, (1 + l_suppkey % 5)::int as d, (l_partkey % 6)::int as i, (l_orderkey % 4)::int as h, (l_suppkey % 14)::int as q, l_returnflag = 'A' as a from lineitem),
s as (select *, greatest(0, case when e > 0 then least(100, 90 + (e - 1) * 5) when d >= 4 then 80 when d = 3 then 65 when d = 2 then 50 else 10 + least(20, i * 5) + least(10, h * 3) + least(10, q) end - case when a then 5 else 0 end) as score,
  case when e > 0 then 'exponential' when d >= 2 then 'polynomial' else 'linear' end as class from f)
select l_orderkey, l_linenumber, score::int as score, case when score >= 85 then 'critical' when score >= 70 then 'dangerous' when score >= 50 then 'warning' when score >= 25 then 'caution' else 'safe' end as risk,
  class, class = 'linear' or class = 'polynomial' and d <= 2 as safe from s"""
)
def complexity_score_sql(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    e = (F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0) * (F.col("l_partkey") % 4)).cast("int")
    d, i, h, q = (1 + F.col("l_suppkey") % 5).cast("int"), (F.col("l_partkey") % 6).cast("int"), (F.col("l_orderkey") % 4).cast("int"), (F.col("l_suppkey") % 14).cast("int")
    rows = rows.select("l_orderkey", "l_linenumber", complexity.score(e, d, i, h, q, F.col("l_returnflag") == "A").alias("score"), complexity.complexity_class(e, d).alias("class"), d.alias("d"))
    return rows.select("l_orderkey", "l_linenumber", "score", complexity.risk(F.col("score")).alias("risk"), "class", complexity.safe_for_large_files(F.col("class"), F.col("d")).alias("safe"))
