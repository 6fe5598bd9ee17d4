"""The registered queries opN_* over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import ann, topk
from corpuslens.llm.common import table, tokenizer
from corpuslens.llm.language_id import identify_language
from corpuslens.llm.ngram_join import near_components
from corpuslens.llm.pii import detect
from corpuslens.llm.sentencepiece_codec import encode
from corpuslens.llm.source_mix import mix_sources
from corpuslens.llm.token_count import count_tokens
from corpuslens.llm.url_filter import JUNK_RULES, LIST_RULES, judge_urls
from corpuslens.llm.warc_fixity import DATE, audit, faulty, response_record

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _like(glob: str) -> str:
    return "^" + glob.replace(".", r"\.").replace("*", ".*") + "$"


ORACLES["op1_url_filters"] = f"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule, verdict) as (values {", ".join(f"('{r.name}', '{r.verdict}')" for r in LIST_RULES)}),
split as (select rule, verdict, regexp_extract(rule, '^[^/]*') as rh, regexp_extract(rule, '/.*$') as rp from rules),
own(pattern, expr, turn) as (values {", ".join(f"('{r.name}', '{_like(r.name)}', {i})" for i, r in enumerate(JUNK_RULES))}),
judged as (
  select parts.*,
    (select max_by(rule, length(rule)) from split where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule,
    (select max_by(pattern, (length(pattern), -turn)) from own where host <> '' and regexp_matches(host || path, expr)) as pattern
  from parts)
select page_id, host, path, rule,
  coalesce((select any_value(verdict) from rules r where r.rule = judged.rule), case when pattern is not null then 'block' else 'allow' end) as verdict,
  pattern
from judged
"""


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


ORACLES["op5_source_mix"] = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, coalesce(md5(doc_id::varchar), '') as key
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight, 3 * source_size as cap,
    row_number() over (order by source asc nulls last) as rnk
  from src),
level as (
  select *, cap::double / weight as ratio,
    ((sum(source_size) over ()) - coalesce(sum(cap) over (order by cap::double / weight, rnk rows between unbounded preceding and 1 preceding), 0))::double
      / sum(weight) over (order by cap::double / weight, rnk rows between current row and unbounded following) as share
  from ranked),
target as (
  select source, source_size, least(cap::double, weight * max(case when share <= ratio then share end) over ()) as target from level),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
    coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join target t on s.source is not distinct from t.source),
passes as (select *, coalesce(budget // nullif(source_size, 0), 0) as epochs from placed)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from passes
"""


@query
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op10_ngram_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)),
reach as (select doc_id as x, doc_id as y from documents union select reach.x, links.y from reach join links on links.x = reach.y),
least as (select x, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes s on s.doc_id = d.doc_id join least on least.x = d.doc_id
"""


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


@query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op2_exact_topk"] = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
best as (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from best where rank <= 5
"""


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archived records against a replica with planted faults."""
    pages = table(spark, sf_dir, "pages")
    key = F.col("page_id")
    records = pages.select("page_id", response_record(key, F.col("url"), F.col("html")).alias("record"))
    found = audit(records.withColumn("replica", faulty(F.col("record"), key)), key="page_id", record="record", replica="replica")
    return found.select(F.col("key").alias("page_id"), "archive", "position", "offset", "length", "digest", "status")


ORACLES["op3_warc_fixity"] = f"""
with http as (
  select page_id, coalesce(url, '') as url, md5(concat_ws('|', page_id::varchar, url)) as name,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') as body
  from pages),
records as (
  select page_id, array_to_string(['WARC/1.0', 'WARC-Type: response',
      'WARC-Record-ID: <urn:uuid:' || name[1:8] || '-' || name[9:12] || '-' || name[13:16] || '-' || name[17:20] || '-' || name[21:32] || '>',
      'WARC-Target-URI: ' || url, 'WARC-Date: {DATE}', 'Content-Type: application/http; msgtype=response',
      'Content-Length: ' || strlen(body)], chr(13) || chr(10)) || repeat(chr(13) || chr(10), 2) || body || repeat(chr(13) || chr(10), 2) as record
  from http),
leaves as (
  select page_id, strlen(record) as length, sha256(record) as digest, ('0x' || md5(coalesce(page_id::varchar, ''))[1:8])::bigint as pick,
    ('0x' || sha256(record)[1:8])::bigint % greatest(1, ceil((select count(*) from pages) / 4096.0)::bigint) as archive
  from records)
select page_id, archive, row_number() over w - 1 as position,
  coalesce(sum(length) over (partition by archive order by page_id nulls first, digest rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
  length, digest, case when pick % 997 = 5 then 'missing' when pick % 499 = 3 then 'corrupt' else 'ok' end as status
from leaves window w as (partition by archive order by page_id nulls first, digest)
"""


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
