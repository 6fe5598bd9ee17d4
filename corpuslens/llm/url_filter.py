"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path``. From its literal text come the
tokens that any matching url must hold whole; the rarest of them in the corpus is the
rule's index token. The tokens of a url fetch its candidate rules, and only these run
their expressions. Only DataFrame operations are used.

Up to ``INLINE_RULES`` rules travel in the plan as a literal map, so judging is one
projection without a shuffle. More rules become a table, and the distinct urls' tokens
are joined with it.

Defined results: a null url, or one without ``://``, has an empty host and path and fits
no rule; rules without a whole literal token are tried on every url; of fitting rules the
longest wins, then the one listed first; repeated rows are judged separately; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[A-Za-z0-9]+"
INLINE_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def host_path_rule(name: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the path starts with the rule's."""
    host, _, rest = name.partition("/")
    path = "/" + rest
    inner = re.findall(TOKEN, path[: path.rfind("/") + 1])  # a token at the end may go on in the url
    return Rule(name, verdict, f"^(?:[^/?#]*\\.)?{_quoted(host)}{_quoted(path)}", (*re.findall(TOKEN, host), *inner))


def glob_rule(name: str, verdict: str) -> Rule:
    """A pattern in which ``*`` stands for any text."""
    parts = name.split("*")
    tokens = [t for p in parts for t in re.findall(f"(?<![A-Za-z0-9]){TOKEN}(?![A-Za-z0-9])", p) if re.search(f"[^A-Za-z0-9]{t}[^A-Za-z0-9]", p)]
    return Rule(name, verdict, "^" + ".*".join(map(_quoted, parts)) + "$", tuple(tokens))


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many rows of ``urls`` (host, path) each token of the rules occurs."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    held = F.array_intersect(_tokens(), F.array(*map(F.lit, known)))
    found = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()  # a row for each token of a rule
    return {r["token"]: r["count"] for r in found}


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0)))


def rule_index(rules: list[Rule], counts: dict[str, int]) -> list[str | None]:
    """The index token of each rule: its rarest; ties go to the longer, then the smaller."""
    return [min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if r.tokens else None for r in rules]


def best_rule(urls: DataFrame, rules: list[Rule], into: str, inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` (with host and path) and the winning rule as struct<name, verdict> or null."""
    index = rule_index(rules, token_counts(urls, rules))
    if len(rules) > inline:
        return _joined(urls, rules, index, into)
    by: dict[str, list[int]] = {}
    for i, t in enumerate(index):
        by.setdefault(t if t is not None else "", []).append(i)
    fits = F.array(*(F.struct(F.lit(r.regex).alias("regex"), F.lit(len(r.name)).alias("size"), F.lit(-i).alias("turn"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")) for i, r in enumerate(rules)))
    lookup = F.create_map(*(x for t, ids in by.items() for x in (F.lit(t), F.array(*(F.element_at(fits, i + 1) for i in ids)))))
    keys = F.array(*map(F.lit, by))
    held = F.array_intersect(F.concat(_tokens(), F.array(F.lit(""))), keys)
    near = F.flatten(F.transform(held, lambda t: F.element_at(lookup, t)))
    address = F.concat("host", "path")
    hit = F.filter(near, lambda r: (F.col("host") != "") & F.rlike(address, r["regex"]))
    top = F.array_max(F.transform(hit, lambda r: F.struct(r["size"].alias("size"), r["turn"].alias("turn"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    return urls.withColumn(into, top)


def _joined(urls: DataFrame, rules: list[Rule], index: list[str | None], into: str) -> DataFrame:
    spark = urls.sparkSession
    rows = [(t if t is not None else "", r.regex, len(r.name), -i, r.name, r.verdict) for i, (r, t) in enumerate(zip(rules, index, strict=True))]
    listed = spark.createDataFrame(rows, "token string, regex string, size int, turn int, name string, verdict string")
    known = urls.select("host", "path").distinct()
    tokens = known.filter("host != ''").withColumn("token", F.explode(F.concat(_tokens(), F.array(F.lit("")))))
    hits = tokens.join(listed, "token").filter(F.rlike(F.concat("host", "path"), F.col("regex")))
    top = hits.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.max(F.struct("size", "turn", "name", "verdict")).alias(into))
    return urls.join(top, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")


#: Rules of the operator itself, for urls that no list rule fits: pages without prose.
JUNK_RULES = [glob_rule(p, "block") for p in ("*/wp-login.php*", "*/cgi-bin/*", "*/cart/*", "*/checkout/*", "*/signin/*")]
LIST_RULES = [host_path_rule("com/", "allow"), host_path_rule("example.com/en/", "block"), host_path_rule("www.example.com/en/", "allow"), host_path_rule("net/es/", "block"), host_path_rule("net/fr/", "block")]


def judge_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: list[Rule] | None = None, extra: list[Rule] | None = None, default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every url.

    ``rule`` is the winning list rule and gives the verdict; without one the operator's
    own rules do (``pattern``), and without these ``default``.
    """
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = best_rule(base, LIST_RULES if rules is None else rules, "listed", inline)
    extra = JUNK_RULES if extra is None else extra
    out = best_rule(out, extra, "own", inline) if extra else out.withColumn("own", F.lit(None).cast(T.StructType([T.StructField("name", T.StringType()), T.StructField("verdict", T.StringType())])))
    return out.select("page_id", "host", "path", F.col("listed.name").alias("rule"), F.coalesce("listed.verdict", "own.verdict", F.lit(default)).alias("verdict"), F.col("own.name").alias("pattern"))
