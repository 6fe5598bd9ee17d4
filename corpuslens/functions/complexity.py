"""Static analysis of a pattern: how badly a backtracking matcher may behave on it.

A pattern's syntax tree is read once by :func:`features`, which gives plain numbers and
the issues found. Scores, risk and estimates are column expressions over these numbers, so
a table of patterns is judged by one small function and SQL.
"""

from __future__ import annotations

import re
import re._constants as sc
import re._parser as sp
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# As plain numbers: the parser's constants cannot travel to the executors.
REPEATS = frozenset(map(int, (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT)))
ASSERTS = frozenset(map(int, (sc.ASSERT, sc.ASSERT_NOT)))
#: Classes wider than this, and explicit repeat limits from here on, are flagged.
WIDE_CLASS = 100
LARGE_REPEAT = 10_000

_DIGITS = frozenset("0123456789")
_SPACES = frozenset(" \t\n\r\f\v")
_WORDS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_") | _DIGITS
_CLASSES = {int(sc.CATEGORY_DIGIT): _DIGITS, int(sc.CATEGORY_SPACE): _SPACES, int(sc.CATEGORY_WORD): _WORDS}

#: What an issue of each kind advises.
ADVICE = {
    "nested_quantifier": ["Make one of the nested repeats match a fixed number", "Use an atomic group or a possessive repeat"],
    "overlapping_disjunction": ["Let the alternatives start with different characters", "Move the common beginning out of the alternatives"],
    "greedy_chain": ["Replace repeated wildcards by negated classes", "Anchor the pattern"],
    "backreference": ["Match the repeated text in a second step"],
    "multiple_lookaround": ["Split the conditions into several patterns"],
    "large_quantifier": ["Lower the repeat's limit"],
    "parse_error": ["Correct the syntax"],
}


@dataclass(frozen=True)
class Place:
    """Where a node stands: the nearest repeat's kind, repeats around it, asserts around it."""

    repeating: bool = False  # the nearest repeat can run more than once
    inside: bool = False  # some repeat around can
    repeats: int = 0
    height: int = 0
    asserts: int = 0


def children(node: tuple, at: Place) -> Iterator[tuple[list, Place]]:
    """The sequences below a node, with the place of what they hold."""
    op, value = node
    if op in REPEATS:
        many = value[1] > 1
        yield list(value[2]), replace(at, repeating=many, inside=at.inside or many, repeats=at.repeats + 1, height=at.height + many)
    elif op == sc.SUBPATTERN:
        yield list(value[3]), at
    elif op == sc.BRANCH:
        for option in value[1]:
            yield list(option), at
    elif op in ASSERTS:
        yield list(value[1]), replace(at, asserts=at.asserts + 1)
    elif op == sc.ATOMIC_GROUP:
        yield list(value), at
    elif op == sc.GROUPREF_EXISTS:
        for option in value[1:]:
            if option is not None:
                yield list(option), at


def walk(nodes: list, at: Place = Place()) -> Iterator[tuple[tuple, Place]]:
    """Every node with its place, parents first."""
    for node in nodes:
        yield node, at
        for below, where in children(node, at):
            yield from walk(below, where)


def first_characters(node: tuple) -> frozenset[str] | None:
    """Characters that a match of the node can start with; None stands for any."""
    op, value = node
    if op == sc.LITERAL:
        return frozenset(chr(value))
    if op == sc.IN:
        return _class(value)
    if op == sc.CATEGORY:
        return _CLASSES.get(value)
    if op in REPEATS:
        return _first_of(list(value[2]))
    if op == sc.SUBPATTERN:
        return _first_of(list(value[3]))
    if op == sc.ATOMIC_GROUP:
        return _first_of(list(value))
    if op == sc.BRANCH:
        options = [_first_of(list(o)) for o in value[1]]
        return None if None in options else frozenset().union(*options)
    if op == sc.AT or op in ASSERTS:
        return frozenset()
    return None


def _first_of(nodes: list) -> frozenset[str] | None:
    return first_characters(nodes[0]) if nodes else frozenset()


def _class(items: list) -> frozenset[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op == sc.NEGATE:
            return None
        if op == sc.LITERAL:
            found.add(chr(value))
        elif op == sc.RANGE:
            if value[1] - value[0] + len(found) >= WIDE_CLASS:
                found.update(chr(c) for c in range(value[0], min(value[1] + 1, value[0] + WIDE_CLASS + 1)))
                if len(found) > WIDE_CLASS:
                    return None
            found.update(chr(c) for c in range(value[0], value[1] + 1))
        elif op == sc.CATEGORY:
            if value not in _CLASSES:
                return None
            found |= _CLASSES[value]
        if len(found) > WIDE_CLASS:
            return None
    return frozenset(found)


def overlap(a: frozenset[str] | None, b: frozenset[str] | None) -> bool:
    return a is None or b is None or bool(a & b)


def _ambiguous(options: list[list]) -> bool:
    """Whether alternatives under a repeat can match the same text in two ways."""
    empty = sum(not o for o in options)
    full = [_first_of(o) for o in options if o]
    if empty and (full or empty > 1):
        return True
    return any(overlap(a, b) for i, a in enumerate(full) for b in full[i + 1 :])


def _wildcards(nodes: list) -> int:
    """Greedy repeats of anything, outside of repeats and asserts."""
    total = 0
    for op, value in nodes:
        if op == sc.MAX_REPEAT:
            head = list(value[2])[:1]
            broad = bool(head) and (head[0][0] == sc.ANY or head[0][0] == sc.IN and first_characters(head[0]) is None)
            total += value[1] > 1 and broad
        elif op == sc.SUBPATTERN:
            total += _wildcards(list(value[3]))
        elif op == sc.BRANCH:
            total += sum(_wildcards(list(o)) for o in value[1])
    return total


def _issue(kind: str, severity: str, cls: str, notation: str, segment: str) -> dict:
    return {"type": kind, "severity": severity, "complexity_class": cls, "complexity_notation": notation, "segment": segment}


def features(pattern: str) -> dict:
    """Numbers and issues of a pattern."""
    out = {"error": None, "star_height": 0, "quantifiers": 0, "start_anchor": False, "end_anchor": False, "degree": 1, "exponential": 0, "issues": []}
    try:
        tree = list(sp.parse(pattern))
    except (re.error, OverflowError, RecursionError) as e:
        out["error"] = str(e)
        out["issues"] = [_issue("parse_error", "critical", "unknown", "unknown", pattern[:50])]
        return out
    issues: list[dict] = []
    nodes = [*walk(tree)]
    for node, at in nodes:
        if node[0] in REPEATS and node[1][1] > 1 and at.inside:
            issues.append(_issue("nested_quantifier", "critical", "exponential", "O(2^n)", "(...+)+"))
    for node, at in nodes:
        if node[0] == sc.BRANCH and at.repeating and _ambiguous([list(o) for o in node[1][1]]):
            issues.append(_issue("overlapping_disjunction", "critical", "exponential", "O(2^n)", "(a|a)+"))
    degree = _wildcards(tree)
    if degree >= 2:
        issues.append(_issue("greedy_chain", "critical" if degree >= 4 else "high" if degree == 3 else "medium", "polynomial", f"O(n^{degree})", f"{degree} greedy wildcards"))
        out["degree"] = degree
    references = sum(node[0] == sc.GROUPREF for node, _ in nodes)
    if references:
        issues.append(_issue("backreference", "medium", "linear", "O(n)", f"{references} back references"))
    looks = [at.asserts for node, at in nodes if node[0] in ASSERTS]
    if any(looks):
        issues.append(_issue("multiple_lookaround", "medium", "linear", "O(n)", "nested look-around"))
    elif len(looks) >= 3:
        issues.append(_issue("multiple_lookaround", "low", "linear", "O(n)", f"{len(looks)} look-arounds"))
    for node, _ in nodes:
        if node[0] in REPEATS and node[1][1] is not sc.MAXREPEAT and node[1][1] >= LARGE_REPEAT:
            issues.append(_issue("large_quantifier", "low", "linear", "O(n)", f"{{,{node[1][1]}}}"))
    begins = tree and tree[0][0] == sc.AT and tree[0][1] in (sc.AT_BEGINNING, sc.AT_BEGINNING_STRING)
    ends = tree and tree[-1][0] == sc.AT and tree[-1][1] in (sc.AT_END, sc.AT_END_STRING)
    out.update(
        star_height=max((at.height + (node[1][1] > 1) for node, at in nodes if node[0] in REPEATS), default=0),
        quantifiers=sum(node[0] in REPEATS and not at.asserts for node, at in nodes),
        start_anchor=bool(begins),
        end_anchor=bool(ends),
        exponential=sum(i["complexity_class"] == "exponential" for i in issues),
        issues=issues,
    )
    return out


FEATURES = "error string, star_height int, quantifiers int, start_anchor boolean, end_anchor boolean, degree int, exponential int, issues array<struct<type:string,severity:string,complexity_class:string,complexity_notation:string,segment:string>>"


def complexity_class(exponential: Column, degree: Column) -> Column:
    return F.when(exponential > 0, "exponential").when(degree >= 2, "polynomial").otherwise("linear")


def score(exponential: Column, degree: Column, issues: Column, star_height: Column, quantifiers: Column, anchored: Column) -> Column:
    """0 to 100 from a pattern's numbers."""
    linear = F.lit(10) + F.least(F.lit(20), issues * 5) + F.least(F.lit(10), star_height * 3) + F.least(F.lit(10), quantifiers)
    base = F.when(exponential > 0, F.least(F.lit(100), F.lit(90) + (exponential - 1) * 5)).when(degree >= 4, 80).when(degree == 3, 65).when(degree == 2, 50).otherwise(linear)
    return F.greatest(F.lit(0), base - F.when(anchored, 5).otherwise(0)).cast("int")


def risk(points: Column) -> Column:
    return F.when(points >= 85, "critical").when(points >= 70, "dangerous").when(points >= 50, "warning").when(points >= 25, "caution").otherwise("safe")


#: The older names of the risks.
LEVELS = {"safe": "very_simple", "caution": "simple", "warning": "moderate", "dangerous": "complex", "critical": "dangerous"}


def level(risk_level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), risk_level)


def operations(cls: Column, degree: Column, n: int) -> Column:
    """Estimated steps on a text of n characters, as decimal(38,0); large ones are capped."""
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    most = 10**15 if n >= 10_000 else 10**37
    out = wide(min(n**12, most))
    for d in range(11, 0, -1):
        out = F.when(degree <= d, wide(min(n**d, most))).otherwise(out)
    return F.when(cls == "linear", wide(n)).when(cls == "polynomial", out).otherwise(wide(2**50 if n <= 100 else 2**100))


def safe_for_large_files(cls: Column, degree: Column) -> Column:
    return (cls == "linear") | (cls == "polynomial") & (degree <= 2)


def report(patterns: DataFrame, column: str = "regex") -> DataFrame:
    """``patterns`` with score, risk, class, estimates, issues and advice."""

    @F.pandas_udf(FEATURES)
    def read(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(p) for p in batch.fillna("")])

    x = F.col("x")
    table = F.create_map(*(y for k, v in ADVICE.items() for y in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = patterns.withColumn("x", read(F.col(column)))
    rows = rows.withColumn("complexity_class", F.when(x["error"].isNotNull(), "unknown").otherwise(complexity_class(x["exponential"], x["degree"])))
    points = score(x["exponential"], x["degree"], F.size(x["issues"]), x["star_height"], x["quantifiers"], x["start_anchor"] & x["end_anchor"])
    rows = rows.withColumn("score", F.when(x["error"].isNotNull(), 0).otherwise(points))
    rows = rows.withColumn("risk_level", F.when(x["error"].isNotNull(), "error").otherwise(risk(F.col("score"))))
    advice = F.array_distinct(F.flatten(F.transform(x["issues"], lambda i: F.element_at(table, i["type"]))))
    usual = F.when(F.col("risk_level") == "safe", F.array(F.lit("Safe for production use"))).otherwise(F.array(F.lit("Review the pattern")))
    notation = F.when(F.col("complexity_class") == "exponential", "O(2^n)").when(F.col("complexity_class") == "polynomial", F.concat(F.lit("O(n^"), x["degree"].cast("string"), F.lit(")"))).otherwise("O(n)")
    return rows.select(
        *patterns.columns,
        "score",
        "risk_level",
        "complexity_class",
        notation.alias("complexity_notation"),
        level(F.col("risk_level")).alias("level"),
        x["star_height"].alias("star_height"),
        x["quantifiers"].alias("quantifier_count"),
        F.struct(x["start_anchor"].alias("start"), x["end_anchor"].alias("end")).alias("has_anchors"),
        *(operations(F.col("complexity_class"), x["degree"], n).alias(f"ops_at_{n}") for n in (100, 1000, 10000)),
        safe_for_large_files(F.col("complexity_class"), x["degree"]).alias("safe_for_large_files"),
        x["issues"].alias("issues"),
        F.when(F.size(advice) > 0, advice).otherwise(usual).alias("recommendations"),
        x["error"].alias("error"),
    )


def dangerous(pattern: str) -> bool:
    """Whether a search should warn that a backtracking engine may be slow on a pattern."""
    f = features(pattern)
    return f["exponential"] > 0 or f["degree"] >= 4
