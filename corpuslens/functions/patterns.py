"""Patterns: from the dialect of a line scanner to the engine's, checked before planning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuslens.options import SearchOptions

#: Scripts that Java names with the prefix Is.
SCRIPTS = ("Greek", "Cyrillic", "Latin", "Han", "Hiragana", "Katakana", "Arabic", "Hebrew", "Thai", "Hangul", "Devanagari")


def quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+(){}\[\]\-&~#])", r"\\\1", text)


def translate(pattern: str, options: SearchOptions = SearchOptions()) -> str:
    """The Java expression of a pattern with its flags.

    ``.`` and ``$`` see only ``\\n`` as a line end; classes and boundaries are Unicode ones
    unless ``ascii``; named groups and script names get Java's spelling.
    """
    if options.fixed:
        body = quote(pattern)
    else:
        body = pattern.replace("(?P<", "(?<")
        body = re.sub(rf"\\([pP])\{{({'|'.join(SCRIPTS)})\}}", r"\\\1{Is\2}", body)
        if re.match(r"\(\?[a-z]*U", body):
            raise ValueError("the flag U has no counterpart")
    if options.word:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    if options.whole_line:
        body = f"^(?:{body})$"
    flags = "d" + ("" if options.ascii else "U") + ("i" + ("" if options.ascii else "u") if options.ignore_case else "")
    return f"(?{flags}){body}"


_LOOKS = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:=|!|<=|<!)|\\[1-9])")


def validate(spark: SparkSession, patterns: list[str], options: SearchOptions = SearchOptions()) -> list[str]:
    """The Java expressions; ValueError names the pattern that cannot be compiled.

    Compiling on the driver keeps a bad pattern from failing in a task.
    """
    out = []
    for p in patterns:
        if not options.fixed and not options.look_around and _LOOKS.search(p):
            raise ValueError(f"Invalid regex pattern: {p}: look-around and back references need look_around")
        java = translate(p, options)
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise ValueError(f"Invalid regex pattern: {p}") from e
        out.append(java)
    return out


@dataclass(frozen=True)
class Patterns:
    """Patterns by their ids p1, p2, ... in the order given."""

    ids: dict[str, str]
    java: dict[str, str]
    options: SearchOptions

    @classmethod
    def of(cls, spark: SparkSession, patterns: list[str], options: SearchOptions = SearchOptions()) -> Patterns:
        ids = {f"p{i}": p for i, p in enumerate(patterns, 1)}
        return cls(ids, dict(zip(ids, validate(spark, patterns, options), strict=True)), options)

    def hit(self, line: Column, pattern_id: str) -> Column:
        """Whether the line has a match of the pattern; a plain string needs no expression."""
        o = self.options
        if o.fixed and not (o.ignore_case or o.word or o.whole_line):
            return F.contains(line, F.lit(self.ids[pattern_id]))
        return F.rlike(line, F.lit(self.java[pattern_id]))

    def any_hit(self, line: Column) -> Column:
        out = F.lit(False)
        for p in self.ids:
            out = out | self.hit(line, p)
        return out
