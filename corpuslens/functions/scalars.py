"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(n: Column) -> Column:
    """Bytes with a unit of 1024s and two decimals, exact halves to the even digit."""
    value = n.cast("double")
    out = F.format_string("%.2f PB", F.bround(value / 1024.0**5, 2))
    for i in reversed(range(5)):
        out = F.when(value < 1024.0 ** (i + 1), F.format_string(f"%.2f {UNITS[i]}", F.bround(value / 1024.0**i, 2))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of ``4M``, ``10MB``, ``1.5G`` or a plain number; null if it is none of these."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)B?$", 1)
    unit = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)B?$", 2)
    power = F.element_at(F.create_map(*(x for i, u in enumerate(("", "K", "M", "G", "T", "P")) for x in (F.lit(u), F.lit(1024.0**i)))), unit)
    return F.when(number != "", (number.cast("double") * power).cast("long"))


def blank(line: Column) -> Column:
    """Nothing but white space, in the sense of Unicode."""
    return F.rlike(line, F.lit(r"(?U)^\s*$"))


def cells(low: Column, high: Column, size: int) -> Column:
    """The numbers of the cells of ``size`` that the range low to high, both included, meets.

    A value lies in the cell floor(value / size), so a range join on it is an equality join
    on the cell, and one long file is many tasks. An empty range gives no cell.
    """
    first, last = F.floor(low / size), F.floor(high / size)
    return F.when(last >= first, F.sequence(first, last))


def strip_line_end(line: Column) -> Column:
    return F.regexp_replace(line, r"[\r\n]+$", "")


def match_key(pattern: Column, file: Column, offset: Column) -> Column:
    return F.concat_ws(":", pattern, file.cast("string"), offset.cast("string"))


def split_key(key: Column) -> Column:
    """struct<pattern, file, offset> of a match key."""
    parts = F.split(key, ":", 3)
    return F.struct(parts[0].alias("pattern"), parts[1].alias("file"), parts[2].cast("long").alias("offset"))


def path_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w.\-]", "_")


def int_list(text: Column) -> Column:
    """Numbers of a comma-separated list; what is no number is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shown_line(absolute: Column, relative: Column) -> Column:
    """The absolute line number, else the relative one, else -1."""
    return F.coalesce(F.nullif(absolute, F.lit(-1).cast("long")), relative, F.lit(-1).cast("long"))


def context_size(side: Column, both: Column, default: int = 3) -> Column:
    return F.coalesce(side, both, F.lit(default))


def iso_time(ts: Column) -> Column:
    """Local time as ISO text, without a fraction of zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def ratio(size: Column, decoded: Column) -> Column:
    return F.when(size > 0, decoded.cast("double") / size)


def query_string(payload: dict[str, Column]) -> Column:
    """URL query parameters of a payload."""
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in payload.items()))
