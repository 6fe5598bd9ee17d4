"""Files before they are read: resolving, listing, sniffing, validating, the sandbox."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.options import EngineOptions
from corpuslens.sources import codecs

SNIFF_BYTES = 8_192


def looks_like_text(head: bytes) -> bool:
    """No NUL among the first bytes; an empty file is text."""
    return b"\0" not in head[:SNIFF_BYTES]


def is_text_content(content: Column) -> Column:
    """The same test as an expression over binary content."""
    return ~F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\0"))


def is_text_file(path: str) -> bool:
    """Whether a file can be read and looks like text."""
    try:
        with open(path, "rb") as f:
            return looks_like_text(f.read(SNIFF_BYTES))
    except OSError:
        return False


def validate_file(path: str) -> None:
    """Raise unless the path is a regular file that holds text or a known codec."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not os.path.isfile(path):
        raise ValueError(f"not a regular file: {path}")
    if not is_text_file(path) and codecs.detect(path) is None:
        raise ValueError(f"not a text file: {path}")


def scan_directory(root: str, max_files: int = 1_000) -> tuple[list[str], list[str]]:
    """(text files, skipped files) below a folder, in name order; links are not followed."""
    text, skipped = [], []
    for folder, below, names in os.walk(root):
        below.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.islink(path):
                continue
            if len(text) + len(skipped) >= max_files:
                return text, skipped
            (text if is_text_file(path) or codecs.detect(path) else skipped).append(path)
    return text, skipped


def resolve(paths: Iterable[str], options: EngineOptions = EngineOptions()) -> tuple[list[str], list[str]]:
    """(files, skipped) of files and folders; a file named twice is listed once."""
    files, skipped = [], []
    for path in paths:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if os.path.isdir(path):
            found, not_text = scan_directory(path, options.max_files)
            files += found
            skipped += not_text
        else:
            try:
                validate_file(path)
                files.append(path)
            except ValueError:
                skipped.append(path)
    return [*dict.fromkeys(files)], [*dict.fromkeys(skipped)]


def file_table(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, size, modified_at, created_at, mode, owner, codec, is_text) of listed files."""

    def rows() -> Iterator[tuple]:
        for p in paths:
            s = os.stat(p)
            try:
                owner = Path(p).owner()
            except (KeyError, OSError):
                owner = str(s.st_uid)
            yield p, s.st_size, datetime.fromtimestamp(s.st_mtime).isoformat(), datetime.fromtimestamp(s.st_ctime).isoformat(), oct(s.st_mode)[-3:], owner, codecs.detect(p), is_text_file(p)

    return spark.createDataFrame([*rows()], "path string, size long, modified_at string, created_at string, mode string, owner string, codec string, is_text boolean")


class Sandbox:
    """Roots that paths must lie under once links and ``..`` are resolved; none: no limit."""

    def __init__(self, roots: Iterable[str] = ()) -> None:
        self.roots = [*dict.fromkeys(Path(r).resolve() for r in roots)]
        for r in self.roots:
            if not r.is_dir():
                raise ValueError(f"search root is not a folder: {r}")

    def holds(self, path: str) -> bool:
        where = Path(path).resolve()
        return not self.roots or any(where == r or r in where.parents for r in self.roots)

    def check(self, paths: Iterable[str]) -> list[str]:
        """The resolved paths; PermissionError if one lies outside."""
        for p in paths:
            if not self.holds(p):
                raise PermissionError(f"outside the search roots: {p}")
        return [str(Path(p).resolve()) for p in paths]


def large(size: Column, options: EngineOptions = EngineOptions()) -> Column:
    return size >= options.large_file_bytes


def worth_caching(size: Column, codec: Column, options: EngineOptions = EngineOptions()) -> Column:
    """Large plain files, and compressed ones from a lower size on."""
    return F.when(codec.isNull(), large(size, options)).otherwise(size >= options.compressed_cache_bytes)
