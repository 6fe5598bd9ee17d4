"""Codecs: detection by name and content, decoding, sizes."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions and leading bytes of the codecs, and archive suffixes.
EXTENSIONS = {".gz": "gzip", ".gzip": "gzip", ".zst": "zstd", ".zstd": "zstd", ".xz": "xz", ".bz2": "bz2", ".bzip2": "bz2"}
MAGIC = {"gzip": b"\x1f\x8b", "zstd": b"\x28\xb5\x2f\xfd", "xz": b"\xfd7zXZ\x00", "bz2": b"BZh"}
ARCHIVES = (".tar.gz", ".tar.zst", ".tar.xz", ".tar.bz2", ".tgz", ".tzst", ".txz", ".tbz2", ".tbz")
#: Codecs that the text reader decodes by extension.
READER = {".gz", ".bz2", ".zst"}


def is_archive(path: str) -> bool:
    return path.lower().endswith(ARCHIVES)


def by_extension(path: str) -> str | None:
    return None if is_archive(path) else EXTENSIONS.get(os.path.splitext(path.lower())[1])


def by_magic(head: bytes) -> str | None:
    return next((k for k, m in MAGIC.items() if head.startswith(m)), None)


def detect(path: str) -> str | None:
    """By extension, else by the first bytes; archives are not compressed files."""
    if is_archive(path):
        return None
    if found := by_extension(path):
        return found
    try:
        with open(path, "rb") as f:
            return by_magic(f.read(6))
    except OSError:
        return None


def extension_codec(path: Column) -> Column:
    """The codec of a path by its extension, as an expression; null for archives."""
    name = F.lower(path)
    ext = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.when(~archive(path), F.element_at(table, ext))


def archive(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit(r"\.(tar\.(gz|zst|xz|bz2)|tgz|tzst|txz|tbz2|tbz)$"))


def magic_codec(content: Column) -> Column:
    """The codec of binary content by its first bytes, as an expression."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(F.substring(content, 1, len(magic)) == F.lit(magic), name).otherwise(out)
    return out


def open_decoded(data: bytes, codec: str | None):
    """A binary stream of decoded content."""
    raw = io.BytesIO(data)
    if codec is None:
        return raw
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return {"gzip": gzip.open, "bz2": bz2.open, "xz": lzma.open}[codec](raw)


def decode(data: bytes, codec: str | None) -> bytes:
    return open_decoded(data, codec).read()


def decode_to_file(path: str, target: str, codec: str | None = None) -> int:
    """Write the decoded content of a file; its size."""
    with open(path, "rb") as f, open(target, "wb") as out:
        return out.write(decode(f.read(), codec or detect(path)))


def available() -> dict[str, bool]:
    """Which codecs can be decoded here."""
    try:
        import zstandard  # noqa: F401

        zstd = True
    except ImportError:
        zstd = False
    return {"gzip": True, "bz2": True, "xz": True, "zstd": zstd}


def gzip_size(tail: bytes) -> int:
    """The decoded size modulo 2**32 from the last four bytes of a gzip file."""
    return struct.unpack("<I", tail[-4:])[0]


def decoded_size(path: str) -> int | None:
    """The decoded size that a file itself states: gzip's trailer; unknown for others."""
    if detect(path) != "gzip" or os.path.getsize(path) < 4:
        return None
    with open(path, "rb") as f:
        f.seek(-4, os.SEEK_END)
        return gzip_size(f.read())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            codec = by_extension(path) or by_magic(data[:6])
            rows, line_no, at = [], 0, 0
            try:
                for raw in open_decoded(data, codec):
                    line_no += 1
                    line = raw.removesuffix(b"\n")
                    rows.append((path, line_no, at, len(line), line.decode("utf-8", "replace")))
                    at += len(raw)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            except (OSError, EOFError, lzma.LZMAError, ValueError):
                pass  # a damaged file gives the lines before the damage
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "line_no", "byte_offset", "n_bytes", "line"])


def lines_of_compressed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of compressed files of any codec, also those known by content only.

    A compressed stream is read by one task; framed files (:mod:`seekable`) are not.
    """
    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return content.mapInArrow(_lines, "file string, line_no long, byte_offset long, n_bytes long, line string")
