"""Framed (seekable) zstd files: reading frames in parallel, writing, and their indexes.

The layout is the public seekable format: independent zstd frames, then a skippable frame
with a table of sizes and a footer of nine bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpuslens.options import EngineOptions
from corpuslens.sources import codecs

#: Fixed values of the seekable format.
FOOTER_MAGIC = 0x8F92EAB1
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER = "<IBI"  # frames, descriptor, magic
FOOTER_SIZE = 9
CHECKSUM_FLAG = 0x80
FRAME_SCHEMA = "file string, frame int, compressed_offset long, compressed_size long, decoded_offset long, decoded_size long"
LINES = "file string, line_no long, byte_offset long, n_bytes long, line string, frame int"


@dataclass(frozen=True)
class Frame:
    frame: int
    compressed_offset: int
    compressed_size: int
    decoded_offset: int
    decoded_size: int


def is_seekable(path: str) -> bool:
    """A ``.zst`` file that ends in the footer's magic number."""
    try:
        if not path.lower().endswith((".zst", ".zstd")) or os.path.getsize(path) < FOOTER_SIZE:
            return False
        with open(path, "rb") as f:
            f.seek(-FOOTER_SIZE, os.SEEK_END)
            return struct.unpack(FOOTER, f.read())[2] == FOOTER_MAGIC
    except OSError:
        return False


def parse_table(tail: bytes) -> list[Frame]:
    """Frames from the end of a file; ValueError if that holds no whole table."""
    if len(tail) < FOOTER_SIZE:
        raise ValueError("no seek table")
    count, descriptor, magic = struct.unpack(FOOTER, tail[-FOOTER_SIZE :])
    entry = 12 if descriptor & CHECKSUM_FLAG else 8
    size = count * entry
    if magic != FOOTER_MAGIC or len(tail) < size + FOOTER_SIZE:
        raise ValueError("no seek table")
    table = tail[len(tail) - FOOTER_SIZE - size : len(tail) - FOOTER_SIZE]
    frames, compressed, decoded = [], 0, 0
    for i in range(count):
        c, d = struct.unpack_from("<II", table, i * entry)
        frames.append(Frame(i, compressed, c, decoded, d))
        compressed, decoded = compressed + c, decoded + d
    return frames


def read_table(path: str) -> list[Frame]:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(max(0, size - FOOTER_SIZE))
        count, descriptor, magic = struct.unpack(FOOTER, f.read(FOOTER_SIZE)) if size >= FOOTER_SIZE else (0, 0, 0)
        if magic != FOOTER_MAGIC:
            raise ValueError(f"no seek table: {path}")
        need = count * (12 if descriptor & CHECKSUM_FLAG else 8) + FOOTER_SIZE
        f.seek(max(0, size - need))
        return parse_table(f.read())


def frame_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, frame, offsets and sizes) of framed files, from their seek tables."""
    rows = [(p, f.frame, f.compressed_offset, f.compressed_size, f.decoded_offset, f.decoded_size) for p in paths for f in read_table(p)]
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def read_frames(path: str, frames: list[Frame]) -> Iterator[bytes]:
    """Decoded content of some frames."""
    import zstandard

    decoder = zstandard.ZstdDecompressor()
    with open(path, "rb") as f:
        for x in frames:
            f.seek(x.compressed_offset)
            yield decoder.decompress(f.read(x.compressed_size), max_output_size=max(1, x.decoded_size))


def read_range(path: str, start: int, length: int) -> bytes:
    """Decoded bytes [start, start + length); only frames that share a byte are read."""
    frames = [x for x in read_table(path) if x.decoded_offset < start + length and x.decoded_offset + x.decoded_size > start]
    if not frames:
        return b""
    data = b"".join(read_frames(path, frames))
    at = start - frames[0].decoded_offset
    return data[at : at + length]


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at least ``size`` bytes that end with a line, but for the last."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            end = data.find(b"\n", end - 1) + 1 or len(data)
        yield data[at:end]
        at = end


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the table of (compressed, decoded) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack(FOOTER, len(sizes), 0, FOOTER_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def write(spark: SparkSession, source: str, target: str, options: EngineOptions = EngineOptions(), progress: Callable[[int, int], None] | None = None) -> list[Frame]:
    """Re-encode a text or compressed file into frames of whole lines.

    Frames are encoded by parallel tasks; the driver appends them in order, one at a time,
    and writes the table. ``progress`` hears of (frames done, frames in all).
    """
    target = target if target.endswith(".zst") else f"{target}.zst"
    with open(source, "rb") as f:
        data = codecs.decode(f.read(), codecs.detect(source))
    parts = [(i, p) for i, p in enumerate(_pieces(data, options.frame_bytes))]
    level = options.compression_level

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = zstandard.ZstdCompressor(level=level)
        for b in batches:
            done = [encoder.compress(x) for x in b.column("data").to_pylist()]
            yield pa.record_batch([b.column("frame"), pa.array(done, pa.binary()), pa.array([len(x) for x in b.column("data").to_pylist()], pa.int64())], names=["frame", "data", "size"])

    sizes = []
    with open(target, "wb") as out:
        if parts:
            rows = spark.createDataFrame(parts, "frame int, data binary").repartitionByRange(max(1, min(len(parts), 64)), "frame")
            for r in rows.mapInArrow(encode, "frame int, data binary, size long").orderBy("frame").toLocalIterator():
                out.write(r["data"])
                sizes.append((len(r["data"]), r["size"]))
                if progress:
                    progress(len(sizes), len(parts))
        out.write(seek_table(sizes))
    return read_table(target)


def count_lines(path: str) -> list[tuple[int, int]]:
    """(frame, line ends) of each frame; text after the last one counts as a line."""
    frames = read_table(path)
    out, last = [], b"\n"
    for x, data in zip(frames, read_frames(path, frames), strict=True):
        out.append((x.frame, data.count(b"\n")))
        last = data[-1:] or last
    if out and last != b"\n":
        out[-1] = (out[-1][0], out[-1][1] + 1)
    return out


class FrameBatch(InputPartition):
    def __init__(self, path: str, frames: list[Frame], first: bool) -> None:
        self.path, self.frames, self.first = path, frames, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        self.size = int(options.get("framesPerBatch", EngineOptions().frames_per_batch))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            frames = read_table(p)
            out += [FrameBatch(p, frames[i : i + self.size], i == 0) for i in range(0, len(frames), self.size)]
        return out

    def read(self, part: FrameBatch) -> Iterator[tuple]:
        """Whole lines that start in the batch's frames; a line that goes on is read on.

        Line numbers count within the batch; :func:`lines_of_seekable` makes them the file's.
        """
        every = read_table(part.path)
        at = part.frames[0].decoded_offset
        data = b"".join(read_frames(part.path, part.frames))
        skip = 0
        if not part.first:
            before = next(read_frames(part.path, [every[part.frames[0].frame - 1]]))
            if not before.endswith(b"\n"):
                skip = data.find(b"\n") + 1 or len(data)
        for x in every[part.frames[-1].frame + 1 :]:
            if data.endswith(b"\n"):
                break
            more = next(read_frames(part.path, [x]))
            end = more.find(b"\n") + 1
            data += more[:end] if end else more
        starts = [x.decoded_offset for x in part.frames]
        k, number = 0, 0
        for raw in _split(data[skip:]):
            place = at + skip
            while k + 1 < len(starts) and starts[k + 1] <= place:
                k += 1
            number += 1
            line = raw.removesuffix(b"\n")
            yield part.path, number, place, len(line), line.decode("utf-8", "replace"), part.frames[k].frame
            skip += len(raw)


def _split(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = data.find(b"\n", at) + 1 or len(data)
        yield data[at:end]
        at = end


class SeekableSource(DataSource):
    """Format ``seekable_zstd``: lines of framed files, a partition for each batch of frames."""

    @classmethod
    def name(cls) -> str:
        return "seekable_zstd"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def lines_of_seekable(spark: SparkSession, paths: list[str], frames_per_batch: int = 100) -> DataFrame:
    """The relation of lines of framed files, with each line's frame.

    A batch numbers its own lines; what earlier batches hold comes from one row a batch.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    spark.dataSource.register(SeekableSource)
    raw = spark.read.format("seekable_zstd").option("paths", ",".join(paths)).option("framesPerBatch", frames_per_batch).load()
    rows = raw.withColumn("batch", F.floor(F.col("frame") / frames_per_batch))
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("file").alias("f"), F.col("batch").alias("b")).agg(F.max("line_no").alias("lines"))
    starts = counts.withColumn("start", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    both = rows.join(starts, (F.col("file") == F.col("f")) & (F.col("batch") == F.col("b")))
    return both.select("file", (F.col("line_no") + F.col("start")).alias("line_no"), "byte_offset", "n_bytes", "line", "frame")
