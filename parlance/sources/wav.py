"""WAV files of any size as a Spark data source: ranges of bytes are partitions, and blocks of samples are rows.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("path", folder).load()                          # blocks
    spark.read.format("wav").option("path", folder).option("headers", "true").load()  # a row for each file

Only names and sizes are needed to plan: a task reads the header of each file it has a range of, and takes the blocks
whose first byte lies there, as lines are taken from splits of a text. A block is a whole number of seconds, so that blocks
begin at the same time in files of any rate; it comes with some samples of its neighbours (`HALO` seconds and `MORE` samples), so that filters
need no other row. Small files share a partition.

Files are listed by name, `*.wav` (any case) in one folder or a single file, through the file systems that pyarrow knows (local and shared
paths, hdfs, s3, gs). What is no PCM file has a row with its error, and no samples. Sizes in a header that the
file contradicts (as those of files beyond 4 GB) give way to the file's.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parlance.session import ship

SECONDS, SPLIT = 30, 64 << 20
#: Samples of the neighbours on each side, in seconds and in number.
HALO, MORE = 0.04, 64

HEADERS = "file string, path string, sample_rate int, channels int, n_frames long, duration double, error string"
BLOCKS = "file string, path string, sample_rate int, n_frames long, block long, start long, lead int, length int, waveform array<float>, error string"


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    width: int
    offset: int
    frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def header(f, size: int) -> Header:
    """The header of an open file of so many bytes; a ValueError says what is wrong with it."""
    if f.read(4) not in (b"RIFF", b"RF64") or len(f.read(4)) < 4 or f.read(4) != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while True:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("no samples in the file" if form else "no format in the file")
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            form = f.read(min(length, 40))
        elif name == b"data":
            break
        at += 8 + length + length % 2
    if form is None or len(form) < 16:
        raise ValueError("no format in the file")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == 0xFFFE and len(form) >= 26:
        tag = struct.unpack("<H", form[24:26])[0]
    if tag != 1 or bits not in (8, 16, 24, 32) or not channels or not rate:
        raise ValueError(f"not PCM: format {tag}, {bits} bits, {channels} channels, {rate} a second")
    rest = size - at - 8
    # a size that was left open, or is beyond the file's end, is the file's
    frames = (rest if length in (0, 0xFFFFFFFF) or length > rest else length) // (channels * bits // 8)
    return Header(rate, channels, bits // 8, at + 8, frames)


def samples(data: bytes, width: int, channels: int) -> np.ndarray:
    """Samples by channels, between -1 and 1."""
    if width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        x = (np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32) @ np.array([1 << 8, 1 << 16, 1 << 24], np.int32)).astype(np.float32) / 2**31
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels)


@dataclass
class Ranges(InputPartition):
    """(path, file size, first byte, end) of each range of a partition."""

    ranges: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.seconds = int(options.get("seconds", SECONDS))
        self.split = int(options.get("split", SPLIT))
        self.headers = options.get("headers", "false") == "true"

    def _files(self) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:/") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        return system, sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".wav"))

    def partitions(self) -> list[Ranges]:
        _, files = self._files()
        step = 1 << 62 if self.headers else self.split
        out, room = [], 0
        for path, size in files:
            for first in range(0, max(1, size), step):
                end = min(size, first + step)
                # a header costs about as much as 64 kB
                cost = (1 << 16) + (0 if self.headers else end - first)
                if not out or room < cost:
                    out.append(Ranges([]))
                    room = self.split
                out[-1].ranges.append((path, size, first, end))
                room -= cost
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if not partition.ranges:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:/") else fs.LocalFileSystem()
        for path, size, first, end in partition.ranges:
            name = path.rpartition("/")[2]
            try:
                with system.open_input_file(path) as f:
                    h = header(f, size)
                    if self.headers:
                        yield _batch(HEADERS, name, path, h.rate, h.channels, h.frames, h.frames / h.rate, None)
                        continue
                    for row in blocks(f, h, first, end, self.seconds):
                        yield _batch(BLOCKS, name, path, h.rate, h.frames, *row, None)
            except (ValueError, OSError) as e:
                if first == 0:
                    yield _batch(HEADERS, name, path, None, None, None, None, str(e)) if self.headers else _batch(BLOCKS, name, path, None, None, 0, 0, 0, 0, np.zeros(0, np.float32), str(e))


def blocks(f, h: Header, first: int, end: int, seconds: int) -> Iterator[tuple]:
    """(block, start, lead, length, waveform) of an open file's blocks whose first byte is from `first` on and before `end`."""
    long, halo = seconds * h.rate, int(HALO * h.rate) + MORE
    byte = lambda b: h.offset + b * long * h.frame
    # a file without samples has one block without any
    for b in range(-(-max(0, first - h.offset) // (long * h.frame)), max(1, -(-h.frames // long))):
        if byte(b) >= end and not (b == 0 and first == 0):
            return
        if byte(b) < first:
            continue
        a, z = b * long, min(h.frames, (b + 1) * long)
        lo, hi = max(0, a - halo), min(h.frames, z + halo)
        f.seek(h.offset + lo * h.frame)
        x = samples(f.read((hi - lo) * h.frame), h.width, h.channels).mean(1).astype(np.float32)
        yield b, a, a - lo, z - a, x


def _batch(schema: str, *values) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], types[k]) for v, k in zip(values, kinds, strict=True)], names=list(names))


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false") == "true" else BLOCKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_blocks(spark: SparkSession, path: str, seconds: int = SECONDS, split: int = SPLIT) -> DataFrame:
    """BLOCKS of the files of a folder. `waveform` has `length` samples from sample `start` on, behind `lead` samples before them, and some after them."""
    ship(spark).dataSource.register(WavSource)
    return spark.read.format("wav").options(path=path, seconds=seconds, split=split).load()


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADERS of the files of a folder, whose samples aren't read."""
    ship(spark).dataSource.register(WavSource)
    return spark.read.format("wav").options(path=path, headers="true").load()


def blocks_of(contents: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """BLOCKS of files that are rows `file, content`; their path is their name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True):
                f = io.BytesIO(content)
                try:
                    h = header(f, len(content))
                    for row in blocks(f, h, 0, len(content), seconds):
                        yield _batch(BLOCKS, name, name, h.rate, h.frames, *row, None)
                except ValueError as e:
                    yield _batch(BLOCKS, name, name, None, None, 0, 0, 0, 0, np.zeros(0, np.float32), str(e))

    return contents.select("file", "content").mapInArrow(run, BLOCKS)
