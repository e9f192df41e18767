"""Folders of audio files as tables: streams of samples, tags and formats.

``SoundSource`` is a Python data source ("sound"): one task reads one range of a file's frames. With the option pushdown
"true", which needs spark.sql.python.filterPushdown.enabled, filters on frame_idx choose the ranges. Files that can't be decoded give no rows unless ``strict`` is "true".
``write_sounds`` writes one file for each stream. The other functions map over Spark's binaryFile source, in batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThan

from tonearm.sources import containers, tags

SCHEMA = "path string, rate int, channels int, bits int, frame_idx bigint, channel int, sample int"
#: Frames of a task's range.
RANGE = 1 << 20


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(str(p) for p in Path(options["path"]).rglob("*") if p.suffix[1:].lower() in containers.READERS) if os.path.isdir(options["path"]) else [options["path"]]
        self.strict = options.get("strict", "false") == "true"
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            most = min(self.high, os.path.getsize(path))  # a frame has a byte at least
            out += [_Range(path, a, min(a + RANGE, most)) for a in range(self.low, most, RANGE)] if most > self.low else []
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        try:
            sound = decode(Path(part.path).read_bytes(), Path(part.path).suffix[1:].lower())
        except ValueError:
            if self.strict:
                raise
            return
        for first in range(part.first, min(part.last, len(sound.samples)), 65536):
            block = sound.samples[first : min(first + 65536, part.last)]
            n, c = block.shape
            fixed = [pa.array([v] * (n * c), t) for v, t in ((part.path, pa.string()), (sound.rate, pa.int32()), (c, pa.int32()), (sound.bits, pa.int32()))]
            where = [pa.array(np.repeat(np.arange(first, first + n), c), pa.int64()), pa.array(np.tile(np.arange(c), n), pa.int32())]
            yield pa.RecordBatch.from_arrays([*fixed, *where, pa.array(block.reshape(-1), pa.int32())], ["path", "rate", "channels", "bits", "frame_idx", "channel", "sample"])


class _PushedReader(_Reader):
    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("frame_idx",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("frame_idx",):
                self.high = min(self.high, f.value)
            else:
                yield f


class SoundSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return (_PushedReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))


def decode(data: bytes, kind: str | None = None) -> containers.Sound:
    """The stream of a file, its format taken from its content where the suffix doesn't tell."""
    data = data[tags.id3v2_size(data) :]
    kind = kind if kind in containers.READERS else tags.sniff(data)
    if kind not in containers.READERS:
        raise ValueError("no known container of whole samples")
    return containers.READERS[kind](data)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def formats(found: DataFrame) -> DataFrame:
    """path and format (null if unknown) of binary files with the columns path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([tags.sniff(x) if x else None for x in b.column("content").to_pylist()], pa.string())], ["path", "format"])

    return found.select("path", "content").mapInArrow(run, "path string, format string")


def tag_items(found: DataFrame, kind: str) -> DataFrame:
    """path, pos, key and value of the items of the tags of one kind (id3v1, id3v2, vorbis, ape) in binary files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, k, v) for p, x in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for i, (k, v) in enumerate(tags.READERS[kind](x or b""))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "pos", "key", "value"])

    return found.select("path", "content").mapInArrow(run, "path string, pos int, key string, value string")


def encoded(samples: DataFrame, stream: str, kind: str, rate: int, bits: int) -> DataFrame:
    """``stream`` and content: a file for each stream of (stream, frame_idx, channel, sample). A file is one value, so a
    stream is gathered in one task, as any file is. A stream with samples beyond ``bits`` gets a wider file."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame_idx", "ascending"), ("channel", "ascending")])
        channels = len(set(table.column("channel").to_pylist()))
        block = table.column("sample").to_numpy().reshape(-1, channels)
        data = containers.WRITERS[kind](containers.Sound(rate, containers.width(block, bits), 0, block))
        return pa.table({stream: table.column(stream).slice(0, 1), "content": pa.array([data], pa.binary())})

    kind_of = samples.schema[stream].dataType.simpleString()
    return samples.select(stream, "frame_idx", "channel", "sample").groupBy(stream).applyInArrow(run, f"{stream} {kind_of}, content binary")


def decoded(blobs: DataFrame, key: str, kind: str) -> DataFrame:
    """``key``, frame_idx, channel and sample of the files in the column content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column(key), b.column("content").to_pylist()):
                block = decode(data, kind).samples
                n, c = block.shape
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * (n * c), k.type), pa.array(np.repeat(np.arange(n), c), pa.int64()), pa.array(np.tile(np.arange(c), n), pa.int32()), pa.array(block.reshape(-1), pa.int64())], [key, "frame_idx", "channel", "sample"])

    kind_of = blobs.schema[key].dataType.simpleString()
    return blobs.select(key, "content").mapInArrow(run, f"{key} {kind_of}, frame_idx bigint, channel int, sample bigint")


def write_sounds(samples: DataFrame, stream: str, folder: str, kind: str = "wav", rate: int = 44100, bits: int = 16) -> int:
    """Writes one file for each stream into a shared folder and returns how many; a file appears whole or not at all."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for name, data in zip(b.column(stream).to_pylist(), b.column("content").to_pylist()):
                part = Path(folder, f".{name}.{os.getpid()}")
                part.write_bytes(data)
                part.rename(Path(folder, f"{name}.{kind}"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return encoded(samples, stream, kind, rate, bits).mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0
