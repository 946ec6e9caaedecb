"""WAV files as tables of frames.

    spark.dataSource.register(WavFrames)
    spark.read.format("wav_frames").option("size", 8192).option("hop", 2048).load(folder)

A file is read in parts of so many bytes, each with the overlap that its frames need, so one
long file is many tasks. Files are opened by pyarrow, which knows local and remote stores.

Samples follow the files' readers elsewhere: one channel of 16 or 32 bits is scaled to -1 to 1 (24
bits count as the upper ones of 32); other kinds stay as they are; of several channels the
mean is taken, which is not scaled.

Options: size and hop (samples; hop is size if not given), pad (true: also the last, shorter
frame), every (seconds: frames around its multiples instead of hop, from the start on where
early, with zeros past the end), part (bytes of a task, 8 MB). Files without samples have no
frames; files that are no WAV are errors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sample_rate int, frame_idx long, start long, samples array<double>"
# Format of samples -> how numpy reads them.
KINDS = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}
SCALES = {(1, 16): 32768.0, (1, 24): 2147483648.0, (1, 32): 2147483648.0}


def header(file) -> tuple[int, int, int, int, int, int]:
    """(rate, channels, format, bits, where samples begin, samples of a channel)."""
    file.seek(0)
    if len(head := file.read(12)) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no WAV file")
    size, at, form = file.size(), 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            raw = file.read(length)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            form = rate, channels, struct.unpack("<H", raw[24:26])[0] if kind == 0xFFFE else kind, bits
        elif name == b"data":
            if form is None:
                raise ValueError("no format before the samples")
            rate, channels, kind, bits = form
            return rate, channels, kind, bits, at + 8, min(length, size - at - 8) // (channels * bits // 8)
        at += 8 + length + length % 2
    raise ValueError("no samples in the WAV file")


def samples(file, form: tuple, first: int, n: int) -> np.ndarray:
    """n samples from the first on, as far as there are."""
    _, channels, kind, bits, at, count = form
    n = max(0, min(n, count - first))
    width = channels * bits // 8
    file.seek(at + first * width)
    raw = file.read(n * width)
    if (kind, bits) == (1, 24):
        x = np.zeros((n * channels, 4), np.uint8)
        x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = x.view("<i4")[:, 0]
    elif (kind, bits) in KINDS:
        x = np.frombuffer(raw, KINDS[kind, bits])
    else:
        raise ValueError(f"samples of format {kind} with {bits} bits are not known")
    x = x.astype(np.float64)
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x / SCALES.get((kind, bits), 1.0)


class Part(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("size", 8192))
        self.hop = int(options.get("hop", self.size))
        self.pad = str(options.get("pad", "false")).lower() == "true"
        self.every = float(options["every"]) if "every" in options else None
        self.part = int(options.get("part", 8 << 20))
        if self.size < 1 or self.hop < 1 or self.part < 1:
            raise ValueError("size, hop and part have to be positive")

    def partitions(self) -> list[Part]:
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.is_file and f.extension.lower() == "wav"), key=lambda f: f.path)
        return [Part(f.path, k) for f in files for k in range(max(1, -(-f.size // self.part)))]

    def frames(self, form: tuple, number: int) -> Iterator[tuple[int, int]]:
        """(index, first sample) of the frames that begin in a part."""
        rate, channels, _, bits, _, count = form
        each = max(1, self.part // (channels * bits // 8))
        low, high = number * each, (number + 1) * each
        if self.every is None:
            last = count - 1 if self.pad else count - self.size
            for k in range(-(-low // self.hop), -(-min(high, last + 1) // self.hop)):
                yield k, k * self.hop
            return
        k = max(0, int(low / rate / self.every) - 1)
        while k * self.every * rate < count:
            at = int(k * self.every * rate)
            if at >= high:
                break
            if at >= low:
                yield k, max(0, at - self.size // 2)
            k += 1

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        kinds = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("frame_idx", pa.int64()), ("start", pa.int64()), ("samples", pa.list_(pa.float64()))])
        with fs.open_input_file(partition.path) as file:
            form = header(file)
            held = []

            def batch() -> pa.RecordBatch:
                first, end = min(s for _, s in held), max(s for _, s in held) + self.size
                x = samples(file, form, first, end - first)
                x = np.concatenate((x, np.zeros(end - first - len(x))))
                rows = [x[s - first : s - first + self.size] for _, s in held]
                columns = [[partition.path] * len(held), [form[0]] * len(held), [k for k, _ in held], [s for _, s in held], rows]
                return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

            for frame in self.frames(form, partition.number):
                held.append(frame)
                if len(held) * self.size >= 1 << 18:
                    yield batch()
                    held = []
            if held:
                yield batch()


class WavFrames(DataSource):
    """The frames of WAV files: path, sample_rate, frame_idx, start and samples."""

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
