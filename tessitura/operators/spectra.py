"""Frames, spectra and peaks of signals, on arrays in Arrow batches; each row stands for itself, so nothing is shuffled.

Null or short signals have no frames; null elements count as 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators import peaks as curve


def window(kind: str, n: int) -> np.ndarray:
    """hann (periodic), hanning and hamming (symmetric)."""
    if n == 1:
        return np.ones(1)
    turn = 2 * np.pi * np.arange(n) / (n if kind == "hann" else n - 1)
    return 0.54 - 0.46 * np.cos(turn) if kind == "hamming" else 0.5 - 0.5 * np.cos(turn)


def framed(signals: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """A row for each whole frame of a signal, with frame_idx from 0 and its samples as ``frame``; other columns are kept but for these names."""
    n = F.floor((F.size(samples) - size) / hop).cast("int")
    rows = signals.drop("frame_idx", "frame").where(F.size(samples) >= size)
    rows = rows.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), n)))
    return rows.withColumn("frame", F.slice(samples, F.col("frame_idx") * hop + 1, size))


def each(df: DataFrame, column: str, into: str, fn, spark_type: str = "array<double>", kind: pa.DataType = pa.list_(pa.float64())) -> DataFrame:
    """df with a column made of an array by rows; fn(matrix of rows of equal length) -> a value for each. Null and empty arrays give null."""
    df = df.drop(into)
    names = df.columns
    at = names.index(column)
    schema = df.select("*", F.expr(f"cast(null as {spark_type}) as `{into}`")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(at)
            flat = rows.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
            lengths = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            out: list = [None] * len(rows)
            for n in np.unique(lengths[lengths > 0]):
                where = np.flatnonzero(lengths == n)
                for k, x in zip(where, fn(flat[starts[where][:, None] + np.arange(n)]), strict=True):
                    out[k] = x
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.record_batch([*columns, pa.array(out, kind)], names=[*names, into])

    return df.mapInArrow(run, schema)


def spectrum(frames: DataFrame, samples: str, into: str = "mags", kind: str | None = None, pad: int = 1) -> DataFrame:
    """Magnitudes of the lower half of the Fourier transform of each windowed frame, with zeros after it up to ``pad`` times its length."""
    return each(frames, samples, into, lambda x: np.abs(np.fft.rfft(x * (window(kind, x.shape[1]) if kind else 1.0), x.shape[1] * pad)))


def bin_hz(k: Column, rate: float, fft: int) -> Column:
    return k * F.lit(rate / fft)


def peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Places of local maxima (the middle of a flat top), of those at least ``height`` high the higher of any two closer than ``distance``, and of these those that stand out by ``prominence``."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(0, np.int64)
    return curve.decided(x, np.full(len(x), -np.inf if height is None else height), slice(0, len(x)), True, True, distance, prominence)


def spectral_peaks(frames: DataFrame, mags: str, low: int, high: int, height: float = 0.02, distance: int = 3, prominence: float = 0.01, most: int = 20) -> DataFrame:
    """The bins of a frame's highest peaks in a band of bins, over its greatest magnitude; the strongest first. A silent or empty band has none."""

    def found(x: np.ndarray) -> list[np.ndarray]:
        out = []
        for row in x[:, low:high]:
            most_ = row.max() if len(row) else 0.0
            share = row / most_ if most_ > 0 else row
            at = peaks(share, height, distance, prominence) if most_ > 0 else np.zeros(0, np.int64)
            out.append((at[np.argsort(-share[at], kind="stable")][:most] + low).astype(float))
        return out

    return each(frames, mags, "peaks", found)
