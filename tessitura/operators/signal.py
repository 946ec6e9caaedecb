"""Vector operators on frames, as higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def magnitudes(samples: Column, n: int = 64) -> Column:
    """Magnitudes of the n // 2 + 1 bins of a short frame's Fourier transform, by constant tables."""
    bins = []
    for k in range(n // 2 + 1):
        table = [F.array(*[F.lit(f(2 * math.pi * k * i / n)) for i in range(n)]) for f in (math.cos, math.sin)]
        bins.append(F.sqrt(F.pow(_dot(samples, table[0]), 2) + F.pow(_dot(samples, table[1]), 2)))
    return F.array(*bins)


def total(values: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)


def high_content(mags: Column) -> Column:
    """Magnitudes weighted by their bins, counted from 1."""
    return F.aggregate(F.transform(mags, lambda m, k: m * (k + 1)), F.lit(0.0), lambda a, x: a + x)


def flux(frames: DataFrame, mags: str) -> Column:
    """What the bins have gained since the track's last frame; 0 for the first."""
    before = F.lag(mags).over(W.partitionBy("track_id").orderBy("frame_idx"))
    gain = F.aggregate(F.zip_with(F.col(mags), before, lambda x, y: F.greatest(x - y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(before.isNull(), 0.0).otherwise(gain)


def rise(value: str) -> Column:
    """The half-wave rectified first difference in a track."""
    before = F.lag(value).over(W.partitionBy("track_id").orderBy("frame_idx"))
    return F.greatest(F.col(value) - F.coalesce(before, F.col(value)), F.lit(0.0))


def share_of_most(value: str) -> Column:
    """A value over the track's greatest, if that is positive."""
    most = F.max(value).over(W.partitionBy("track_id"))
    return F.when(most > 0, F.col(value) / most).otherwise(F.col(value))
