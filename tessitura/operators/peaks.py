"""Peaks of a curve whose values are rows, found in chunks of a track.

A chunk is looked at with chunks on either side. What its peaks are is told by what is near
unless a flat top, a chain of peaks closer than ``distance`` or the way down to
``prominence`` leaves the rows at hand; such chunks, and no others, are looked at again with
more on either side. So the peaks are those of the whole curve, whatever the chunk is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.sources import shared


def spaced(x: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks at some places stay where the higher of two closer than ``distance`` removes the other, of equals the later."""
    kept = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1] if distance > 1 else ():
        if kept[i]:
            near = slice(np.searchsorted(at, at[i] - distance, "right"), np.searchsorted(at, at[i] + distance, "left"))
            kept[near] = False
            kept[i] = True
    return kept


def local_maxima(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(middles of inner flat tops, end of the first level, start of the last level)."""
    edge = np.flatnonzero(np.diff(x)) + 1
    start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(x)])) - 1
    inner = (start > 0) & (end < len(x) - 1)
    a, b = start[inner], end[inner]
    top = (x[a] > x[a - 1]) & (x[b] > x[b + 1])
    return (a[top] + b[top]) // 2, int(end[0]), int(start[-1])


def _descends(side: np.ndarray, top: float, prominence: float, whole: bool) -> bool | None:
    """Whether a side of a peak falls by ``prominence`` before it rises above; None where that lies beyond."""
    low, high = top - side >= prominence, side > top
    down = int(low.argmax()) if low.any() else len(side)
    up = int(high.argmax()) if high.any() else len(side)
    return True if down < up else False if up < len(side) or whole else None


def decided(x: np.ndarray, height: np.ndarray, core: slice, first: bool, last: bool, distance: int, prominence: float | None) -> np.ndarray | None:
    """Places of the peaks in the core of a stretch, which begins (``first``) and ends (``last``) with its track or goes on; None where the stretch doesn't tell."""
    at, left, right = local_maxima(x)
    if not first and left >= core.start or not last and right < core.stop:
        return None
    at = at[x[at] >= height[at]]
    chain = np.cumsum(np.diff(at, prepend=at[:1]) >= distance)
    mine = (at >= core.start) & (at < core.stop)
    if len(at):
        open_left = not first and at[0] - left < distance
        open_right = not last and right - at[-1] < distance
        if open_left and (mine & (chain == chain[0])).any() or open_right and (mine & (chain == chain[-1])).any():
            return None
    found = at[spaced(x, at, distance) & mine]
    if prominence is None:
        return found
    out = []
    for p in found:
        sides = _descends(x[:p][::-1], x[p], prominence, first), _descends(x[p + 1 :], x[p], prominence, last)
        if False not in sides:
            if None in sides:
                return None
            out.append(p)
    return np.array(out, np.int64)


def picked(curve: DataFrame, value: str, height: str, distance: int = 1, prominence: float | None = None, chunk: int = 4096) -> DataFrame:
    """track_id and frame_idx of the peaks of each track's curve (track_id, frame_idx without gaps, value and height): flat tops at their middle, of those at least height high the higher of any two closer than ``distance``, of these those that stand out by ``prominence``.

    Null values count as 0; rows with a null track or index are left out. Passes are
    checkpointed, as they are counted and read; they hold peaks only.
    """
    rows = curve.where("track_id is not null and frame_idx is not null")
    kind = rows.schema["track_id"].dataType.simpleString()
    index = F.col("frame_idx").cast("long")
    rows = rows.select("track_id", index.alias("i"), F.floor(index / chunk).alias("d"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"), F.col(height).cast("double").alias("h"))
    ends = rows.groupBy("track_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    targets = rows.select("track_id", F.col("d").alias("c")).distinct().join(ends, "track_id")

    def look(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, x, h = (table.column(c).to_numpy() for c in ("i", "x", "h"))
        c, lo, hi = (table.column(k)[0].as_py() for k in ("c", "lo", "hi"))
        core = slice(*np.searchsorted(i, [c * chunk, (c + 1) * chunk]).tolist())
        found = decided(x, h, core, i[0] == lo, i[-1] == hi, distance, prominence)
        n = 1 if found is None else len(found)
        idx = [None] if found is None else i[found].tolist()
        return pa.table({"track_id": pa.array([table.column("track_id")[0].as_py()] * n, table.schema.field("track_id").type), "c": pa.array([c] * n, pa.int64()), "frame_idx": pa.array(idx, pa.int64())})

    out, reach = None, 1
    while True:
        wanted = targets.withColumn("d", F.explode(F.sequence(F.col("c") - reach, F.col("c") + reach)))
        found = shared.cut(rows.join(wanted, ["track_id", "d"]).groupBy("track_id", "c").applyInArrow(look, f"track_id {kind}, c long, frame_idx long"))
        done = found.where("frame_idx is not null").select("track_id", "frame_idx")
        out = done if out is None else out.unionByName(done)
        targets = found.where("frame_idx is null").select("track_id", "c").join(ends, "track_id")
        if targets.isEmpty():
            return out
        reach *= 8
