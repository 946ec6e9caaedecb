"""Events brought onto a beat grid that is found for their track.

Events have track_id, event_id, midi, start_us, dur_us, beats, bar and beat, as of fusion; onsets track_id and
t_us. Grids are one row for each track: track_id, bpm and first_us.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import grid

SCORE = ["bar_alignment", "bar_coverage", "beat_alignment", "bpm_preference", "total"]


def grids_for(events: DataFrame, onsets: DataFrame, duration_us: int, initial: DataFrame, manual: DataFrame | None = None, refine: bool = True, per_bar: int = 4, **search) -> DataFrame:
    """The grid of each track of events with its score over all onsets (null without any): of a given tempo (manual: track_id, bpm) the best phase, else the best of a search, else, for tracks without onsets or without ``refine``, the initial one."""
    marks = onsets.where("track_id is not null and t_us is not null").select("track_id", "t_us")
    rows = events.where("track_id is not null").select("track_id").distinct().join(initial.select("track_id", F.col("bpm").cast("double").alias("_bpm"), F.col("first_us").cast("long").alias("_first")), "track_id", "left")
    found = None
    if refine:
        found = grid.found_grid(marks, duration_us, per_bar=per_bar, **search).select("track_id", "bpm", "first_us")
    if manual is not None:
        fixed = grid.best_phase(marks, manual, duration_us, per_bar).select("track_id", "bpm", "first_us")
        found = fixed if found is None else fixed.unionByName(found.join(manual, "track_id", "left_anti"))
    if found is not None:
        rows = rows.join(found, "track_id", "left").select("track_id", F.coalesce("bpm", "_bpm").alias("bpm"), F.coalesce("first_us", "_first").alias("first_us"))
    else:
        rows = rows.select("track_id", F.col("_bpm").alias("bpm"), F.col("_first").alias("first_us"))
    scored = grid.scores(marks, rows, duration_us, per_bar=per_bar).select("track_id", *SCORE)
    return rows.join(scored, "track_id", "left")


def aligned(events: DataFrame, grids: DataFrame, step: float = 0.5, reach: float = 0.3, per_bar: int = 4, longest_bars: float = 1.5) -> DataFrame:
    """events on their track's grid, with on_grid and distance (beats to the nearest step).

    Starts within ``reach`` beats of a step go there, others stay; bar, beat, length (a written one, at most
    ``longest_bars``) and duration are told anew. Whole microseconds. Events of a track without a grid go.
    """
    rows = events.join(grids.where("bpm > 0").select("track_id", F.col("bpm").alias("_bpm"), F.col("first_us").alias("_first")), "track_id")
    unit = F.lit(60e6) / F.col("_bpm")
    rows = rows.withColumn("_at", (F.col("start_us") - F.col("_first")) / unit)
    rows = rows.withColumn("_near", scalars.snapped(F.col("_at"), step)).withColumn("distance", F.abs(F.col("_at") - F.col("_near")))
    rows = rows.withColumn("on_grid", F.col("distance") <= reach).withColumn("_at", F.when(F.col("on_grid"), F.col("_near")).otherwise(F.col("_at")))
    beats = F.least(scalars.grid_duration(F.col("beats"), per_bar), F.lit(longest_bars * per_bar))
    start = F.when(F.col("on_grid"), F.rint(F.col("_first") + F.col("_near") * unit).cast("long")).otherwise(F.col("start_us"))
    rows = rows.withColumns({"start_us": start, "beats": beats, "bar": scalars.bar_of(F.col("_at"), per_bar), "beat": scalars.beat_in_bar(F.col("_at"), per_bar)})
    rows = rows.withColumn("dur_us", F.rint(F.col("beats") * unit).cast("long"))
    return rows.select(*events.columns, "distance", "on_grid")


def statistics(events: DataFrame, grids: DataFrame) -> DataFrame:
    """Each track's grid and its score, with how many events of aligned() are on and off it, their mean distance and how many begin a bar."""
    told = events.groupBy("track_id").agg(F.count_if("on_grid").alias("on_grid"), F.count_if(~F.col("on_grid")).alias("off_grid"), F.avg("distance").alias("mean_distance"), F.count_if(F.abs(F.col("beat") - 1) < 0.1).alias("on_first_beat"))
    return grids.join(told, "track_id", "left").fillna(0, ["on_grid", "off_grid", "on_first_beat"])
