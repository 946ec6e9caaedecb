"""Joins, windows and per-group choices on detections, all per track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import timeline


def onset_segments(onsets: DataFrame, duration_us: int, first_gap_us: int, least_us: int) -> DataFrame:
    """Segments between the distinct onsets of a track, with one from 0 if the first onset is late; those under least_us are left out."""
    marks = onsets.select("track_id", "t_us").distinct()
    starts = marks.groupBy("track_id").agg(F.min("t_us").alias("low")).where(F.col("low") > first_gap_us).select("track_id", F.lit(0).cast("long").alias("t_us"))
    rows = timeline.following(marks.unionByName(starts), "t_us", "next_us")
    out = rows.select("track_id", F.col("t_us").alias("start_us"), F.coalesce("next_us", F.lit(duration_us)).alias("end_us"))
    return out.where(F.col("end_us") - F.col("start_us") >= least_us)


def in_segment(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points with the segment that holds them, as of its start, in buckets of time."""
    return timeline.held_by(points, segments)


def sustained(onsets: DataFrame, slices: DataFrame, steps: int) -> DataFrame:
    """Onset notes with the slices that they last for: an equi-join on the slices that a note reaches, by their numbers."""
    reach = onsets.withColumn("slice_idx", F.explode(F.sequence(F.col("slice_idx"), F.col("slice_idx") + steps)))
    starts = slices.select("track_id", "slice_idx").distinct()
    hit = reach.join(starts, ["track_id", "slice_idx"])
    at = F.col("slice_idx") * 100_000
    return hit.where((at >= F.col("t_us")) & (at < F.col("t_us") + steps * 100_000))


def majority(notes: DataFrame, window: int) -> DataFrame:
    """Notes that occur in at least half of the slices around each; the strongest stands for them."""
    half = window // 2
    last = notes.groupBy("track_id").agg(F.min("slice_idx").alias("lo"), F.max("slice_idx").alias("hi"))
    near = notes.withColumn("target", F.explode(F.sequence(F.col("slice_idx") - half, F.col("slice_idx") + half))).join(F.broadcast(last), "track_id").where("target between lo and hi")
    size = F.least(F.col("target") + half, F.col("hi")) - F.greatest(F.col("target") - half, F.col("lo")) + 1
    votes = near.groupBy("track_id", "target", "midi").agg(F.count("*").alias("votes"), F.max("amp").alias("amp"), F.first(size).alias("size"))
    return votes.where(F.col("votes") * 2 >= F.col("size")).select("track_id", F.col("target").alias("slice_idx"), "midi", "votes", "amp")


def isolated_removed(notes: DataFrame, gap: int, least: int) -> DataFrame:
    """Notes in runs of a pitch: a run ends where more than gap slices lie between; runs of fewer than least notes go."""
    by = W.partitionBy("track_id", "midi").orderBy("slice_idx", "event_id")
    new = (F.col("slice_idx") - F.lag("slice_idx").over(by) > gap).cast("int")
    runs = notes.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(by))
    return runs.withColumn("_n", F.count("*").over(W.partitionBy("track_id", "midi", "run"))).where(F.col("_n") >= least).drop("_n")


def without_pitches_of(notes: DataFrame, others: DataFrame) -> DataFrame:
    """Notes whose pitch none of the others has in the same slice."""
    return notes.join(others.select("track_id", "slice_idx", "midi").distinct(), ["track_id", "slice_idx", "midi"], "left_anti")


def by_role(notes: DataFrame) -> DataFrame:
    """One note per slice and pitch: melody before chord before bass."""
    rank = F.expr("CASE role WHEN 'melody' THEN 0 WHEN 'chord' THEN 1 WHEN 'bass' THEN 2 ELSE 3 END")
    order = W.partitionBy("track_id", "slice_idx", "midi").orderBy(rank, "event_id")
    return notes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def balanced(notes: DataFrame, bass: int = 2, chord: int = 4, melody: int = 2) -> DataFrame:
    """Per slice the lowest bass, strongest chord and highest melody notes; other roles stay."""
    key = F.expr("CASE role WHEN 'bass' THEN cast(midi as double) WHEN 'chord' THEN -confidence WHEN 'melody' THEN -cast(midi as double) ELSE 0D END")
    order = W.partitionBy("track_id", "slice_idx", "role").orderBy(key, "event_id")
    most = F.expr(f"CASE role WHEN 'bass' THEN {bass} WHEN 'chord' THEN {chord} WHEN 'melody' THEN {melody} END")
    return notes.withColumn("_k", F.row_number().over(order)).where(most.isNull() | (F.col("_k") <= most)).drop("_k")


def thinned(notes: DataFrame, max_chord: int = 4, max_total: int = 6) -> DataFrame:
    """Per slice all melody, the lowest bass note, and the strongest chord notes in what room is left; other roles go."""
    per = W.partitionBy("track_id", "slice_idx")
    role = W.partitionBy("track_id", "slice_idx", "role")
    kept = F.sum((F.col("role") == "melody").cast("int")).over(per) + F.max((F.col("role") == "bass").cast("int")).over(per)
    key = F.when(F.col("role") == "bass", F.col("midi").cast("double")).otherwise(-F.col("confidence"))
    rows = notes.where("role in ('melody', 'chord', 'bass')").withColumns({"_kept": kept, "_k": F.row_number().over(role.orderBy(key, "event_id"))})
    room = F.least(F.lit(max_chord), F.lit(max_total) - F.col("_kept"))
    return rows.where((F.col("role") == "melody") | ((F.col("role") == "bass") & (F.col("_k") == 1)) | ((F.col("role") == "chord") & (F.col("_k") <= room))).drop("_kept", "_k")


def changes(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Rows of a track whose value is another than that before, nulls left out."""
    by = W.partitionBy("track_id").orderBy(*order)
    rows = rows.where(F.col(value).isNotNull()).withColumn("_before", F.lag(value).over(by))
    return rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def role_weighted(notes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Notes whose confidence reaches the threshold over their role's weight."""
    weight = F.expr("CASE role WHEN 'melody' THEN 1.0D WHEN 'chord' THEN 1.5D WHEN 'bass' THEN 0.7D WHEN 'unknown' THEN 0.8D ELSE 1.0D END")
    return notes.where(F.col("confidence") >= F.lit(threshold) / weight)
