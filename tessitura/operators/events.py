"""Note events: what is kept, joined with slices and segments, merged and ordered.

Events have event_id, track_id, midi, role, velocity, start_us and dur_us. Ties go by
event_id; rows with a null track, midi or time match nothing; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import timeline


def ordered(events: DataFrame) -> DataFrame:
    """With place, from 1: by start, then from the highest note down, in each track."""
    return timeline.numbered(events.withColumn("_high", -F.col("midi")), ["start_us", "_high", "event_id"], "place").drop("_high")


def artefacts_removed(melody: DataFrame, others: DataFrame, cents: float = 50.0, ratio: float = 1.5) -> DataFrame:
    """Melody notes (with freq and amp) that no harmonic of another note in their slice outshines.

    others have harmonics, an array of (freq, amp, num). A left-anti join of each slice's
    notes, whose condition holds within ``cents`` and above an amplitude that grows with num.
    """
    loud = others.select("track_id", "slice_idx", F.explode("harmonics").alias("h")).where("h.freq > 0")
    loud = loud.select(F.col("track_id").alias("_track"), F.col("slice_idx").alias("_slice"), F.col("h.freq").alias("_f"), F.col("h.amp").alias("_a"), F.col("h.num").alias("_n"))
    near = F.abs(F.lit(1200) * F.log2(F.col("freq") / F.col("_f"))) < cents
    above = F.col("_a") > F.col("amp") * F.lit(ratio) * (1 + F.col("_n") * F.lit(0.15))
    return melody.join(loud, (F.col("track_id") == F.col("_track")) & (F.col("slice_idx") == F.col("_slice")) & (F.col("freq") > 0) & near & above, "left_anti")


def skyline(notes: DataFrame, least: float = 0.3, most: int = 2, step: float = 5.0) -> DataFrame:
    """Of notes within ``step`` Hz in a slice the most confident, if confident enough; of these the ``most`` highest."""
    slice_ = ["track_id", "slice_idx"]
    rows = notes.withColumn("_key", F.rint(F.col("freq") / step))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*slice_, "_key").orderBy(F.desc("confidence"), "event_id"))).where((F.col("_k") == 1) & (F.col("confidence") >= least))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*slice_).orderBy(F.desc("midi"), "event_id")))
    return rows.where(F.col("_k") <= most).drop("_k", "_key")


def present(events: DataFrame, notes: DataFrame, slice_us: int) -> DataFrame:
    """Events with total and present: the slices of their track that they last over, and those that hold their pitch in their role.

    Equi-joins on the slices that an event reaches, by their numbers; an event's length bounds them.
    """
    first, last = F.ceil(F.col("start_us") / slice_us), F.ceil((F.col("start_us") + F.col("dur_us")) / slice_us) - 1
    reach = events.where(F.col("dur_us") > 0).select("event_id", "track_id", "midi", "role", F.explode(F.sequence(first, F.greatest(first, last))).alias("slice_idx"), last.alias("_last")).where("slice_idx <= _last")
    slices = notes.select("track_id", "slice_idx").distinct().withColumn("_there", F.lit(1))
    held = notes.select("track_id", "slice_idx", "midi", "role").distinct().withColumn("_held", F.lit(1))
    met = reach.join(slices, ["track_id", "slice_idx"]).join(held, ["track_id", "slice_idx", "midi", "role"], "left")
    n = met.groupBy("track_id", "event_id").agg(F.count("*").alias("total"), F.count("_held").alias("present"))
    return events.join(n, ["track_id", "event_id"], "left").fillna(0, ["total", "present"])


def by_majority(events: DataFrame, beat_us: float, share: float = 0.4, least: int = 2) -> DataFrame:
    """Events of present() that enough of their slices hold; melody and short ones need less, and events without a slice stay."""
    part = F.try_divide("present", "total")
    melody = (F.col("role") == "melody") & (part >= share * 0.5)
    short = (F.col("dur_us") / beat_us <= 0.5) & (F.col("present") >= 1)
    return events.where((F.col("total") == 0) | ((part >= share) & (F.col("present") >= least)) | melody | short)


def merged(events: DataFrame, beat_us: float, gap: float = 0.125) -> DataFrame:
    """Events of a pitch, one where the next begins less than ``gap`` beats after the last's end.

    A merged event ends with its last part, so each is held against the one before: the runs
    are islands. It has the first's id, role and start, the beats of all and the greatest velocity.
    """
    by = W.partitionBy("track_id", "midi").orderBy("start_us", "event_id")
    end = F.col("start_us") + F.col("dur_us")
    apart = (F.col("start_us") - F.lag(end).over(by)) * F.lit(1.0) / beat_us >= gap
    rows = events.withColumn("_run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(by))
    least = F.min(F.struct("start_us", "event_id", "role")).alias("first")
    last = F.max(F.struct("start_us", "event_id", end.alias("end"))).alias("last")
    out = rows.groupBy("track_id", "midi", "_run").agg(least, last, F.sum(F.col("dur_us") / beat_us).alias("beats"), F.max("velocity").alias("velocity"), F.count("*").alias("parts"))
    return out.select("track_id", "midi", "first.event_id", "first.role", "first.start_us", (F.col("last.end") - F.col("first.start_us")).alias("dur_us"), "beats", "velocity", "parts")


def attacks(notes: DataFrame, segments: DataFrame, share: float = 0.1) -> DataFrame:
    """(track_id, seg_idx, midi, first_us, kind, until_us) of each pitch in each segment.

    notes have start_us and end_us of their segment. ``new`` where the pitch was not in the
    segment before or is seen within the first ``share`` of it, else ``tied``; until_us is the
    end of the last of the segments in a row that hold the pitch.
    """
    numbered = timeline.numbered(segments, ["start_us"], "seg_idx")
    seen = notes.groupBy("track_id", "start_us", "end_us", "midi").agg(F.min("t_us").alias("first_us"))
    seen = seen.join(numbered.select("track_id", "start_us", "seg_idx"), ["track_id", "start_us"])
    by = W.partitionBy("track_id", "midi").orderBy("seg_idx")
    follows = F.coalesce(F.lag("seg_idx").over(by) == F.col("seg_idx") - 1, F.lit(False))
    early = F.col("first_us") - F.col("start_us") < (F.col("end_us") - F.col("start_us")) * share
    rows = seen.withColumn("kind", F.when(follows & ~early, "tied").otherwise("new")).withColumn("_island", F.col("seg_idx") - F.row_number().over(by))
    until = F.max("end_us").over(W.partitionBy("track_id", "midi", "_island"))
    return rows.select("track_id", "seg_idx", "midi", "first_us", "kind", until.alias("until_us"))


def bar_lines(events: DataFrame, name: Column) -> DataFrame:
    """Events (with place, bar, beat, beats) as lines of text, of two digits, halves up; the first of a bar but the first has an empty line before it."""
    two = lambda c: F.floor(F.col(c) * 100 + 0.5) / F.lit(100.0)
    line = F.format_string("%-6d %-8.2f %-6.2f %-8s %-8s %.2f", "bar", two("beat"), two("beats"), name, "role", two("velocity"))
    events = events.withColumn("_before", F.lag("bar").over(W.partitionBy("track_id").orderBy("place")))
    before = F.col("_before")
    lines = F.when(F.coalesce((before != F.col("bar")) & (before > 0), F.lit(False)), F.array(F.lit(""), line)).otherwise(F.array(line))
    return events.select("track_id", "place", F.posexplode(lines).alias("part", "line"))
