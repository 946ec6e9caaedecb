"""Fused note events as JSON documents and as text, with all their fields, written and read.

Events are those of fusion; songs are one row for each track: track_id, source_file,
duration_us, bpm, time_signature and first_us. A song is one document, as its readers take it;
text is a row for each line, so it may be written by many tasks. Times have four digits after the point,
beats three, velocities two, halves to even; tracks without a song have no document and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import timeline
from tessitura.sources.documents import seconds_text

NOTE = "midi: int, name: string, start: double, duration: double, bar: int, beat: double, duration_beats: double, velocity: double, role: string, is_tied: boolean"
METADATA = "duration_seconds: double, source_file: string, bpm: double, time_signature: string, first_beat_time: double, num_bars: int, num_notes: long"
DOCUMENT = f"metadata struct<{METADATA}>, note_events array<struct<{NOTE}>>"


def documents(events: DataFrame, songs: DataFrame) -> DataFrame:
    """track_id and json of each song, its notes by start, then from the highest down; a song without events has none in it."""
    seconds = lambda c, n: F.bround(F.col(c) / 1e6, n)
    note = F.struct("midi", scalars.note_name(F.col("midi")).alias("name"), seconds("start_us", 4).alias("start"), seconds("dur_us", 4).alias("duration"), "bar", F.bround("beat", 3).alias("beat"), F.bround("beats", 3).alias("duration_beats"), F.bround("velocity", 2).alias("velocity"), "role", "is_tied")
    order = F.struct("start_us", (-F.col("midi")).alias("high"), F.col("event_id").alias("id"), note.alias("note"), "bar")
    notes = events.where("track_id is not null").groupBy("track_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    rows = songs.join(notes, "track_id", "left")
    told = F.coalesce(F.transform("all", lambda e: e["note"]), F.from_json(F.lit("[]"), f"array<struct<{NOTE}>>"))
    bars = F.coalesce(F.array_max(F.transform("all", lambda e: e["bar"])), F.lit(0)).cast("int")
    metadata = F.struct(seconds("duration_us", 2).alias("duration_seconds"), "source_file", F.col("bpm").cast("double").alias("bpm"), "time_signature", seconds("first_us", 4).alias("first_beat_time"), bars.alias("num_bars"), F.size(told).cast("long").alias("num_notes"))
    return rows.select("track_id", F.to_json(F.struct(metadata.alias("metadata"), told.alias("note_events"))).alias("json"))


def read_documents(docs: DataFrame, column: str = "json") -> DataFrame:
    """docs with metadata and note_events of their documents; a velocity that lacks is 0.8, a role unknown, a tie false; what can't be read has nulls."""
    rows = docs.withColumn("_d", F.from_json(column, DOCUMENT))
    whole = lambda e: e.withField("velocity", F.coalesce(e["velocity"], F.lit(0.8))).withField("role", F.coalesce(e["role"], F.lit("unknown"))).withField("is_tied", F.coalesce(e["is_tied"], F.lit(False)))
    return rows.withColumns({"metadata": F.col("_d.metadata"), "note_events": F.transform("_d.note_events", whole)}).drop("_d")


def note_rows(docs: DataFrame) -> DataFrame:
    """A row for each note of read_documents(), with place (from 0), times in microseconds and its song's metadata."""
    rows = docs.select("track_id", "metadata.*", F.posexplode("note_events").alias("place", "note")).select("*", "note.*").drop("note")
    micro = lambda c: F.rint(F.col(c) * 1e6).cast("long")
    return rows.withColumns({"start_us": micro("start"), "dur_us": micro("duration"), "first_us": micro("first_beat_time")})


def _two(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / F.lit(100.0)


def text_lines(events: DataFrame, songs: DataFrame, by_bar: bool = True) -> DataFrame:
    """track_id, place (0 for what stands before the notes), part and line: the text of each song, in order of place and part.

    ``by_bar``: bar, beat, length, name, role, velocity and a mark for ties, bars apart by an empty line; else time,
    place, length, name and role. Numbers have halves up.
    """
    rows = timeline.numbered(events.withColumn("_high", -F.col("midi")), ["start_us", "_high", "event_id"], "place").join(songs.select("track_id"), "track_id", "left_semi")
    bars = rows.groupBy("track_id").agg(F.max("bar").alias("_bars"), F.count("*").alias("_n"))
    known = songs.join(bars, "track_id", "left").fillna(0, ["_bars", "_n"])
    says = {"Fused Transcription": F.col("source_file"), "Duration": F.concat(seconds_text(F.col("duration_us")), F.lit("s")), "BPM": F.rint("bpm").cast("long").cast("string"), "Time Signature": F.col("time_signature"), "Total Bars": F.col("_bars").cast("string"), "Total Notes": F.col("_n").cast("string")}
    layout, names, rule = ("%-6s %-8s %-6s %-8s %-8s %s", ["Bar", "Beat", "Dur", "Note", "Role", "Vel"], 50) if by_bar else ("%-10s %-10s %-8s %-8s %s", ["Time", "Bar.Beat", "Dur", "Note", "Role"], 55)
    head = F.array(*[F.concat(F.lit(f"# {k}: "), v) for k, v in says.items()], F.lit(""), F.format_string(layout, *map(F.lit, names)), F.lit("-" * rule))
    before = known.select("track_id", F.lit(0).cast("long").alias("place"), F.posexplode(head).alias("part", "line"))
    name = scalars.note_name(F.col("midi"))
    if not by_bar:
        milli = F.floor((F.col("start_us") + 500) / 1000)
        time = F.format_string("%d.%03d", F.floor(milli / 1000), F.pmod(milli, F.lit(1000)))
        line = F.format_string("%-10s %-10s %-8.2f %-8s %s", time, F.concat_ws(".", F.col("bar").cast("string"), F.format_string("%.2f", _two(F.col("beat")))), _two(F.col("beats")), name, "role")
        return before.unionByName(rows.select("track_id", "place", F.lit(0).alias("part"), line.alias("line")))
    last = rows.select("track_id", (F.col("place") + 1).alias("place"), F.col("bar").alias("_last"))
    rows = rows.join(last, ["track_id", "place"], "left")
    tie = F.when(F.coalesce("is_tied", F.lit(False)), " (tie)").otherwise("")
    line = F.concat(F.format_string("%-6d %-8.2f %-6.2f %-8s %-8s %.2f", "bar", _two(F.col("beat")), _two(F.col("beats")), name, "role", _two(F.col("velocity"))), tie)
    gap = F.coalesce((F.col("_last") != F.col("bar")) & (F.col("_last") > 0), F.lit(False))
    return before.unionByName(rows.select("track_id", "place", F.posexplode(F.when(gap, F.array(F.lit(""), line)).otherwise(F.array(line))).alias("part", "line")))
