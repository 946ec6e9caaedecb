"""Chord segments as fixed-width text lines and as JSON lines, written and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import scalars

# Column -> (first character from 1, width); the last column takes the rest.
LAYOUT = {"position": (1, 10), "time": (12, 8), "chord": (21, 10), "bass": (32, 8)}
MELODY_AT = 41


def seconds_text(t_us: Column) -> Column:
    """Seconds with two digits, halves up, from whole microseconds."""
    cents = (t_us + 5000).cast("long")
    return F.format_string("%d.%02d", F.floor(cents / 1_000_000), F.pmod(F.floor(cents / 10_000), F.lit(100)))


def segment_line(position: Column, t_us: Column, chord: Column, bass: Column, melody: Column) -> Column:
    """One segment as a line of fixed-width columns; what is missing is a dash."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    return F.format_string("%-10s %-8s %-10s %-8s %s", position, seconds_text(t_us), dash(chord), dash(bass), dash(melody))


def parse_segment_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with bar, beat, time, chord, bass and melody (array); headers, rules and lines without a number for time go."""
    part = {k: F.trim(F.substring(F.col(line), at, n)) for k, (at, n) in LAYOUT.items()}
    place = F.split(part["position"], r"\.")
    none = lambda c: F.when((c != "-") & (c != ""), c)
    rest = F.trim(F.substring(F.col(line), MELODY_AT, 1 << 30))
    melody = F.when((rest == "-") | (rest == ""), F.array().cast("array<string>")).otherwise(F.split(rest, " +"))
    rows = lines.withColumns({"bar": F.get(place, F.lit(0)).try_cast("int"), "beat": F.get(place, F.lit(1)).try_cast("int"), "time": part["time"].try_cast("double"), "chord": none(part["chord"]), "bass": none(part["bass"]), "melody": melody})
    return rows.where("time is not null")


def read_segment_lines(spark: SparkSession, path: str) -> DataFrame:
    """The segments of text files, with the file that each is from."""
    return parse_segment_lines(spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path")))


def write_segment_lines(lines: DataFrame, path: str, line: str = "line") -> None:
    lines.select(line).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, a folder per track."""
    rows.write.partitionBy("track_id").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a stated schema: fields that a line lacks are null, lines that are no JSON are all null."""
    return spark.read.schema(schema).json(path)


NOTE = "event_id: long, midi: int, name: string, start: double, duration: double, duration_beats: double, velocity: double, role: string"
DOCUMENT = f"metadata struct<track_id: long, bpm: double, time_signature: string, num_notes: long>, note_events array<struct<{NOTE}>>"


def event_documents(events: DataFrame, bpm: float, per_bar: int = 4) -> DataFrame:
    """track_id and json: a document for each track, with its notes by start, then from the highest down; numbers have three digits after the point.

    A track is one document, as its readers take it; without events there is none.
    """
    beats = F.col("dur_us") / F.lit(60e6 / bpm)
    note = F.struct("event_id", "midi", scalars.note_name(F.col("midi")).alias("name"), F.bround(F.col("start_us") / 1e6, 3).alias("start"), F.bround(F.col("dur_us") / 1e6, 3).alias("duration"), F.bround(beats, 3).alias("duration_beats"), F.bround("velocity", 3).alias("velocity"), "role")
    order = F.struct("start_us", (-F.col("midi")).alias("high"), F.col("event_id").alias("id"), note.alias("note"))
    rows = events.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["note"]).alias("note_events"))
    metadata = F.struct("track_id", F.lit(bpm).alias("bpm"), F.lit(f"{per_bar}/4").alias("time_signature"), F.size("note_events").cast("long").alias("num_notes"))
    return rows.select("track_id", F.to_json(F.struct(metadata.alias("metadata"), "note_events")).alias("json"))


def events_of_documents(docs: DataFrame, column: str = "json") -> DataFrame:
    """The notes of such documents, with their metadata; what can't be read gives no row."""
    rows = docs.select(F.from_json(column, DOCUMENT).alias("d")).select("d.metadata.*", F.explode("d.note_events").alias("note"))
    return rows.select("track_id", "bpm", "time_signature", "note.*")
