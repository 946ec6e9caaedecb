"""Transcriptions as text tables: a file of notes by slices, whose header line tells where its columns are.

A file is a row with its lines, as songs are; its lines then are rows. What a line lacks or
can't be read for leaves it out, as it would be by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import names
from tessitura.sources.documents import seconds_text

# Key of a header line -> (column, type, what it is without one).
HEADER = {
    "Transcription": ("song", "string", ""), "Duration": ("duration", "double", 0.0), "BPM": ("bpm", "double", 120.0), "Time Signature": ("time_signature", "string", "4/4"),
    "Total Bars": ("total_bars", "int", 0), "First Downbeat": ("first_downbeat", "double", 0.0), "BPM Confidence": ("bpm_confidence", "double", 0.0),
}
# Columns of the table and of the one that tells no place: column -> (first character from 1, width).
SLICE_COLUMNS = "%-10s %-8s %-10s %-12s %-24s %s"
PLAIN = {"time": (1, 8), "bass_notes": (21, 12), "chord_notes": (34, 28), "melody_notes": (62, 1 << 20)}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source_file and lines of each text file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return files.select("source_file", F.split("value", "\r?\n").alias("lines"))


def headers(files: DataFrame) -> DataFrame:
    """source_file and what the lines with ``#`` at the beginning of each file say: of a key the last that can be read, else what it is without one."""
    stripped = F.transform("lines", lambda x: F.trim(x))
    marks = F.transform(stripped, lambda x: F.when(x.startswith("#"), 0).otherwise(1))
    end = F.array_position(marks, 1)
    lead = F.slice(stripped, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size("lines")).cast("int"))
    lead = F.transform(lead, lambda x: F.trim(F.substr(x, F.lit(2))))
    rows = files.withColumn("_lead", lead)
    return rows.select("source_file", *[_said(key, *how) for key, how in HEADER.items()])


def _said(key: str, name: str, kind: str, none) -> Column:
    """What the lines of a header say for a key."""
    said = F.transform(F.filter("_lead", lambda x: x.startswith(key + ":")), lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)))
    if name != "song":
        said = F.transform(said, lambda x: F.trim(F.element_at(F.split(x, ":"), 1)))
    if name in ("duration", "first_downbeat"):
        said = F.transform(said, lambda x: F.replace(x, F.lit("s"), F.lit("")))
    if kind != "string":
        said = F.array_compact(F.transform(said, lambda x: x.try_cast(kind)))
    return F.coalesce(F.get(F.reverse(said), F.lit(0)), F.lit(none).cast(kind)).alias(name)


def _notes(text: Column, strict: bool) -> Column:
    """Names in a column of a line; a dash is none."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda n: (n != "") & (n != "-") & (names.pitch_and_octave(n).isNotNull() if strict else F.lit(True)))


def slices(files: DataFrame) -> DataFrame:
    """source_file, line (from 0), time, bar, beat, beat_fraction, chord, bass_notes, chord_notes and melody_notes of the lines after each file's header line and the rule below it.

    Columns begin where the header line names them. Without a place column bar and beat are 1;
    without a column of chord notes there are none, and the bass goes up to the melody. Blank lines, comments and
    lines whose place or time is no number are left out, and so are names that are no notes; a file without header
    line has no rows.
    """
    at = lambda name: F.instr("head", name)
    told = F.exists("lines", lambda x: _heads(x))
    rows = files.where(told).withColumn("_at", F.array_position(F.transform("lines", lambda x: F.when(_heads(x), 1).otherwise(0)), 1)).withColumn("head", F.element_at("lines", F.col("_at").cast("int")))
    rows = rows.withColumns({"c_place": at("Bar.Beat"), "c_time": at("Time"), "c_bass": at("Bass"), "c_chords": at("Chords"), "c_melody": at("Melody")})
    rows = rows.withColumn("c_chord", F.when(F.col("c_place") > 0, F.locate("Chord", F.col("head"), 1)).otherwise(at("Chord")))
    rows = rows.select("*", F.posexplode("lines").alias("line", "text")).where((F.col("line") > F.col("_at")) & (F.trim("text") != "") & ~F.trim("text").startswith("#"))
    part = lambda a, b: F.substr(F.col("text"), F.col(a), F.greatest(F.lit(0), F.col(b) - F.col(a)) if isinstance(b, str) else b)
    place = F.split(F.trim(part("c_place", "c_time")), r"\.")
    has = F.col("c_place") > 0
    number = lambda k: F.get(place, F.lit(k)).try_cast("int")
    beat = F.when(has & (F.size(place) > 1), number(1)).otherwise(1)
    fraction = F.when(has & (F.size(place) > 2), number(2) / 100.0).otherwise(0.0)
    bass = F.when(F.col("c_chords") > 0, part("c_bass", "c_chords")).otherwise(part("c_bass", "c_melody"))
    chords = F.when(F.col("c_chords") > 0, part("c_chords", "c_melody")).otherwise("")
    name = F.trim(part("c_chord", "c_bass"))
    out = rows.select("source_file", "line", F.trim(part("c_time", "c_chord")).try_cast("double").alias("time"), F.when(has, number(0)).otherwise(1).alias("bar"), beat.alias("beat"), fraction.alias("beat_fraction"), F.when(name == "", "-").otherwise(name).alias("chord"), _notes(bass, True).alias("bass_notes"), _notes(chords, True).alias("chord_notes"), _notes(part("c_melody", F.lit(1 << 20)), True).alias("melody_notes"))
    return out.where("time is not null and bar is not null and beat is not null and beat_fraction is not null")


def _heads(line: Column) -> Column:
    trimmed = F.trim(line)
    return trimmed.contains("Bar.Beat") | (trimmed.startswith("Time") & trimmed.contains("Chord"))


def plain_slices(files: DataFrame) -> DataFrame:
    """source_file, line, time, bass_notes, chord_notes and melody_notes by fixed columns, of the lines after a rule of dashes; lines without a number for time are left out."""
    rule = F.array_position(F.transform("lines", lambda x: F.when(x.startswith("----"), 1).otherwise(0)), 1)
    rows = files.withColumn("_at", rule).where("_at > 0").select("source_file", "_at", F.posexplode("lines").alias("line", "text")).where("line >= _at")
    part = {k: F.substring("text", at, n) for k, (at, n) in PLAIN.items()}
    return rows.select("source_file", "line", F.trim(part["time"]).try_cast("double").alias("time"), *[_notes(part[k], False).alias(k) for k in PLAIN if k != "time"]).where("time is not null")


def slice_line(position: Column, t_us: Column, chord: Column, bass: Column, chords: Column, melody: Column) -> Column:
    """One slice as a line of the table; bass, chords and melody are arrays of names; what is missing is a dash."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    joined = lambda a: dash(F.array_join(a, " "))
    return F.format_string(SLICE_COLUMNS, position, seconds_text(t_us), dash(chord), joined(bass), joined(chords), joined(melody))


def header_lines(song: Column, duration_us: Column, bpm: Column, signature: Column, bars: Column, first_us: Column, confidence: Column) -> Column:
    """The lines before a table of slices, an array: what is known of the song, a blank, the columns' names and a rule."""
    milli = F.floor(F.pmod(first_us + 500, F.lit(1_000_000)) / 1000)
    known = {"Transcription": song, "Duration": F.concat(seconds_text(duration_us), F.lit("s")), "BPM": F.rint(bpm).cast("long").cast("string"), "Time Signature": signature, "Total Bars": bars.cast("string"), "First Downbeat": F.format_string("%d.%03ds", F.floor((first_us + 500) / 1_000_000), milli), "BPM Confidence": F.format_string("%.2f", F.bround(confidence, 2))}
    lines = [F.concat(F.lit(f"# {key}: "), value) for key, value in known.items()]
    return F.array(*lines, F.lit(""), F.format_string(SLICE_COLUMNS, *map(F.lit, ["Bar.Beat", "Time", "Chord", "Bass", "Chords", "Melody"])), F.lit("-" * 100))


def write_files(files: DataFrame, path: str, key: str = "track_id") -> None:
    """Lines of each row as text, a folder for each key."""
    files.select(key, F.array_join("lines", "\n").alias("value")).write.partitionBy(key).text(path)
