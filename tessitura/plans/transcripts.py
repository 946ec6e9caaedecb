"""Queries on text tables of slices, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.plans.queries import BPM, DET, NAMES
from tessitura.sources import adapters, transcripts

_NAMED = f"string_agg({NAMES}[midi % 12 + 1] || (midi // 12 - 1)::VARCHAR, ' ' ORDER BY midi, event_id)"
ORACLE_SQL = {
    "slice_tables": f"""WITH {DET}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id, slice_idx, role ORDER BY midi, event_id) AS place FROM det WHERE role IN ('bass', 'chord', 'melody')),
  r AS (SELECT track_id, slice_idx, role, {_NAMED} AS notes FROM n WHERE place <= CASE role WHEN 'bass' THEN 2 ELSE 5 END GROUP BY ALL), s AS (SELECT *, slice_idx / 10 / (60.0::DOUBLE / 67.0::DOUBLE) AS beat, row_number() OVER (PARTITION BY track_id ORDER BY slice_idx) AS i FROM (SELECT DISTINCT track_id, slice_idx FROM r)),
  m AS (SELECT track_id, max(floor(beat / 4)::INT + 1) AS bars FROM s GROUP BY ALL)
SELECT track_id, (i + 9)::INT AS line, slice_idx / 10 AS time, floor(beat / 4)::INT + 1 AS bar, floor(fmod(beat, 4.0::DOUBLE) + 1)::INT AS beat, CASE WHEN beat - floor(beat) > 0.01 THEN floor((fmod(beat, 4.0::DOUBLE) + 1 - floor(fmod(beat, 4.0::DOUBLE) + 1)) * 100) ELSE 0 END / 100 AS beat_fraction,
  coalesce((SELECT notes FROM r WHERE r.track_id = s.track_id AND r.slice_idx = s.slice_idx AND role = 'bass'), '') AS bass, coalesce((SELECT notes FROM r WHERE r.track_id = s.track_id AND r.slice_idx = s.slice_idx AND role = 'chord'), '') AS chords,
  coalesce((SELECT notes FROM r WHERE r.track_id = s.track_id AND r.slice_idx = s.slice_idx AND role = 'melody'), '') AS melody, bars AS total_bars, 67.0::DOUBLE AS bpm FROM s JOIN m USING (track_id)"""
}


def slice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each track's slices as a text table with its header, read back."""
    notes = adapters.detections(spark, sf_dir).where("role in ('bass', 'chord', 'melody')")
    by_role = lambda role, most: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("midi", "event_id")))), 1, most), lambda n: scalars.note_name(n["midi"]))
    rows = notes.groupBy("track_id", "slice_idx").agg(by_role("bass", 2).alias("bass"), by_role("chord", 5).alias("chords"), by_role("melody", 5).alias("melody"))
    beat = scalars.time_to_beat(F.col("slice_idx") / 10, BPM)
    rows = rows.withColumns({"bar": scalars.bar_of(beat), "beat": scalars.beat_in_bar(beat)})
    line = transcripts.slice_line(scalars.bar_beat_text(F.col("bar"), F.col("beat")), F.col("slice_idx") * adapters.SLICE_US, F.lit(None).cast("string"), F.col("bass"), F.col("chords"), F.col("melody"))
    tables = rows.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_idx", line.alias("line")))), lambda s: s["line"]).alias("body"), F.max("bar").alias("bars"))
    head = transcripts.header_lines(F.concat(F.lit("track "), F.col("track_id").cast("string")), F.lit(300_000_000), F.lit(BPM), F.lit("4/4"), F.col("bars"), F.lit(0), F.lit(1.0))
    files = tables.select(F.col("track_id").alias("source_file"), F.concat(head, "body").alias("lines"))
    read = transcripts.slices(files).join(transcripts.headers(files).select("source_file", "total_bars", "bpm"), "source_file")
    return read.select(F.col("source_file").alias("track_id"), "line", "time", "bar", "beat", "beat_fraction", F.array_join("bass_notes", " ").alias("bass"), F.array_join("chord_notes", " ").alias("chords"), F.array_join("melody_notes", " ").alias("melody"), "total_bars", "bpm")


QUERIES = {"slice_tables": slice_tables}
