"""Scores as documents and text, and events on grids."""

import pytest
from pyspark.sql import functions as F

from tessitura.operators import alignment
from tessitura.sources import scores

EVENT = "event_id long, track_id int, midi int, role string, velocity double, start_us long, dur_us long, beats double, bar int, beat double, is_tied boolean"
SONG = "track_id int, source_file string, duration_us long, bpm double, time_signature string, first_us long"


@pytest.fixture(scope="module")
def tables(spark):
    events = [(1, 1, 60, "melody", 0.876, 500_000, 250_000, 0.5, 1, 2.0, False), (2, 1, 64, "chord", 0.5, 500_000, 500_000, 1.0, 1, 2.0, True), (3, 1, 48, "bass", 1.0, 2_700_040, 1_000_000, 2.0, 2, 2.4, False), (4, 3, 60, "bass", 1.0, 0, 1, 1.0, 1, 1.0, False)]
    return spark.createDataFrame(events, EVENT), spark.createDataFrame([(1, "a.wav", 9_870_000, 120.0, "4/4", 12_345), (2, "b.wav", 0, 90.0, "3/4", 0)], SONG)


def test_documents_and_back(spark, tables):
    docs = scores.documents(*tables)
    assert sorted(r["track_id"] for r in docs.collect()) == [1, 2]
    odd = spark.createDataFrame([(7, '{"metadata": {"bpm": 90}, "note_events": [{"midi": 61, "start": 1.5, "duration": 1}]}'), (8, "no json"), (9, None)], "track_id int, json string")
    read = scores.read_documents(docs.unionByName(odd))
    meta = {r["track_id"]: r["metadata"] for r in read.collect()}
    assert tuple(meta[1]) == (9.87, "a.wav", 120.0, "4/4", 0.0123, 2, 3) and tuple(meta[2]) == (0.0, "b.wav", 90.0, "3/4", 0.0, 0, 0)
    rows = [(r["track_id"], r["place"], r["midi"], r["name"], r["start_us"], r["dur_us"], r["velocity"], r["role"], r["is_tied"]) for r in scores.note_rows(read).orderBy("track_id", "place").collect()]
    assert rows == [(1, 0, 64, "E4", 500_000, 500_000, 0.5, "chord", True), (1, 1, 60, "C4", 500_000, 250_000, 0.88, "melody", False), (1, 2, 48, "C3", 2_700_000, 1_000_000, 1.0, "bass", False), (7, 0, 61, None, 1_500_000, 1_000_000, 0.8, "unknown", False)]
    assert scores.documents(tables[0], tables[1].limit(0)).count() == 0


def test_text_of_both_kinds(tables):
    text = lambda by_bar: [r["line"] for r in scores.text_lines(*tables, by_bar).where("track_id = 1").orderBy("place", "part").collect()]
    assert text(True)[:6] == ["# Fused Transcription: a.wav", "# Duration: 9.87s", "# BPM: 120", "# Time Signature: 4/4", "# Total Bars: 2", "# Total Notes: 3"]
    assert text(True)[6:] == ["", "Bar    Beat     Dur    Note     Role     Vel", "-" * 50, "1      2.00     1.00   E4       chord    0.50 (tie)", "1      2.00     0.50   C4       melody   0.88", "", "2      2.40     2.00   C3       bass     1.00"]
    assert text(False)[7:] == ["Time       Bar.Beat   Dur      Note     Role", "-" * 55, "0.500      1.2.00     1.00     E4       chord", "0.500      1.2.00     0.50     C4       melody", "2.700      2.2.40     2.00     C3       bass"]
    assert [r["line"] for r in scores.text_lines(*tables).where("track_id = 2").orderBy("part").collect()][4:6] == ["# Total Bars: 0", "# Total Notes: 0"]


def test_events_on_given_and_initial_grids(spark, tables):
    events, _ = tables
    onsets = spark.createDataFrame([(1, 20_000 + k * 600_000) for k in range(30)], "track_id int, t_us long")
    initial = spark.createDataFrame([(1, 120.0, 0), (3, 90.0, 0)], "track_id int, bpm double, first_us long")
    manual = spark.createDataFrame([(1, 100.0)], "track_id int, bpm double")
    grids = alignment.grids_for(events, onsets, 20_000_000, initial, manual, refine=False)
    got = {r["track_id"]: r for r in grids.collect()}
    assert got[1]["bpm"] == 100.0 and (got[1]["first_us"] - 20_000) % 300_000 < 20_000 and got[3]["bpm"] == 90.0 and got[3]["total"] is None
    fixed = grids.withColumn("first_us", F.when(F.col("track_id") == 1, 20_000).otherwise(0))
    rows = {r["event_id"]: (r["start_us"], r["dur_us"], r["beats"], r["bar"], round(r["beat"], 3), r["on_grid"]) for r in alignment.aligned(events, fixed).collect()}
    assert rows[1] == rows[2][:1] + (300_000, 0.5, 1, 2.0, True) and rows[2] == (620_000, 600_000, 1.0, 1, 2.0, True)
    assert rows[3] == (2_720_000, 1_200_000, 2.0, 2, 1.5, True) and rows[4][3:] == (1, 1.0, True)
    told = {r["track_id"]: (r["on_grid"], r["off_grid"], r["on_first_beat"]) for r in alignment.statistics(alignment.aligned(events, fixed), fixed).collect()}
    assert told == {1: (3, 0, 0), 3: (1, 0, 1)}
    assert alignment.aligned(events.limit(0), fixed).count() == 0
