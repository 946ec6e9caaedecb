"""Operators on events, grids, names and spectra: against plain versions and on empty, null and tied rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import names
from tessitura.operators import events, grid, harmony, spectra
from tessitura.sources import documents

EVENT = "event_id long, track_id long, midi int, role string, velocity double, start_us long, dur_us long"


@pytest.mark.parametrize("name,sharp,midi,freq", [
    ("C4", 60, 60, 261.6256), ("C#4", 61, 61, 277.1826), ("Bb3", 0, 58, 233.0819), ("A4", 69, 69, 440.0), ("E#4", 65, 65, 261.6256), ("c4", 60, 0, 0.0),
    ("C-1", 0, 0, 8.1758), ("H4", 0, 0, 0.0), ("", 0, 0, 0.0), ("-", 0, 0, 0.0), ("C4x", 0, 0, 261.6256), (None, 0, 0, 0.0),
])
def test_note_names(spark, name, sharp, midi, freq):
    row = spark.createDataFrame([(name,)], "name string").select(names.midi_of_sharp_name(F.col("name")), names.midi_of_name(F.col("name")), F.round(names.freq_of_name(F.col("name")), 4)).first()
    assert tuple(row) == (sharp, midi, freq)


def test_merged_events_equal_a_fold(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, 60 + i % 3, "chord", rng.random(), rng.randrange(3_000_000), 100_000 * rng.randrange(1, 8)) for i in range(150)]
    table = spark.createDataFrame(rows + [(900, None, None, None, None, None, None)], EVENT)
    want = []
    for key in {(r[1], r[2]) for r in rows}:
        now = None
        for r in sorted((r for r in rows if r[1:3] == key), key=lambda r: (r[5], r[0])):
            if now and (r[5] - now[1]) / 500_000 < 0.125:
                now = [now[0], r[5] + r[6], now[2] + 1]
                want[-1] = (key, now[0], now[1] - now[0], now[2])
            else:
                now = [r[5], r[5] + r[6], 1]
                want.append((key, now[0], r[6], 1))
    got = [((r["track_id"], r["midi"]), r["start_us"], r["dur_us"], r["parts"]) for r in events.merged(table, 500_000.0).collect() if r["midi"] is not None]
    assert sorted(got) == sorted(want)
    assert events.merged(table.limit(0), 500_000.0).count() == 0


def test_peaks_by_hand():
    assert spectra.peaks(np.array([0, 1, 0, 2, 2, 2, 0, 3.0])).tolist() == [1, 4]
    assert spectra.peaks(np.array([0, 3, 0, 5, 0, 4, 0.0]), distance=3).tolist() == [3]
    assert spectra.peaks(np.array([0, 5, 4, 4.5, 0.0]), prominence=1).tolist() == [1]
    assert spectra.peaks(np.array([0, 1, 0, 2, 0.0]), height=1.5).tolist() == [3]
    assert spectra.peaks(np.zeros(0)).tolist() == spectra.peaks(np.ones(5)).tolist() == []


def test_a_tone_has_its_peak_and_a_short_signal_no_frame(spark):
    tone = [math.sin(2 * math.pi * 440 * i / 8000) for i in range(2048)]
    rows = spark.createDataFrame([(1, tone, 7), (2, [0.0] * 100, 7), (3, None, 7), (4, [], 7), (5, [0.0] * 2048, 7)], "id long, x array<double>, peaks int")
    frames = spectra.framed(rows, "x", 1024, 512)
    assert {r["id"]: r["n"] for r in frames.groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 3, 5: 3}
    found = spectra.spectral_peaks(spectra.spectrum(frames, "frame", "mags", "hann", 2), "mags", 50, 500).where("frame_idx = 1").collect()
    assert {r["id"]: [round(p * 8000 / 2048) for p in r["peaks"]][:1] for r in found} == {1: [441], 5: []}
    assert spectra.spectrum(rows.limit(0), "x").count() == 0
    assert abs(spectra.window("hanning", 5)[-1]) < 1e-12 < spectra.window("hann", 5)[-1]


def test_grids_and_tempi_of_a_click_track(spark):
    rows = spark.createDataFrame([(1, 400_000 + 600_000 * i) for i in range(40)] + [(2, 5), (3, None)], "track_id long, t_us long")
    onsets = rows.where("t_us is not null")
    grids = onsets.select("track_id").distinct().select("track_id", F.explode(F.array(*map(F.lit, [90.0, 100.0, 110.0]))).alias("bpm"), F.lit(400_000).cast("long").alias("first_us"))
    best = {r["track_id"]: r for r in grid.best(grid.scores(onsets, grids, 24_000_000)).collect()}
    assert best[1]["bpm"] == 100 and round(best[1]["beat_alignment"], 6) == 1 and best[1]["bar_coverage"] == 1
    assert sorted((r["track_id"], round(r["bpm"])) for r in grid.interval_tempi(onsets).collect()) == [(1, 50), (1, 99), (1, 198), (2, 120)]
    assert grid.scores(onsets.limit(0), grids, 1).count() == grid.interval_tempi(onsets.limit(0)).count() == 0


def test_artefacts_and_skyline(spark):
    melody = spark.createDataFrame([(1, 1, 0, 72, 523.25, 1.0, 0.9), (2, 1, 0, 76, 659.26, 1.0, 0.9), (3, 1, 0, 79, 783.99, 1.0, 0.2), (4, 1, 0, 76, 659.0, 1.0, 0.9), (5, 1, 1, 72, 0.0, 1.0, None)], "event_id long, track_id long, slice_idx long, midi int, freq double, amp double, confidence double")
    others = spark.createDataFrame([(1, 0, [(523.0, 9.0, 2)]), (1, 0, None), (1, 1, [])], "track_id long, slice_idx long, harmonics array<struct<freq: double, amp: double, num: int>>")
    left = events.artefacts_removed(melody, others)
    assert sorted(r["event_id"] for r in left.collect()) == [2, 3, 4, 5]
    assert [r["event_id"] for r in events.skyline(left).collect()] == [2]


def test_documents_come_back(spark):
    rows = spark.createDataFrame([(1, 7, 60, "bass", 0.12345, 1_000_000, 500_000), (2, 7, 72, None, None, 1_000_000, 250_000)], EVENT)
    docs = documents.event_documents(rows, 60.0)
    back = documents.events_of_documents(docs.unionByName(spark.createDataFrame([(9, "no json"), (8, None)], docs.schema))).collect()
    assert [(r["event_id"], r["name"], r["duration_beats"], r["velocity"]) for r in back] == [(2, "C5", 0.25, None), (1, "C4", 0.5, 0.123)]
    assert documents.event_documents(rows.limit(0), 60.0).count() == 0


def test_intervals_and_marks_of_doubt(spark):
    rows = spark.createDataFrame([([62, 65, 69, 74, None],), ([],), (None,)], "m array<int>")
    assert [r[0] for r in rows.select(harmony.intervals(F.col("m"))).collect()] == [[0, 3, 7], [], []]
    shown = spark.createDataFrame([("C", 0.9), ("C", 0.6), ("C", 0.1), (None, None)], "n string, s double").select(harmony.shown(F.col("n"), F.col("s"), width=4)).collect()
    assert [r[0] for r in shown] == ["C   ", "C?  ", "C?? ", "-   "]
