"""Peaks of curves in chunks, onsets of clicks and notes of chords."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import detection, peaks, spectra


def plain_peaks(x, height, distance, prominence):
    """By definition, on the whole curve."""
    n, at, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            at.append((i + j) // 2)
        i = j + 1
    at = [p for p in at if x[p] >= height]
    kept = []
    for p in sorted(at, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def base(side, top):
        low = math.inf
        for v in side:
            if v > top:
                break
            low = min(low, v)
        return low

    return sorted(p for p in kept if x[p] - max(base(x[:p][::-1], x[p]), base(x[p + 1 :], x[p])) >= prominence)


def curves():
    rng = random.Random(1)
    walk = [0.0]
    for _ in range(500):
        walk.append(round(walk[-1] + rng.choice([-1, 0, 0, 1]) * rng.random(), 2))
    return [
        [rng.randint(0, 3) for _ in range(400)],
        walk,
        [0.5] * 300,
        [float(k) for k in range(300)],
        [k % 2 + k / 1000 for k in range(300)],
        [1.0] + [0.0] * 150 + [0.4] + [0.0] * 200 + [2.0, 0.0],
        [math.sin(k / 40) + 0.01 * math.sin(k * 2) for k in range(700)],
        [3.0], [1.0, 2.0, 1.0],
    ]


@pytest.mark.parametrize("chunk,distance,prominence", [(7, 1, 0.3), (16, 5, 0.5), (50, 30, 0.01), (4096, 5, 0.5)])
def test_peaks_are_those_of_the_whole_curve(spark, chunk, distance, prominence):
    rows = [(t, k + 3, float(x), 0.25) for t, c in enumerate(curves()) for k, x in enumerate(c)]
    table = spark.createDataFrame([*rows, (None, 1, 9.0, 0.0), (90, None, 9.0, 0.0)], "track_id int, frame_idx long, x double, h double").repartition(3)
    got = {}
    for r in peaks.picked(table, "x", "h", distance, prominence, chunk).collect():
        got.setdefault(r["track_id"], []).append(r["frame_idx"] - 3)
    for t, c in enumerate(curves()):
        assert sorted(got.get(t, [])) == plain_peaks(c, 0.25, distance, prominence) == spectra.peaks(np.array(c, float), 0.25, distance, prominence).tolist()


def test_no_curve_has_no_peaks(spark):
    assert peaks.picked(spark.createDataFrame([], "track_id int, frame_idx long, x double, h double"), "x", "h").count() == 0


def test_values_of_the_frame_before(spark):
    rows = spark.createDataFrame([(t, k, k * 10 + t) for t in range(2) for k in range(20)], "track_id int, frame_idx long, v int")
    for size in (1, 3, 100):
        got = {(r["track_id"], r["frame_idx"]): r["last"] for r in detection.with_last(rows, "v", "last", size).collect()}
        assert got == {(t, k): None if k == 0 else (k - 1) * 10 + t for t in range(2) for k in range(20)}


def test_clicks_are_onsets(spark):
    rate, hop, size = 8000, 128, 512
    x = np.random.default_rng(2).normal(0, 0.001, rate * 4)
    clicks = [0.5, 1.0, 1.6, 2.7, 3.3]
    for c in clicks:
        at = int(c * rate)
        x[at : at + 200] += np.sin(np.arange(200)) * np.exp(-np.arange(200) / 60)
    signals = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 4000), (3, []), (4, None)], "track_id int, x array<double>")
    frames = spectra.framed(signals, "x", size, hop)
    got = [(r["track_id"], r["t_us"] / 1e6, r["strength"]) for r in detection.onsets(frames, "frame", rate, hop, over=1.0).collect()]
    assert {t for t, *_ in got} == {1} and max(s for *_, s in got) <= 1
    assert all(any(-size / rate - 0.02 <= t - c <= 0.02 for _, t, _ in got) for c in clicks) and all(any(abs(t - c) < 0.1 for c in clicks) for _, t, _ in got)
    envelope = detection.onset_envelope(frames, "frame").groupBy("track_id").agg(F.max("strength").alias("most")).collect()
    assert {r["track_id"]: round(r["most"], 6) for r in envelope} == {1: 1.0, 2: 0.0} or dict(envelope)[1] <= 1.0
    assert detection.onsets(frames.limit(0), "frame", rate, hop).count() == 0


@pytest.mark.parametrize("chord", [[60], [60, 64, 67], [57, 60, 65], [62, 69]])
def test_chords_give_their_notes(spark, chord):
    rate, size = 22050, 8192
    t = np.arange(size) / rate
    x = sum(sum(0.5 ** (n - 1) * np.sin(2 * np.pi * n * 440 * 2 ** ((m - 69) / 12) * t) for n in (1, 2, 3)) for m in chord)
    table = spark.createDataFrame([(1, x.tolist(), "k"), (2, [0.0] * size, "k"), (3, None, "k")], "id int, x array<double>, notes string")
    found = detection.detected_notes(spectra.spectrum(table, "x", "mags", "hann", 2), "mags", rate, 130.0, 1500.0, most=len(chord))
    rows = {r["id"]: r["notes"] for r in found.collect()}
    assert [n["midi"] for n in rows[1]] == chord and rows[2] == [] and rows[3] is None
    assert all(abs(n["freq"] - 440 * 2 ** ((n["midi"] - 69) / 12)) < 3 and 0.2 <= n["confidence"] <= 1 for n in rows[1])
    named = detection.note_rows(found, "chord").where("id = 1")
    assert named.count() == len(chord) and set(named.columns) >= {"midi", "name", "role", "harmonics"}


def plain_notes(peaks_, low, most, least):
    """Candidates one after the other, with sets."""
    tried = sorted({f for f, _ in peaks_} | {f / n for f, _ in peaks_ for n in (2, 3, 4, 5) if f / n >= low})
    rated = []
    for f in tried:
        met = [(p, a, round(p / f)) for p, a in peaks_ if 1 <= round(p / f) <= 8 and abs(p / f - round(p / f)) / round(p / f) < 0.03]
        ns = sorted(n for *_, n in met)
        score = sum(a / n for _, a, n in met) * (1.2 if 1 in ns else 1) * (1 + sum(0.1 for x, y in zip(ns, ns[1:], strict=False) if y == x + 1))
        if met:
            rated.append((-round(score, 9), f, met))
    used, out = set(), []
    for score, f, met in sorted(rated):
        own = {p for p, *_ in met}
        if len(own & used) > len(own) / 2 or score / sorted(rated)[0][0] < least or len(out) == most:
            continue
        out.append((round(69 + 12 * math.log2(f / 440)), round(sum(a for _, a, _ in met), 6)))
        used |= own
    return sorted(out)


def test_the_sieve_equals_plain_sets():
    rng = random.Random(3)
    for _ in range(200):
        some = sorted({(round(rng.uniform(100, 2000), 1), round(rng.random(), 3)) for _ in range(rng.randint(1, 12))}, key=lambda p: -p[1])
        got = detection.notes_of(np.array([p for p, _ in some]), np.array([a for _, a in some]), 100.0, 4, 0.2)
        assert sorted((n["midi"], round(n["energy"], 6)) for n in got) == plain_notes(some, 100.0, 4, 0.2)


def test_frames_around_a_time(spark):
    rows = spark.createDataFrame([([float(k) for k in range(10)], s) for s in (0.0, 0.5, 0.95, 3.0)], "x array<double>, s double")
    got = [r[0] for r in rows.select(detection.frame_at(F.col("x"), F.col("s"), 10.0, 4)).collect()]
    assert got == [[0, 1, 2, 3], [3, 4, 5, 6], [7, 8, 9, 0], [0, 0, 0, 0]]
