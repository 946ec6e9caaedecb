"""Overlap-add in blocks against one array for each track."""

import random

import numpy as np
import pytest

from tessitura.operators import synthesis

SCHEMA = "track_id int, slice_idx long, role string, midi int, freq double, amp double, confidence double, harmonics array<struct<freq: double, amp: double, number: int>>"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for track in range(3):
        for s in range(25):
            for role, n in (("bass", rng.randint(0, 6)), ("chord", rng.randint(0, 8)), ("melody", rng.randint(0, 4)), ("unknown", 1)):
                if s % 7 == 3:
                    continue
                for midi in rng.sample(range(30, 90), n):
                    f = 440 * 2 ** ((midi - 69) / 12)
                    rows.append((track, s, role, midi, f, rng.random() + 0.1, rng.random(), [(f * k, rng.random(), k) for k in (2, 3)] if rng.random() < 0.7 else None))
    return rows


def whole(rows, rate, window, hop, slices):
    """stem -> samples of a track, in one array each."""
    t, shape = np.arange(window) / rate, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    out = {stem: np.zeros(slices * hop + window) for stem in synthesis.STEMS}
    for s in range(slices):
        for stem, (most, _) in synthesis.STEMS.items():
            for _, _, _, _, f, a, c, harmonics in sorted((r for r in rows if r[1] == s and r[2] == stem), key=lambda r: r[3])[:most]:
                wave = a * c * np.sin(2 * np.pi * f * t)
                for hf, ha, _ in harmonics or []:
                    if hf < rate / 2:
                        wave = wave + ha * c * np.sin(2 * np.pi * hf * t)
                out[stem][s * hop : s * hop + window] += wave * shape
    out["combined"] = sum(out[stem] * part for stem, (_, part) in synthesis.STEMS.items())
    return {stem: x / np.abs(x).max() * 0.9 * 32767 if np.abs(x).max() > 0 else x for stem, x in out.items()}


@pytest.mark.parametrize("window,hop", [(64, 16), (50, 16), (16, 16), (10, 30)])
def test_blocks_equal_whole_arrays(spark, window, hop):
    rows = made(1)
    table = spark.createDataFrame([*rows, (None, 0, "bass", 40, 100.0, 1.0, 1.0, None), (0, None, "bass", 40, 100.0, 1.0, 1.0, None), (1, 2, "bass", 20, None, 1.0, 1.0, None)], SCHEMA).repartition(3)
    slices = spark.createDataFrame([(t, 25) for t in range(3)], "track_id int, n int")
    found = synthesis.with_silence(synthesis.resynthesised(table, 2000.0, window, hop), slices, window, hop)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["block"]):
        got.setdefault((r["track_id"], r["stem"]), []).extend(r["samples"])
    for track in range(3):
        want = whole([r for r in rows if r[0] == track], 2000.0, window, hop, 25)
        for stem, x in want.items():
            y = np.array(got[track, stem], float)[: len(x)]
            assert len(y) == len(x) and np.abs(np.trunc(x) - y).max() <= 1 and (np.trunc(x) == y).mean() > 0.99


def test_silence_and_no_notes(spark):
    table = spark.createDataFrame([(1, 0, "bass", 40, 0.0, 1.0, 1.0, None)], SCHEMA)
    assert {tuple(r["samples"]) for r in synthesis.resynthesised(table, 2000.0, 8, 4).collect()} == {(0, 0, 0, 0)}
    assert synthesis.resynthesised(table.limit(0), 2000.0, 8, 4).count() == 0
