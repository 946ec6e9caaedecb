"""Tempo and beat grids of click tracks, against plain versions."""

import random

import numpy as np
import pytest

from tessitura.operators import grid, tempo

ONSETS = "track_id long, t_us long"
CLICKS = [(1, 60), (2, 75), (3, 96), (4, 120), (5, 150), (6, 180)]


@pytest.fixture(scope="module")
def clicks(spark):
    """48 beats of each track from 0.37 s on; of more than 50 only each third would count."""
    rng = random.Random(1)
    rows = [(t, 370_000 + round(k * 60e6 / bpm) + rng.randrange(-3000, 3000)) for t, bpm in CLICKS for k in range(48)]
    return spark.createDataFrame(rows, ONSETS).repartition(3)


def test_click_tracks_have_their_tempo(clicks):
    got = {r["track_id"]: (r["bpm"], r["first_us"], r["bar_alignment"]) for r in grid.found_grid(clicks, 50_000_000).collect()}
    assert set(got) == {t for t, _ in CLICKS}
    for t, bpm in CLICKS:
        ratio = got[t][0] / bpm
        assert min(abs(ratio / f - 1) for f in (0.5, 1, 2)) < 0.03, (bpm, got[t])
        beat = 60e6 / bpm
        off = (got[t][1] - 370_000) / beat
        assert abs(off - round(off)) < 0.15 or abs(off * 2 - round(off * 2)) < 0.3


def test_phase_for_a_known_tempo(spark, clicks):
    tempi = spark.createDataFrame([(t, float(b)) for t, b in CLICKS] + [(9, 100.0)], "track_id long, bpm double")
    got = {r["track_id"]: r for r in grid.best_phase(clicks, tempi, 50_000_000).collect()}
    assert got[9]["first_us"] == 0 and got[9]["total"] is None
    for t, bpm in CLICKS:
        beat = 60e6 / bpm
        off = (got[t]["first_us"] - 370_000) / beat
        assert abs(off * 2 - round(off * 2)) < 0.1 and got[t]["beat_alignment"] > 0.9


def plain_tempi(times, low=40, high=200, bins=100):
    """Distinct tempi in order of likelihood."""
    if len(times) < 3:
        return [120.0]
    gaps = np.diff(sorted(times)) / 1e6
    gaps = gaps[(gaps >= 60 / high) & (gaps <= 60 / low)]
    if len(gaps) < 3:
        return [120.0, 90.0, 100.0]
    n, edges = np.histogram(gaps, bins)
    found = [(60 / ((edges[i] + edges[i + 1]) / 2), n[i]) for i in range(1, bins - 1) if n[i] > n[i - 1] and n[i] > n[i + 1] and n[i] > 2]
    found = sorted(found or [(60 / np.median(gaps), 1)], key=lambda c: -c[1])[:5]
    out = []
    for bpm, _ in found:
        out += [b for b in (bpm, bpm / 2, bpm * 2) if b == bpm or low <= b <= high]
    return list(dict.fromkeys(round(float(b), 6) for b in out))


def test_interval_tempi_equal_a_plain_histogram(spark):
    rng = random.Random(2)
    tracks = {t: [rng.randrange(60_000_000) for _ in range(n)] for t, n in enumerate((0, 1, 2, 3, 5, 60, 200, 400))}
    tracks[8] = [k * 500_000 for k in range(50)]
    tracks[9] = [int(k * 400_000 + (k % 3) * 100_000) for k in range(90)]
    rows = spark.createDataFrame([(t, x) for t, xs in tracks.items() for x in xs] + [(None, 5)], ONSETS)
    got = {}
    for r in sorted(grid.interval_tempi(rows).where("track_id is not null").collect(), key=lambda r: r["place"]):
        got.setdefault(r["track_id"], []).append(round(r["bpm"], 6))
    assert got == {t: plain_tempi(xs) for t, xs in tracks.items() if xs}


def plain_gram(x, fps, low, high, window, hop):
    size, step, out = int(window * fps), int(hop * fps), []
    for s in range(0, len(x) - size, step):
        seg = np.array(x[s : s + size])
        r = np.correlate(seg, seg, "full")[size - 1 :]
        r = r / r[0] if r[0] > 0 else r
        best = (120.0, 0.0)
        for bpm in range(low, high + 1):
            lag = int(fps * 60 / bpm)
            if 0 < lag < size and round(r[lag], 12) > best[1]:
                best = (float(bpm), round(float(r[lag]), 12))
        out.append((s / fps, *best))
    return out


def test_tempograms_equal_plain_windows(spark):
    rng = random.Random(3)
    curves = {1: [rng.random() if k % 8 == 0 else rng.random() / 20 for k in range(400)], 2: [0.0] * 200, 3: [1.0] * 20, 4: [rng.random() for _ in range(301)]}
    rows = spark.createDataFrame([(t, k + 5, x) for t, xs in curves.items() for k, x in enumerate(xs)], "track_id int, frame_idx long, x double").repartition(4)
    found = tempo.tempogram(rows, "x", 16.0, window=5.0, hop=2.0)
    got = {}
    for r in found.collect():
        got.setdefault(r["track_id"], []).append((r["start"], r["bpm"], round(r["strength"], 9)))
    want = {t: [(s, b, round(v, 9)) for s, b, v in plain_gram(xs, 16.0, 60, 160, 5.0, 2.0)] for t, xs in curves.items()}
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v}
    steady = {r["track_id"]: (r["bpm"], round(r["confidence"], 9)) for r in tempo.steady_tempo(rows, found).collect()}
    for t, windows in want.items():
        sure = [b for _, b, v in windows if v > 0.2]
        assert steady[t] == ((float(np.median(sure)), round(max(0.0, 1 - float(np.std(sure)) / 30), 9)) if sure else (120.0, 0.0))
    assert tempo.tempogram(rows.limit(0), "x", 16.0).count() == 0


@pytest.mark.parametrize("chunk", [10, 64, 4096])
def test_correlation_whatever_the_chunk(spark, chunk):
    rng = random.Random(4)
    curves = {1: [rng.random() for _ in range(150)], 2: [float(k % 12 == 0) for k in range(200)], 3: [0.0] * 30, 4: [1.0]}
    rows = spark.createDataFrame([(t, k, x) for t, xs in curves.items() for k, x in enumerate(xs)], "track_id int, frame_idx long, x double")
    for r in tempo.correlation(rows, "x", 40, chunk).collect():
        x = np.array(curves[r["track_id"]])
        full = np.correlate(x, x, "full")[len(x) - 1 :][:41]
        full = full / full[0] if full[0] > 0 else full
        assert np.allclose(r["r"][: len(full)], full) and r["n"] == len(x)
    got = {r["track_id"]: r["bpm"] for r in tempo.correlated_tempi(rows, "x", 20.0).where("strength > 0.5").collect()}
    assert got[2] == 100.0


def plain_downbeat(times, bpm, window):
    """What the grid of each early onset gathers, in the order of the sums; the track's first where there is none."""
    times = np.array(sorted(times))
    found = []
    for at in sorted({int(t) for t in times if t < window}):
        beats = ((times[times >= at] - at) / 1e6) / (60.0 / bpm)
        far = np.abs(beats - np.rint(beats))
        found.append((round(float(np.where(far < 0.15, 1 - far, 0).sum()), 6), -at))
    return -max(found)[1] if found else int(times[0])


@pytest.mark.parametrize("bpm,window", [(67.0, 30_000_000), (67.0, 9_000), (120.0, 2_000_000), (97.53, 3_000_000_000), (70.58823529411765, 5_000_000), (133.3, 1 << 24)])
def test_downbeats_equal_all_pairs(spark, bpm, window):
    rng = random.Random(f"{bpm} {window}")
    beat = 60e6 / bpm
    tracks = {
        1: [rng.randrange(0, window * 2) for _ in range(400)],
        2: [rng.randrange(-window, window) for _ in range(300)],  # before 0, and none after the window
        3: [rng.randrange(window, window * 3) for _ in range(50)],  # none in it
        4: [round(333 + k * beat) + rng.choice([0, 0, 1, -1, round(0.15 * beat), round(0.15 * beat) - 1, -round(0.15 * beat)]) for k in range(300)] * 2,  # at the limit
        5: [rng.randrange(min(window, 5000)) for _ in range(300)] + [10**10 + 7 * k for k in range(100)],
        6: [window - 1] * 9 + [window] * 3,
        7: [0],
    }
    rows = [(track, t) for track, times in tracks.items() for t in times]
    table = spark.createDataFrame([*rows, (8, None), (None, 5), (None, 3), (1, None)], ONSETS).repartition(3)
    want = {track: plain_downbeat(times, bpm, window) for track, times in tracks.items()}
    assert {r["track_id"]: r["downbeat_us"] for r in tempo.first_downbeat(table, bpm, window).collect()} == {**want, 8: None, None: 3}


def test_downbeats_at_the_limit_are_rounded_as_their_distances(spark):
    """15/100 of a beat, 134328.36 microseconds at 67, is met by whole beats besides: what rounds below it counts."""
    least = 9_000_000 * pow(67, -1, 60_000_000) % 60_000_000
    spread = [least + 60_000_000 * k for k in range(80)]
    far = [abs(b - round(b)) for b in ((d / 1e6) / (60.0 / 67.0) for d in spread)]
    assert 0 < sum(f < 0.15 for f in far) < len(far)
    tracks = {k: [0, 1, d, d + 1 + 400_000 * (k % 2)] for k, d in enumerate(spread)}
    table = spark.createDataFrame([(k, t) for k, times in tracks.items() for t in times], ONSETS)
    assert {r["track_id"]: r["downbeat_us"] for r in tempo.first_downbeat(table, 67.0, 1_000_000).collect()} == {k: plain_downbeat(times, 67.0, 1_000_000) for k, times in tracks.items()}


def rows_out(plan):
    """The most rows that a step of an executed plan gave out."""
    found = plan.metrics().get("numOutputRows")
    inner = [getattr(plan, name)() for name, kind in (("finalPhysicalPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if kind in plan.nodeName()]
    children = plan.children()
    inner += [children.apply(k) for k in range(children.size())]
    return max([found.get().value() if found.isDefined() else 0, *map(rows_out, inner)])


def test_downbeats_do_not_pair_early_onsets_with_all(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([(1, t) for t in rng.sample(range(20_000_000), 10_000)], ONSETS)
    found = tempo.first_downbeat(table, 67.0, 2_000_000)
    found.collect()
    assert 10_000 < rows_out(found._jdf.queryExecution().executedPlan()) < 200_000  # about 1,000 times 9,500 pairs
