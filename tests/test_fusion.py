"""Fusion of slices and onsets against plain folds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessitura.operators import fusion, harmony, timeline

BEAT = 500_000.0
LENGTHS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
NOTE = "track_id long, t_us long, slice_idx long, midi int, role string, confidence double, event_id long"


def made(seed, tracks=3, seconds=40):
    rng = random.Random(seed)
    notes, onsets = [], []
    for track in range(tracks):
        for s in range(seconds * 10):
            for midi in {rng.randint(48, 74) for _ in range(rng.randint(0, 5))} | ({50} if s % 60 < 45 else set()):
                notes.append((track, s * 100_000, s, midi, rng.choice(["melody", "chord", "bass", "chord"]), rng.randint(0, 1000) / 1000, len(notes)))
        if track:
            onsets += [(track, rng.randrange(seconds * 1_000_000)) for _ in range(seconds * 2)]
    return notes, onsets + onsets[:5]


def plain_segments(times, duration):
    times = sorted(times)
    if not times:
        return [(0, duration)]
    times = [0] * (times[0] > 100_000) + times + [duration] * (times[-1] < duration - 100_000)
    return [(a, b) for a, b in zip(times, times[1:], strict=False) if b - a >= 50_000]


def plain_fusion(notes, onsets, duration):
    """Events of a track, one segment after the other, with a table of what sounds."""
    spans = plain_segments([t for t in onsets], duration)
    held = []
    for a, b in spans:
        found = defaultdict(lambda: defaultdict(list))
        for _, t, _, midi, role, confidence, _ in notes:
            if a <= t < b:
                found[midi][role].append((t, confidence))
        here = {}
        for midi, roles in found.items():
            role = next(r for r in ("melody", "chord", "bass") if r in roles)
            here[midi] = (role, round(sum(c for _, c in roles[role]) / len(roles[role]), 9), min(t for t, _ in roles[role]))
        held.append(here)
    out, active = [], {}
    for i, (a, b) in enumerate(spans):
        for midi, (role, confidence, first) in held[i].items():
            new = i == 0 or midi not in held[i - 1] or first - a < (b - a) * 0.1
            if confidence < 0.3 or not (new or midi not in active):
                continue
            j = i
            while j + 1 < len(spans) and midi in held[j + 1]:
                j += 1
            beats = min(LENGTHS, key=lambda v: abs(v - (spans[j][1] - a) / BEAT))
            place = round(a / BEAT / 0.25) * 0.25
            start = round(place * BEAT)
            out.append((midi, role, confidence, start, round(beats * BEAT), beats, int(place // 4) + 1, place % 4 + 1, not new))
            active[midi] = start + round(beats * BEAT)
        active = {m: e for m, e in active.items() if e > b}
    return out


@pytest.fixture(scope="module")
def sample(spark):
    notes, onsets = made(1)
    return notes, onsets, spark.createDataFrame([*notes, (None, 1, 0, 60, "bass", 1.0, -1), (1, 100_000, 1, 60, "unknown", 1.0, -2)], NOTE).repartition(3), spark.createDataFrame([*onsets, (None, 5), (2, None)], "track_id long, t_us long")


def test_events_equal_a_plain_fold(sample):
    notes, onsets, n, o = sample
    got = defaultdict(list)
    for r in fusion.fused(n, o, 40_000_000, BEAT).collect():
        got[r["track_id"]].append((r["midi"], r["role"], r["velocity"], r["start_us"], r["dur_us"], r["beats"], r["bar"], r["beat"], r["is_tied"]))
    for track in range(3):
        want = plain_fusion([x for x in notes if x[0] == track], [t for k, t in onsets if k == track], 40_000_000)
        assert sorted(got.pop(track)) == sorted(want) and (track == 0 or any(e[-1] for e in want))
    assert not got


def test_a_pickup_and_times_that_are_kept(spark):
    notes = spark.createDataFrame([(1, t * 100_000, t, 60, "melody", 0.9, t) for t in range(20)], NOTE)
    onsets = spark.createDataFrame([(1, 330_000), (1, 1_290_000)], "track_id long, t_us long")
    got = {(r["start_us"], r["bar"], r["beat"]) for r in fusion.fused(notes, onsets, 2_000_000, BEAT, first_us=800_000).collect()}
    assert got == {(0, 0, 1.0), (330_000, 0, 1.0), (1_300_000, 1, 2.0)}
    free = fusion.fused(notes, onsets, 2_000_000, BEAT, snap_starts=False, snap_lengths=False).collect()
    assert {(r["start_us"], r["dur_us"]) for r in free} == {(0, 2_000_000), (330_000, 1_670_000), (1_290_000, 710_000)}


def test_tables_without_rows(sample):
    *_, n, o = sample
    none = n.limit(0)
    assert fusion.score(none, o, 40_000_000, 100_000, BEAT).count() == 0
    assert {r["track_id"]: r["n"] for r in fusion.segments(o.limit(0), n, 40_000_000).groupBy("track_id").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 1, 2: 1}


def plain_hands(events):
    """(midi, hand) of events of one start, as (midi, role), that two hands play."""
    left = [m for m, r in events if m < 60 or r == "bass"]
    top = max(left, default=None)
    right = []
    for m, r in events:
        if not (m < 60 or r == "bass"):
            (left if top is not None and m - top <= 12 and m < 72 else right).append(m)

    def span(notes, prefer):
        notes = sorted(set(notes))
        if len(notes) <= 1 or (notes[-1] - notes[0] <= 10 and len(notes) <= 5):
            return notes
        tried = []
        for s in notes:
            w = [x for x in notes if s <= x <= s + 10]
            if len(w) > 5:
                w = w[:5] if prefer == "low" else sorted([w[0], *w[1:-1][:: max(1, (len(w) - 2) // 4)][:3], w[-1]])
            tried.append((100 * len(w) - sum(w) / len(w) if prefer == "low" else 100 * len(w) + 50 * (notes[0] in w) + 30 * (notes[-1] in w), w))
        return max(tried, key=lambda t: t[0])[1]

    return {(m, "left") for m in span(left, "low")} | {(m, "right") for m in span(right, "outer")}


def test_two_hands_by_hand(spark):
    rng = random.Random(2)
    groups = [[(rng.randint(36, 96), rng.choice(["melody", "chord", "bass", "unknown", None])) for _ in range(rng.randint(1, 14))] for _ in range(150)]
    rows = [(k * 100 + j, 1, m, r, k) for k, g in enumerate(groups) for j, (m, r) in enumerate(g)]
    got = defaultdict(set)
    found = fusion.two_hands(spark.createDataFrame(rows, "event_id long, track_id long, midi int, role string, start_us long")).collect()
    for r in found:
        got[r["start_us"]].add((r["midi"], r["hand"]))
    assert len(found) == sum(map(len, got.values()))
    for k, g in enumerate(groups):
        assert got[k] == plain_hands(g)


def plain_smoothing(events, chords):
    """Ids of events (id, midi, role, velocity, start, beats, bar, beat) that stay; chords: part -> (root, type)."""
    parts, stay = defaultdict(list), []
    for e in events:
        parts[e[6], int(e[7] - 1)].append(e)
    for key, some in parts.items():
        some.sort(key=lambda e: (e[4], e[0]))
        kept = []
        for e in (e for e in some if e[2] == "chord"):
            root, kind = chords.get(key, (0, "unknown"))
            pcs = {(root + p) % 12 for p in harmony.ROOT_TEMPLATES.get(kind, range(12))}
            near = any(min((e[1] - p) % 12, (p - e[1]) % 12) <= 2 for p in pcs) or (e[1] - root) % 12 in (2, 5, 9)
            notes = [k[1] for k in kept] + [e[1]]
            pairs = [abs(x - y) % 12 in (1, 2, 6, 10, 11) for i, x in enumerate(notes) for y in notes[i + 1 :]]
            if near and e[5] >= 0.25 and (not pairs or sum(pairs) / len(pairs) < 0.5):
                kept.append(e)
        stay += kept + [e for e in some if e[2] == "melody" and e[5] >= 0.25] + sorted((e for e in some if e[2] == "bass"), key=lambda e: (e[1], -e[3], e[4], e[0]))[:2]
    often = defaultdict(int)
    for e in stay:
        often[e[1]] += 1
    return sorted(e[0] for e in stay if often[e[1]] > 1 or e[5] >= 0.5 or e[2] == "melody")


def test_harmony_takes_notes_in_order(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(30, 90), rng.choice(["melody", "chord", "chord", "bass", "unknown"]), rng.random(), rng.randrange(40) * 125_000, rng.choice([0.125, 0.25, 0.5, 1.0])) for k in range(400)]
    events = [(*r, int(r[4] / BEAT // 4) + 1, r[4] / BEAT % 4 + 1) for r in rows]
    table = spark.createDataFrame([(7, *e) for e in events], "track_id long, event_id long, midi int, role string, velocity double, start_us long, beats double, bar int, beat double")
    told = defaultdict(list)
    for e in events:
        if e[2] in ("chord", "bass"):
            told[e[6], int(e[7] - 1)].append(e[1])
    sets = spark.createDataFrame([(*k, v) for k, v in told.items() if len(v) >= 3], "bar int, part int, midis array<int>")
    chords = {(r["bar"], r["part"]): (r["root"], r["type"]) for r in harmony.chord_root(sets, "midis").collect()}
    assert sorted(r["event_id"] for r in fusion.smoothed_by_harmony(table).collect()) == plain_smoothing(events, chords)


@pytest.mark.parametrize("bucket", [1_000, 70_000, 10**12])
def test_order_in_time_whatever_the_bucket(spark, bucket):
    rng = random.Random(4)
    rows = [(k % 3, rng.randrange(-50_000, 400_000), k) for k in range(300)]
    table = spark.createDataFrame([*rows, (None, 1, 900)], "track_id long, t_us long, id long")
    spans = [(t, a, a + n, f"{t}{a}") for t in range(2) for a, n in ((-20_000, 15_000), (0, 1), (500, 200_000), (200_500, 30_000), (300_000, 0))]
    s = spark.createDataFrame(spans, "track_id long, start_us long, end_us long, start_idx string")
    number = {r["id"]: r["n"] for r in timeline.numbered(table, ["t_us", "id"], "n", bucket).collect()}
    after = {r["id"]: r["after"] for r in timeline.following(table, "t_us", "after", bucket).select("id", "after").collect()}
    inside = {r["id"]: (r["start_us"], r["end_us"], r["start_idx"]) for r in timeline.held_by(table, s, carried=("start_idx",), bucket_us=bucket).collect()}
    for t in range(3):
        mine = sorted((x, k) for k, (tr, x, _) in enumerate(rows) if tr == t)
        assert [number[k] for _, k in mine] == list(range(1, len(mine) + 1))
        times = [x for x, _ in mine]
        assert sorted((x, after[k] if after[k] is not None else 1 << 60) for x, k in mine) == sorted(zip(times, [*times[1:], 1 << 60], strict=True))
        for x, k in mine:
            assert inside.get(k) == next(((a, b, c) for tr, a, b, c in spans if tr == t and a <= x < b), None)
