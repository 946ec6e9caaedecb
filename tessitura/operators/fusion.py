"""Note events from slices of detected notes and from onsets, and what makes them playable.

Notes have track_id, t_us (of their slice), midi, role and confidence; onsets track_id and
t_us. Events have event_id, track_id, midi, role, velocity, start_us, dur_us, beats, bar,
beat and is_tied; event_id is unique in a track and orders the events of a start as they are
listed, from the highest note down. Times are whole microseconds, halves to even.

Rows with a null track, midi or time match nothing; roles other than melody, chord and
bass are left out of the fusion; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import events as ev
from tessitura.operators import harmony, playability, relational, timeline

# Lengths of notes in beats.
NOTE_LENGTHS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
ROLES = ["melody", "chord", "bass"]


def segments(onsets: DataFrame, tracks: DataFrame, duration_us: int, edge_us: int = 100_000, least_us: int = 50_000) -> DataFrame:
    """(track_id, seg_idx, start_us, end_us, before_us) between onsets, the start and the end; before_us is the end of the segment before.

    The start and the end count where no onset is within ``edge_us`` of them; segments under
    ``least_us`` are left out; a track (of ``tracks``) without onsets is one segment.
    """
    marks = onsets.where("track_id is not null and t_us is not null").select("track_id", "t_us").distinct()
    ends = marks.groupBy("track_id").agg(F.min("t_us").alias("low"), F.max("t_us").alias("high"))
    edges = F.array_compact(F.array(F.when(F.col("low") > edge_us, F.lit(0).cast("long")), F.when(F.col("high") < duration_us - edge_us, F.lit(duration_us).cast("long"))))
    marks = marks.unionByName(ends.select("track_id", F.explode(edges).alias("t_us"))).distinct()
    rows = timeline.following(marks, "t_us", "end_us").select("track_id", F.col("t_us").alias("start_us"), "end_us").where(F.col("end_us") - F.col("start_us") >= least_us)
    whole = tracks.select("track_id").distinct().join(ends, "track_id", "left_anti").where("track_id is not null")
    rows = rows.unionByName(whole.select("track_id", F.lit(0).cast("long").alias("start_us"), F.lit(duration_us).cast("long").alias("end_us")))
    rows = timeline.numbered(rows, ["start_us"], "seg_idx")
    before = rows.select("track_id", (F.col("seg_idx") + 1).alias("seg_idx"), F.col("end_us").alias("before_us"))
    return rows.join(before, ["track_id", "seg_idx"], "left").select("track_id", "seg_idx", "start_us", "end_us", "before_us")


def clusters(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per segment and pitch: role (melody before chord before bass), and of that role n, confidence (mean) and first_us."""
    rows = timeline.held_by(notes.where(F.col("role").isin(*ROLES)).select("track_id", "t_us", "midi", "role", "confidence"), spans, carried=("seg_idx", "before_us"))
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    each = rows.groupBy("track_id", "seg_idx", "start_us", "end_us", "before_us", "midi", rank.alias("rank"), "role").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"), F.min("t_us").alias("first_us"))
    best = each.groupBy("track_id", "seg_idx", "start_us", "end_us", "before_us", "midi").agg(F.min(F.struct("rank", "role", "n", "confidence", "first_us")).alias("best"))
    return best.select("track_id", "seg_idx", "start_us", "end_us", "before_us", "midi", "best.role", "best.n", "best.confidence", "best.first_us")


def note_length(beats: Column) -> Column:
    """The nearest of the fixed lengths, of equally near ones the shorter."""
    values = F.array(*map(F.lit, NOTE_LENGTHS))
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - beats).alias("far"), v.alias("value"))))["value"]


def _struck(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, in order of track, pitch and segment, that begin an event: attacks, and held notes that no event of their pitch still covers."""
    key, end = None, None
    for batch in batches:
        keep = []
        for *now, sure, new, until, before in zip(*(batch.column(c).to_pylist() for c in ("track_id", "midi", "sure", "is_new", "until", "before_us")), strict=True):
            if now != key:
                key, end = now, None
            begins = sure and (new or end is None or end <= before)
            if begins:
                end = until
            keep.append(begins)
        yield batch.filter(pa.array(keep, pa.bool_()))


def fused(notes: DataFrame, onsets: DataFrame, duration_us: int, beat_us: float, per_bar: int = 4, first_us: int = 0, least: float = 0.3, early: float = 0.1, snap_starts: bool = True, snap_lengths: bool = True) -> DataFrame:
    """Events: a pitch begins one where it is struck anew in a segment, or is held while no event of it lasts.

    Struck anew is what the segment before lacks or what is seen in the first ``early`` of its
    own. An event lasts to the end of the last of the segments in a row that hold its pitch,
    then its start goes to the nearest sixteenth and its length to the nearest of the
    fixed ones. Whether an event still lasts is the one thing that depends on those before
    it; so rows are sorted by pitch and pass one by one a state of one number.
    """
    rows = clusters(notes, segments(onsets, notes, duration_us))
    by = W.partitionBy("track_id", "midi").orderBy("seg_idx")
    follows = F.coalesce(F.lag("seg_idx").over(by) == F.col("seg_idx") - 1, F.lit(False))
    soon = F.col("first_us") - F.col("start_us") < (F.col("end_us") - F.col("start_us")) * F.lit(early)
    rows = rows.repartition("track_id", "midi").withColumns({"is_new": ~follows | soon, "_island": F.col("seg_idx") - F.row_number().over(by)})
    last = F.max("end_us").over(W.partitionBy("track_id", "midi", "_island"))
    beat = F.lit(beat_us)
    length = (last - F.col("start_us")) / beat
    place = (F.col("start_us") - F.lit(first_us)) / beat
    place = F.when(place >= 0, F.rint(place / 0.25) * 0.25).otherwise(place) if snap_starts else place
    rows = rows.withColumns({"beats": note_length(length) if snap_lengths else length, "_place": place})
    start = F.when((F.col("_place") < 0) | F.lit(not snap_starts), F.col("start_us")).otherwise(F.lit(first_us) + F.rint(F.col("_place") * beat).cast("long"))
    rows = rows.withColumns({"sure": F.col("confidence") >= least, "_start": start, "dur_us": F.rint(F.col("beats") * beat).cast("long")})
    kept = ["track_id", "midi", "role", "confidence", "seg_idx", "before_us", "is_new", "sure", "beats", "_place", "_start", "dur_us", (F.col("_start") + F.col("dur_us")).alias("until")]
    rows = rows.select(*kept).repartition("track_id", "midi").sortWithinPartitions("track_id", "midi", "seg_idx")
    found = rows.mapInArrow(_struck, rows.schema)
    event_id = (F.lit(4096) - F.col("midi")).cast("long") * (1 << 32) + F.col("seg_idx")
    bar, beat_in = scalars.bar_of(F.col("_place"), per_bar), scalars.beat_in_bar(F.col("_place"), per_bar)
    return found.select(event_id.alias("event_id"), "track_id", "midi", "role", F.least(F.lit(1.0), F.col("confidence")).alias("velocity"), F.col("_start").alias("start_us"), "dur_us", "beats", bar.alias("bar"), beat_in.alias("beat"), (~F.col("is_new")).alias("is_tied"))


def two_hands(events: DataFrame, bass_span: int = 10, treble_span: int = 10, most: int = 5, split: int = 60, first: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events, by their start, that two hands can play, with the hand.

    Low notes and those of the bass are the left hand's; so are notes of the right hand within
    an octave of the left hand's highest and under an octave above the split. The left
    hand keeps its lowest notes, the right one its outer ones. Of the events of a pitch in
    a hand the first stays, of these that are not moved.
    """
    start = W.partitionBy("track_id", "start_us")
    low = (F.col("midi") < split) | F.coalesce(F.col("role") == "bass", F.lit(False))
    rows = events.withColumn("_low", low).withColumn("_top", F.max(F.when(F.col("_low"), F.col("midi"))).over(start))
    moved = ~F.col("_low") & F.coalesce((F.col("midi") - F.col("_top") <= 12) & (F.col("midi") < split + 12), F.lit(False))
    rows = rows.withColumn("_moved", moved).withColumn("hand", F.when(F.col("_low") | F.col("_moved"), "left").otherwise("right"))
    pitches = F.collect_set("midi").over(W.partitionBy("track_id", "start_us", "hand"))
    left, right = (playability.hand_span(F.col("_pitches"), span, most, prefer) for span, prefer in ((bass_span, "lowest"), (treble_span, "outer")))
    rows = rows.withColumn("_pitches", pitches).withColumn("_k", F.row_number().over(W.partitionBy("track_id", "start_us", "hand", "midi").orderBy("_moved", *first)))
    played = F.array_contains(F.when(F.col("hand") == "left", left).otherwise(right), F.col("midi"))
    return rows.where(played & (F.col("_k") == 1)).select(*events.columns, "hand")


def fits_chord(midi: Column, root: Column, quality: Column, tolerance: int = 2) -> Column:
    """Whether a note is in a chord, a ninth, eleventh or thirteenth of it, or near one of its notes; all fit an unknown chord."""
    step = F.pmod(midi - root, F.lit(12))

    def near(pcs: list[int]) -> list[int]:
        return [s for s in range(12) if s in (2, 5, 9) or any(min((s - p) % 12, (p - s) % 12) <= tolerance for p in pcs)]

    known = F.create_map(*[x for q, pcs in harmony.ROOT_TEMPLATES.items() for x in (F.lit(q), F.array(*map(F.lit, near(pcs))))])
    return F.coalesce(F.array_contains(F.try_element_at(known, quality), step), F.lit(True))


def smoothed_by_harmony(events: DataFrame, parts: int = 4, least: int = 3, tense: float = 0.5, least_beats: float = 0.25, drop_isolated: bool = True) -> DataFrame:
    """Events that agree with the harmony of their part of a bar.

    Each part of a bar has a chord, if enough notes of chord and bass tell it. Chord notes are
    taken one after the other: those that fit the chord, last long enough and leave the notes
    taken so far less tense than ``tense``. Long melody notes stay, and the two lowest of the
    bass. Then short notes of a pitch that no other event of the track has go, but for
    melody. Other roles go. A part of a bar is a group of few events.
    """
    part = F.floor((F.col("beat") - 1) * parts / 4).cast("int")
    row = F.struct(F.col("start_us").alias("_at"), F.col("event_id").alias("_id"), *[F.col(f"`{c}`") for c in events.columns])
    groups = events.where(F.col("role").isin(*ROLES)).groupBy("track_id", "bar", part.alias("part")).agg(F.array_sort(F.collect_list(row)).alias("all"))
    of = lambda role: F.filter("all", lambda e: e["role"] == role)
    groups = groups.withColumns({"melody": of("melody"), "chords": of("chord"), "bass": of("bass")})
    told = F.transform(F.concat("chords", "bass"), lambda e: e["midi"])
    groups = harmony.chord_root(groups.withColumn("told", F.when(F.size(told) >= least, told).otherwise(F.array().cast("array<int>"))), "told")
    long = lambda e: e["beats"] >= least_beats
    fitting = F.filter("chords", lambda e: long(e) & fits_chord(e["midi"], F.col("root"), F.col("type")))
    rank = F.transform("bass", lambda e: F.struct(e["midi"].alias("midi"), (-e["velocity"]).alias("soft"), e["_at"].alias("at"), e["_id"].alias("id"), e.alias("e")))
    groups = groups.withColumns({"fitting": fitting, "melody": F.filter("melody", long), "bass": F.transform(F.slice(F.array_sort(rank), 1, 2), lambda r: r["e"])})

    def taken(state: Column, e: Column) -> Column:
        kept, clash = state["kept"], state["clash"]
        more = clash + F.size(F.filter(kept, lambda k: F.pmod(F.abs(k["midi"] - e["midi"]), F.lit(12)).isin(*harmony.DISSONANT)))
        n = F.size(kept)
        calm = F.when(n == 0, F.lit(0.0) < tense).otherwise(more / (n * (n + 1) / 2) < tense)
        return F.when(calm, F.struct(F.concat(kept, F.array(e)).alias("kept"), more.alias("clash"))).otherwise(state)

    kind = groups.schema["fitting"].dataType
    chosen = F.aggregate("fitting", F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("clash")), taken, lambda s: s["kept"])
    rows = groups.select(F.explode(F.concat("melody", chosen, "bass")).alias("e")).select(*[F.col("e").getField(c).alias(c) for c in events.columns])
    if drop_isolated:
        rows = rows.withColumn("_n", F.count("*").over(W.partitionBy("track_id", "midi"))).where("_n > 1 or beats >= 0.5 or role = 'melody'").drop("_n")
    return rows


def playable(events: DataFrame, notes: DataFrame, slice_us: int, beat_us: float, bass: int = 2, chord: int = 4, melody: int = 2, share: float = 0.4, vote: bool = True, rebalance: bool = True, hands: bool = True) -> DataFrame:
    """Events that enough slices hold, few of each role at a start, that two hands can play."""
    columns = events.columns
    if vote:
        events = ev.by_majority(ev.present(events, notes, slice_us), beat_us, share).select(*columns)
    if rebalance:
        events = relational.balanced(events.withColumns({"slice_idx": F.col("start_us"), "confidence": F.col("velocity")}), bass, chord, melody).select(*columns)
    if hands:
        role = F.array_position(F.array(*map(F.lit, ["bass", "chord", "melody"])), F.coalesce("role", F.lit("")))
        rows = events.withColumn("_role", F.when(role == 0, 4).otherwise(role))
        events = two_hands(rows, first=("_role", "event_id")).select(*columns)
    return events


def score(notes: DataFrame, onsets: DataFrame, duration_us: int, slice_us: int, beat_us: float, per_bar: int = 4, first_us: int = 0, chord: int = 4, total: int = 8) -> DataFrame:
    """The whole job: fusion, what is playable, harmony, and how many notes sound at a start; notes have slice_idx too."""
    events = fused(notes, onsets, duration_us, beat_us, per_bar, first_us)
    events = smoothed_by_harmony(playable(events, notes, slice_us, beat_us, chord=chord))
    thin = relational.thinned(events.withColumns({"slice_idx": F.col("start_us"), "confidence": F.col("velocity")}), chord, total)
    return thin.select(*events.columns)
