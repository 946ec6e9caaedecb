"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import harmony, playability, relational, signal, tempo
from tessitura.sources import adapters, documents

BPM = 67.0
SPAN_US = 300_000_000
DET = """det AS (SELECT event_id, user_id % 16 AS track_id, (epoch_us(ts) - 1704067200000000) // 8640 AS t_us, (epoch_us(ts) - 1704067200000000) // 8640 // 100000 AS slice_idx,
  36 + (cast(json_extract_string(props, '$.k') AS int) % 48) AS midi, cast(json_extract_string(props, '$.k') AS int) AS k, value AS amp, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS confidence,
  CASE event_type WHEN 'click' THEN 'melody' WHEN 'view' THEN 'chord' WHEN 'purchase' THEN 'bass' WHEN 'signup' THEN 'onset' ELSE 'unknown' END AS role FROM events)"""
NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
PITCH = "p AS (SELECT l_orderkey AS set_id, (48 + l_partkey % 36)::INT AS midi FROM lineitem), s AS (SELECT set_id, list_sort(list_distinct(list(midi % 12))) AS pcs, min(midi) % 12 AS low, count(*) AS n FROM p GROUP BY set_id), lw AS (SELECT set_id, midi % 12 AS r, min(midi) AS low_midi FROM p GROUP BY ALL)"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _seconds():
    return F.col("t_us") / F.lit(1e6)


@query(f"WITH {DET}, m AS (SELECT DISTINCT midi FROM det) SELECT midi, round(440.0 * pow(2.0, (midi - 69) / 12.0), 4) AS freq, {NAMES}[midi % 12 + 1] || (midi // 12 - 1)::VARCHAR AS name, round_even(69 + 12 * log2(440.0 * pow(2.0, (midi - 69) / 12.0) / 440.0), 0)::INT AS back FROM m")
def note_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = adapters.detections(spark, sf_dir).select("midi").distinct()
    freq = scalars.midi_to_freq(F.col("midi"))
    return notes.select("midi", F.round(freq, 4).alias("freq"), scalars.note_name(F.col("midi")).alias("name"), scalars.freq_to_midi(freq).alias("back"))


@query(f"WITH {DET}, b AS (SELECT event_id, (t_us / 1e6) / (60.0::DOUBLE / 67.0::DOUBLE) AS beat FROM det), c AS (SELECT event_id, floor(beat / 4)::INT + 1 AS bar, fmod(beat, 4.0::DOUBLE) + 1.0 AS beat FROM b) SELECT event_id, bar, round(beat, 4) AS beat, CASE WHEN beat - floor(beat) > 0.01 THEN printf('%d.%d.%02d', bar, floor(beat)::INT, floor((beat - floor(beat)) * 100)::INT) ELSE printf('%d.%d', bar, floor(beat)::INT) END AS text FROM c")
def bar_beat_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = scalars.time_to_beat(_seconds(), BPM)
    rows = adapters.detections(spark, sf_dir).select("event_id", scalars.bar_of(beat).alias("bar"), scalars.beat_in_bar(beat).alias("beat"))
    return rows.select("event_id", "bar", F.round("beat", 4).alias("beat"), scalars.bar_beat_text(F.col("bar"), F.col("beat")).alias("text"))


@query(f"WITH {DET}, b AS (SELECT event_id, (t_us / 1e6) / (60.0::DOUBLE / 67.0::DOUBLE) AS beat FROM det WHERE role = 'onset'), c AS (SELECT *, round_even(beat / 0.5, 0) * 0.5 AS near FROM b) SELECT event_id, round(CASE WHEN abs(beat - near) <= 0.3 THEN near ELSE beat END, 4) AS snapped, round(abs(beat - near), 4) AS distance, abs(beat - near) <= 0.3 AS on_grid FROM c")
def snapped_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = scalars.time_to_beat(_seconds(), BPM)
    rows = adapters.detections(spark, sf_dir).where("role = 'onset'").select("event_id", beat.alias("beat"), scalars.snapped(beat).alias("near"))
    far = F.abs(F.col("beat") - F.col("near"))
    return rows.select("event_id", F.round(F.when(far <= 0.3, F.col("near")).otherwise(F.col("beat")), 4).alias("snapped"), F.round(far, 4).alias("distance"), (far <= 0.3).alias("on_grid"))


@query(f"""WITH {DET}, b AS (SELECT event_id, (0.1::DOUBLE * (1 + k % 20)) / (60.0::DOUBLE / 67.0::DOUBLE) AS beats FROM det), v AS (SELECT unnest([0.25,0.5,0.75,1.0,1.5,2.0,3.0,4.0,6.0]::DOUBLE[]) AS v),
  n AS (SELECT event_id, beats, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(v - beats), v) AS r FROM b, v)
  SELECT event_id, round(CASE WHEN beats > 6 THEN 6.0 WHEN beats < 0.25 THEN 0.25 WHEN abs(v - beats) / beats < 0.3 THEN v ELSE beats END, 4) AS beats FROM n WHERE r = 1""")
def written_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = (F.lit(0.1) * (F.lit(1) + F.pmod("k", F.lit(20)))) / F.lit(60.0 / BPM)
    return adapters.detections(spark, sf_dir).select("event_id", F.round(scalars.grid_duration(beats), 4).alias("beats"))


@query("WITH s AS (SELECT DISTINCT (40 + p_partkey % 160)::DOUBLE AS bpm FROM part), x AS (SELECT bpm, unnest([bpm, bpm / 2, bpm * 2, bpm / 1.5::DOUBLE, bpm * 1.5::DOUBLE, bpm * 2 / 3, bpm * 3 / 2]) AS v FROM s) SELECT bpm, array_to_string(list_sort(list_distinct(list(round_even(v, 0)::INT) FILTER (v BETWEEN 60 AND 160))), ' ') AS tempi FROM x GROUP BY bpm")
def tempo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpm = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.lit(40) + F.pmod("p_partkey", F.lit(160))).cast("double").alias("bpm")).distinct()
    return bpm.select("bpm", F.array_join(scalars.tempo_octaves(F.col("bpm"), 60, 160).cast("array<string>"), " ").alias("tempi"))


#: Roots are tried from the lowest note up.
OWN = "SELECT * FROM s JOIN lw USING (set_id)"


def _matched(templates: dict[str, list[int]], bonus: dict[str, float], score: str, roots: str) -> str:
    rows = ", ".join(f"({k}, '{q}', {sorted({x % 12 for x in pcs})}, {bonus.get(q, 0.0)}::DOUBLE)" for k, (q, pcs) in enumerate(templates.items()))
    return f"""WITH {PITCH}, t(ord, quality, tp, bonus) AS (VALUES {rows}), r AS ({roots}),
  c AS (SELECT *, list_transform(tp, lambda x: (x + r) % 12) AS here FROM r, t), m AS (SELECT *, len(list_intersect(here, pcs)) AS matched FROM c),
  k AS (SELECT *, {score} AS score FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, low_midi, ord) AS place FROM k) """


_NAME = f"CASE WHEN n >= 2 AND score > 0.3 THEN {NAMES}[r + 1] || CASE quality WHEN 'maj' THEN '' WHEN 'min' THEN 'm' ELSE quality END END AS name, CASE WHEN n >= 2 AND score > 0.3 THEN round(score, 4) END AS score"


@query(_matched(harmony.SHORT_TEMPLATES, harmony.SHORT_BONUS, "CASE WHEN matched >= 2 THEN matched::DOUBLE / len(tp) + CASE WHEN r = low THEN 0.15::DOUBLE ELSE 0 END + bonus ELSE 0 END", OWN) + f"SELECT set_id, {_NAME} FROM b WHERE place = 1")
def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harmony.chord(adapters.pitch_sets(spark, sf_dir), "midis", "c")
    return found.select("set_id", "c.name", F.round("c.score", 4).alias("score"))


@query(_matched(harmony.FULL_TEMPLATES, harmony.FULL_BONUS, """CASE WHEN matched >= 2 THEN greatest(0.0::DOUBLE, matched::DOUBLE / len(tp)
  - (coalesce(list_sum(list_transform(list_filter(tp, lambda x: NOT list_contains(pcs, (x + r) % 12)), lambda x: CASE WHEN x = 7 THEN 10 WHEN x IN (0, 3, 4) THEN 40 ELSE 20 END)), 0)
   + coalesce(list_sum(list_transform(list_filter(pcs, lambda x: NOT list_contains(here, x)), lambda x: CASE WHEN (x - r + 12) % 12 IN (2, 5, 9) THEN 5 ELSE 10 END)), 0))::DOUBLE / 100.0::DOUBLE) + CASE WHEN r = low THEN 0.15::DOUBLE ELSE 0 END + bonus ELSE 0 END""", OWN) + f"SELECT set_id, {_NAME} FROM b WHERE place = 1")
def strict_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harmony.strict_chord(adapters.pitch_sets(spark, sf_dir), "midis", "c")
    return found.select("set_id", "c.name", F.round("c.score", 4).alias("score"))


@query(_matched(harmony.ROOT_TEMPLATES, {}, "(matched * 10 - (len(pcs) - matched) * 3 + CASE WHEN list_contains(pcs, r) THEN 5 ELSE 0 END + CASE WHEN ord < 2 THEN 2 ELSE 0 END)::DOUBLE / 10.0::DOUBLE", "SELECT *, unnest(range(12)) AS r, unnest(range(12)) AS low_midi FROM s") + "SELECT set_id, r::INT AS root, quality AS type, round(score / (len(pcs) + 1), 4) AS confidence FROM b WHERE place = 1")
def chord_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harmony.chord_root(adapters.pitch_sets(spark, sf_dir), "midis")
    return found.select("set_id", "root", "type", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {PITCH}, q AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY midi) AS i FROM p), d AS (SELECT a.set_id, avg((abs(a.midi - b.midi) % 12 IN (1, 2, 6, 10, 11))::INT) AS t FROM q a JOIN q b ON a.set_id = b.set_id AND a.i < b.i GROUP BY a.set_id) SELECT set_id, round(coalesce(t, 0), 4) AS tension FROM s LEFT JOIN d USING (set_id)")
def tensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.pitch_sets(spark, sf_dir).select("set_id", F.round(harmony.tension(F.col("midis")), 4).alias("tension"))


SEGMENTS = """o AS (SELECT DISTINCT track_id, t_us FROM det WHERE role = 'onset'), z AS (SELECT * FROM o UNION ALL SELECT track_id, 0 FROM o GROUP BY track_id HAVING min(t_us) > 100000),
  seg AS (SELECT * FROM (SELECT track_id, t_us AS start_us, coalesce(lead(t_us) OVER (PARTITION BY track_id ORDER BY t_us), 300000000) AS end_us FROM z) WHERE end_us - start_us >= 150000)"""


def _segments(det: DataFrame) -> DataFrame:
    return relational.onset_segments(det.where("role = 'onset'"), SPAN_US, 100_000, 150_000)


@query(f"WITH {DET}, {SEGMENTS} SELECT track_id, start_us, end_us FROM seg")
def onset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(adapters.detections(spark, sf_dir))


CHORDS = f"""w AS (SELECT track_id, start_us, end_us, midi, role, amp * confidence AS weight FROM seg JOIN det USING (track_id) WHERE t_us >= start_us AND t_us < end_us AND role IN ('chord', 'bass')),
  pc AS (SELECT track_id, start_us, midi % 12 AS pc, round(sum(weight), 6) AS weight FROM w WHERE role = 'chord' GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, start_us ORDER BY weight DESC, pc) AS k FROM pc WHERE weight > 0.05) WHERE k <= 4),
  bs AS (SELECT * FROM (SELECT track_id, start_us, midi, row_number() OVER (PARTITION BY track_id, start_us ORDER BY round(sum(weight), 6) DESC, midi) AS k FROM w WHERE role = 'bass' GROUP BY track_id, start_us, midi) WHERE k = 1),
  p AS (SELECT track_id, start_us, 60 + pc AS midi FROM top UNION ALL SELECT track_id, start_us, midi FROM bs),
  s AS (SELECT track_id, start_us, list_sort(list_distinct(list(midi % 12))) AS pcs, min(midi) % 12 AS low, count(*) AS n FROM p GROUP BY ALL),
  t(ord, quality, tp, bonus) AS (VALUES {", ".join(f"({k}, '{q}', {sorted({x % 12 for x in v})}, {harmony.SHORT_BONUS.get(q, 0.0)}::DOUBLE)" for k, (q, v) in enumerate(harmony.SHORT_TEMPLATES.items()))}),
  lw AS (SELECT track_id, start_us, midi % 12 AS r, min(midi) AS low_midi FROM p GROUP BY ALL),
  c AS (SELECT *, len(list_intersect(list_transform(tp, lambda x: (x + r) % 12), pcs)) AS matched FROM (SELECT * FROM s JOIN lw USING (track_id, start_us)), t),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, start_us ORDER BY score DESC, low_midi, ord) AS place FROM (SELECT *, CASE WHEN matched >= 2 THEN matched::DOUBLE / len(tp) + CASE WHEN r = low THEN 0.15::DOUBLE ELSE 0 END + bonus ELSE 0 END AS score FROM c)) WHERE place = 1)"""


@query(f"WITH {DET}, {SEGMENTS}, {CHORDS} SELECT seg.track_id, seg.start_us, seg.end_us, CASE WHEN n >= 2 AND score > 0.3 THEN {NAMES}[r + 1] || CASE quality WHEN 'maj' THEN '' WHEN 'min' THEN 'm' ELSE quality END ELSE 'N.C.' END AS chord, bs.midi AS bass, CASE WHEN n >= 2 AND score > 0.3 THEN round(score, 4) ELSE 0 END AS score FROM seg LEFT JOIN b USING (track_id, start_us) LEFT JOIN bs USING (track_id, start_us)")
def chord_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset segments with the chord of their strongest pitch classes over their strongest bass note."""
    det = adapters.detections(spark, sf_dir)
    segments = _segments(det)
    notes = relational.in_segment(det.where("role in ('chord', 'bass')"), segments)
    weight = F.round(F.sum(F.col("amp") * F.col("confidence")), 6).alias("weight")
    each = notes.groupBy("track_id", "start_us", "role", F.when(F.col("role") == "chord", F.pmod("midi", F.lit(12))).otherwise(F.col("midi")).alias("note")).agg(weight)
    order = F.struct((-F.col("weight")).alias("w"), F.col("note").alias("note"))
    lists = each.groupBy("track_id", "start_us").agg(F.array_sort(F.collect_list(F.when((F.col("role") == "chord") & (F.col("weight") > 0.05), order))).alias("chord"), F.min(F.when(F.col("role") == "bass", order)).alias("bass"))
    top = F.transform(F.slice("chord", 1, 4), lambda x: x["note"] + 60)
    midis = F.when(F.col("bass").isNull(), top).otherwise(F.concat(top, F.array("bass.note")))
    found = harmony.chord(lists.select("track_id", "start_us", midis.alias("midis"), F.col("bass.note").alias("bass")), "midis", "c")
    out = segments.join(found, ["track_id", "start_us"], "left")
    return out.select("track_id", "start_us", "end_us", F.coalesce("c.name", F.lit("N.C.")).alias("chord"), "bass", F.round(F.coalesce("c.score", F.lit(0.0)), 4).alias("score"))


@query(f"WITH {DET} SELECT o.event_id, s.slice_idx FROM det o JOIN (SELECT DISTINCT track_id, slice_idx FROM det WHERE role = 'chord') s ON o.track_id = s.track_id AND s.slice_idx * 100000 >= o.t_us AND s.slice_idx * 100000 < o.t_us + 300000 WHERE o.role = 'melody'")
def sustained_melody(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = adapters.detections(spark, sf_dir)
    return relational.sustained(det.where("role = 'melody'").select("event_id", "track_id", "t_us", "slice_idx"), det.where("role = 'chord'"), 3).select("event_id", "slice_idx")


@query(f"""WITH {DET}, n AS (SELECT track_id, midi, amp, slice_idx // 50 AS s FROM det WHERE role = 'chord'), l AS (SELECT track_id, min(s) AS lo, max(s) AS hi FROM n GROUP BY track_id), x AS (SELECT *, s + unnest([-1, 0, 1]) AS target FROM n),
  v AS (SELECT track_id, target AS slice_idx, midi, count(*) AS votes, max(amp) AS amp, any_value(least(target + 1, hi) - greatest(target - 1, lo) + 1) AS size FROM x JOIN l USING (track_id) WHERE target BETWEEN lo AND hi GROUP BY ALL)
  SELECT track_id, slice_idx, midi, votes, amp FROM v WHERE votes * 2 >= size""")
def smoothed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.majority(_coarse(spark, sf_dir).where("role = 'chord'"), 3)


@query(f"WITH {DET}, g AS (SELECT *, CASE WHEN slice_idx - lag(slice_idx) OVER w > 40 THEN 1 ELSE 0 END AS new FROM det WHERE role = 'melody' WINDOW w AS (PARTITION BY track_id, midi ORDER BY slice_idx, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY track_id, midi ORDER BY slice_idx, event_id) AS run FROM g), c AS (SELECT *, count(*) OVER (PARTITION BY track_id, midi, run) AS n FROM r) SELECT event_id, run::BIGINT AS run FROM c WHERE n >= 2")
def melody_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.isolated_removed(adapters.detections(spark, sf_dir).where("role = 'melody'"), 40, 2).select("event_id", "run")


@query(f"WITH {DET} SELECT event_id FROM det c WHERE role = 'chord' AND NOT EXISTS (SELECT 1 FROM det m WHERE m.role IN ('melody', 'bass') AND m.track_id = c.track_id AND m.slice_idx // 50 = c.slice_idx // 50 AND m.midi = c.midi)")
def chord_only_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = adapters.detections(spark, sf_dir).withColumn("slice_idx", F.expr("slice_idx div 50"))
    return relational.without_pitches_of(det.where("role = 'chord'"), det.where("role in ('melody', 'bass')")).select("event_id")


_COARSE = "SELECT *, slice_idx // 50 AS s FROM det"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.detections(spark, sf_dir).withColumn("slice_idx", F.expr("slice_idx div 50"))


@query(f"WITH {DET}, x AS ({_COARSE}) SELECT event_id, role FROM (SELECT *, row_number() OVER (PARTITION BY track_id, s, midi ORDER BY CASE role WHEN 'melody' THEN 0 WHEN 'chord' THEN 1 WHEN 'bass' THEN 2 ELSE 3 END, event_id) AS place FROM x) WHERE place = 1")
def role_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_role(_coarse(spark, sf_dir)).select("event_id", "role")


@query(f"WITH {DET}, x AS ({_COARSE}), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, s, role ORDER BY CASE role WHEN 'bass' THEN midi::DOUBLE WHEN 'chord' THEN -confidence WHEN 'melody' THEN -midi::DOUBLE ELSE 0 END, event_id) AS place FROM x) SELECT event_id FROM k WHERE role NOT IN ('bass', 'chord', 'melody') OR place <= CASE role WHEN 'bass' THEN 2 WHEN 'chord' THEN 4 ELSE 2 END")
def balanced_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.balanced(_coarse(spark, sf_dir)).select("event_id")


@query(f"""WITH {DET}, x AS (SELECT *, slice_idx // 50 AS s FROM det WHERE role IN ('melody', 'chord', 'bass')), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, s, role ORDER BY CASE role WHEN 'bass' THEN midi::DOUBLE ELSE -confidence END, event_id) AS place,
  sum((role = 'melody')::INT) OVER (PARTITION BY track_id, s) + max((role = 'bass')::INT) OVER (PARTITION BY track_id, s) AS kept FROM x) SELECT event_id FROM k WHERE role = 'melody' OR role = 'bass' AND place = 1 OR role = 'chord' AND place <= least(4, 6 - kept)""")
def thinned_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.thinned(_coarse(spark, sf_dir)).select("event_id")


@query(f"WITH {DET} SELECT role, count(*) AS kept FROM det WHERE confidence >= 0.3::DOUBLE / CASE role WHEN 'melody' THEN 1.0::DOUBLE WHEN 'chord' THEN 1.5::DOUBLE WHEN 'bass' THEN 0.7::DOUBLE WHEN 'unknown' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END GROUP BY role")
def role_weight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.role_weighted(adapters.detections(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("kept"))


@query(f"WITH {DET}, x AS (SELECT track_id, event_id, t_us, midi, lag(midi) OVER (PARTITION BY track_id ORDER BY t_us, event_id) AS b FROM det WHERE role = 'bass') SELECT track_id, event_id, midi FROM x WHERE b IS NULL OR b <> midi")
def bass_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.detections(spark, sf_dir).where("role = 'bass'")
    return relational.changes(rows, "midi", ["t_us", "event_id"]).select("track_id", "event_id", "midi")


@query(f"WITH {DET}, i AS (SELECT track_id, lead(t_us) OVER (PARTITION BY track_id ORDER BY t_us, event_id) - t_us AS d FROM det WHERE role = 'onset') SELECT track_id, least(d // 100000, 99) AS bin, count(*) AS n FROM i WHERE d IS NOT NULL GROUP BY ALL")
def onset_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("track_id").orderBy("t_us", "event_id")
    rows = adapters.detections(spark, sf_dir).where("role = 'onset'").select("track_id", (F.lead("t_us").over(by) - F.col("t_us")).alias("d")).where("d is not null")
    return rows.groupBy("track_id", F.expr("least(d div 100000, 99)").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {DET}, c AS (SELECT role, midi, count(*) AS n, round(sum(amp), 4) AS total_amp, min(t_us) AS first_seen, max(t_us) AS last_seen FROM det GROUP BY ALL) SELECT * FROM c")
def note_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = adapters.detections(spark, sf_dir)
    return det.groupBy("role", "midi").agg(F.count("*").alias("n"), F.round(F.sum("amp"), 4).alias("total_amp"), F.min("t_us").alias("first_seen"), F.max("t_us").alias("last_seen"))


@query(f"WITH {DET}, q AS (SELECT track_id, round_even((t_us / 1e6) / (60.0::DOUBLE / 67.0::DOUBLE) / 0.25, 0) * 0.25 AS beat, midi FROM det WHERE role = 'melody'), g AS (SELECT track_id, beat, array_to_string(list_sort(list_distinct(list(midi))), ' ') AS notes FROM q GROUP BY ALL) SELECT track_id, beat, notes, round(CASE WHEN after IS NULL THEN 1.0 ELSE greatest(0.25, least(4.0, after - beat)) END, 4) AS beats FROM (SELECT *, lead(beat) OVER (PARTITION BY track_id ORDER BY beat) AS after FROM g)")
def quantised_melody(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = scalars.snapped(scalars.time_to_beat(_seconds(), BPM), 0.25)
    rows = adapters.detections(spark, sf_dir).where("role = 'melody'").groupBy("track_id", beat.alias("beat")).agg(F.array_join(F.array_sort(F.collect_set("midi")).cast("array<string>"), " ").alias("notes"))
    gap = F.lead("beat").over(W.partitionBy("track_id").orderBy("beat")) - F.col("beat")
    length = F.when(gap.isNull(), 1.0).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(4.0), gap)))
    return rows.select("track_id", "beat", "notes", F.round(length, 4).alias("beats"))


FRAMES = """f AS (SELECT label AS track_id, vec_id AS frame_idx, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = 64),
  y AS (SELECT track_id, frame_idx, unnest(x) AS x, unnest(range(64)) AS i FROM f), ks AS (SELECT unnest(range(33)) AS k),
  m AS (SELECT track_id, frame_idx, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2)) AS mag FROM y, ks GROUP BY ALL)"""


@query(f"WITH {FRAMES}, h AS (SELECT track_id, frame_idx, sum(mag * (k + 1)) AS hfc FROM m GROUP BY ALL), e AS (SELECT track_id, frame_idx, sum(x * x) AS energy FROM y GROUP BY ALL), d AS (SELECT track_id, frame_idx, greatest(mag - lag(mag) OVER (PARTITION BY track_id, k ORDER BY frame_idx), 0) AS gain FROM m), g AS (SELECT track_id, frame_idx, coalesce(sum(gain), 0) AS flux FROM d GROUP BY ALL) SELECT track_id, frame_idx, round(flux, 3) AS flux, round(hfc, 3) AS hfc, round(energy, 3) AS energy FROM h JOIN e USING (track_id, frame_idx) JOIN g USING (track_id, frame_idx)")
def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.frames(spark, sf_dir).withColumn("mags", signal.magnitudes(F.col("samples")))
    rows = frames.select("track_id", "frame_idx", signal.flux(frames, "mags").alias("flux"), signal.high_content(F.col("mags")).alias("hfc"), signal.energy(F.col("samples")).alias("energy"))
    return rows.select("track_id", "frame_idx", *[F.round(c, 3).alias(c) for c in ("flux", "hfc", "energy")])


@query("WITH f AS (SELECT label AS track_id, vec_id AS frame_idx, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS e FROM embeddings WHERE len(embedding) = 64), d AS (SELECT track_id, frame_idx, greatest(e - coalesce(lag(e) OVER (PARTITION BY track_id ORDER BY frame_idx), e), 0) AS rise FROM f) SELECT track_id, frame_idx, round(CASE WHEN max(rise) OVER (PARTITION BY track_id) > 0 THEN rise / max(rise) OVER (PARTITION BY track_id) ELSE rise END, 4) AS strength FROM d")
def energy_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.frames(spark, sf_dir).withColumn("energy", signal.energy(F.col("samples"))).withColumn("rise", signal.rise("energy"))
    return rows.select("track_id", "frame_idx", F.round(signal.share_of_most("rise"), 4).alias("strength"))


@query(f"""WITH {DET}, b AS (SELECT track_id, t_us // 1000000 AS bin, count(*) AS x FROM det WHERE role = 'onset' GROUP BY ALL), w AS (SELECT track_id, sum(x * x) AS power FROM b GROUP BY ALL),
  m AS (SELECT a.track_id, z.bin - a.bin AS lag, sum(a.x * z.x) AS met FROM b a JOIN b z ON a.track_id = z.track_id AND z.bin > a.bin AND z.bin <= a.bin + 60 GROUP BY ALL),
  r AS (SELECT track_id, lag, met::DOUBLE / power::DOUBLE AS strength, row_number() OVER (PARTITION BY track_id ORDER BY met::DOUBLE / power::DOUBLE DESC, lag) AS k FROM m JOIN w USING (track_id))
  SELECT track_id, lag::INT AS lag, round(strength, 4) AS strength FROM r WHERE k = 1""")
def onset_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets = adapters.detections(spark, sf_dir).where("role = 'onset'")
    return tempo.best_lag(tempo.autocorrelation(onsets, 1_000_000, 60)).select("track_id", "lag", F.round("strength", 4).alias("strength"))


@query(f"""WITH {DET}, o AS (SELECT track_id, t_us FROM det WHERE role = 'onset'), c AS (SELECT DISTINCT track_id, t_us AS place FROM o WHERE t_us < 30000000),
  e AS (SELECT o.track_id, place, ((t_us - place) / 1e6) / (60.0::DOUBLE / 67.0::DOUBLE) AS beat FROM o JOIN c ON o.track_id = c.track_id AND t_us >= place), f AS (SELECT track_id, place, abs(beat - round_even(beat, 0)) AS far FROM e),
  s AS (SELECT track_id, place, round(sum(CASE WHEN far < 0.15::DOUBLE THEN 1 - far ELSE 0 END), 6) AS score FROM f GROUP BY ALL), b AS (SELECT track_id, place FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, place) AS k FROM s) WHERE k = 1)
  SELECT g.track_id, coalesce(place, low) AS downbeat_us FROM (SELECT track_id, min(t_us) AS low FROM o GROUP BY ALL) g LEFT JOIN b USING (track_id)""")
def first_downbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.first_downbeat(adapters.detections(spark, sf_dir).where("role = 'onset'"), BPM, 30_000_000)


@query(f"""WITH {PITCH}, q AS (SELECT set_id, list_sort(list_distinct(list(midi))) AS notes FROM p GROUP BY set_id), w AS (SELECT set_id, notes, unnest(notes) AS s FROM q), x AS (SELECT set_id, notes, s, list_filter(notes, lambda v: v >= s AND v <= s + 10)[1:3] AS win FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY len(win) * 100 - list_sum(win)::DOUBLE / len(win)::DOUBLE DESC, s) AS k FROM x) SELECT set_id, array_to_string(CASE WHEN notes[len(notes)] - notes[1] <= 10 AND len(notes) <= 3 THEN notes ELSE win END, ' ') AS kept FROM r WHERE k = 1""")
def low_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = playability.hand_span(F.col("midis"), 10, 3, "lowest")
    return adapters.pitch_sets(spark, sf_dir).select("set_id", F.array_join(kept.cast("array<string>"), " ").alias("kept"))


_NAMED = f"{NAMES}[midi % 12 + 1] || (midi // 12 - 1)::VARCHAR"


@query(ORACLE_SQL["chord_segments"].replace(" SELECT seg.track_id", ", cs AS (SELECT seg.track_id", 1) + f"""), mm AS (SELECT track_id, start_us, midi, min(t_us) AS low FROM seg JOIN det USING (track_id) WHERE t_us >= start_us AND t_us < end_us AND role = 'melody' GROUP BY ALL),
  mel AS (SELECT track_id, start_us, string_agg({_NAMED}, ' ' ORDER BY low, midi) AS notes FROM mm GROUP BY ALL), ln AS (SELECT *, (start_us / 1e6) / (60.0::DOUBLE / 67.0::DOUBLE) AS beat FROM cs LEFT JOIN mel USING (track_id, start_us))
  SELECT track_id, start_us, printf('%-10s %-8s %-10s %-8s %s', printf('%d.%d', floor(beat / 4)::INT + 1, floor(fmod(beat, 4.0::DOUBLE))::INT + 1), printf('%d.%02d', (start_us + 5000) // 1000000, (start_us + 5000) // 10000 % 100), chord, coalesce({_NAMED.replace("midi", "bass")}, '-'), coalesce(notes, '-')) AS line FROM ln""")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chord segments as lines of text, with the names of the melody notes in each, in order."""
    det, by = adapters.detections(spark, sf_dir), ["track_id", "start_us"]
    notes = relational.in_segment(det.where("role = 'melody'"), _segments(det)).groupBy(*by, "midi").agg(F.min("t_us").alias("low"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("low", "midi"))), lambda x: scalars.note_name(x["midi"]))
    rows = chord_segments(spark, sf_dir).join(notes.groupBy(*by).agg(F.array_join(names, " ").alias("melody")), by, "left")
    beat = scalars.time_to_beat(F.col("start_us") / F.lit(1e6), BPM)
    place = F.format_string("%d.%d", scalars.bar_of(beat), F.floor(scalars.beat_in_bar(beat)).cast("int"))
    return rows.select(*by, documents.segment_line(place, F.col("start_us"), F.col("chord"), scalars.note_name(F.col("bass")), F.col("melody")).alias("line"))
