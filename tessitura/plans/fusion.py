"""Queries on the fusion of slices and onsets, each with the SQL that gives the same rows.

The SQL goes through events and chord notes one by one by recursion, and tries every window of a hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import fusion, harmony
from tessitura.plans.queries import BPM, DET, NAMES, SPAN_US
from tessitura.sources import adapters, scores

QUERIES, ORACLE_SQL = {}, {}
BEAT_US = 60e6 / BPM
BEAT = "(60e6::DOUBLE / 67)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


FUSED = f"""WITH RECURSIVE {DET},
  nt AS (SELECT event_id, track_id, slice_idx * 100000 AS t_us, slice_idx, midi, role, confidence FROM det WHERE role IN ('melody', 'chord', 'bass')),
  ons AS (SELECT DISTINCT track_id, t_us FROM det WHERE role = 'onset'), edge AS (SELECT track_id, min(t_us) AS lo, max(t_us) AS hi FROM ons GROUP BY ALL),
  bound AS (SELECT * FROM ons UNION SELECT track_id, 0 FROM edge WHERE lo > 100000 UNION SELECT track_id, {SPAN_US} FROM edge WHERE hi < {SPAN_US - 100_000}),
  piece AS (SELECT track_id, t_us AS start_us, (SELECT min(b.t_us) FROM bound b WHERE b.track_id = a.track_id AND b.t_us > a.t_us) AS end_us FROM bound a),
  part AS (SELECT * FROM piece WHERE end_us - start_us >= 50000 UNION ALL SELECT DISTINCT track_id, 0, {SPAN_US} FROM nt WHERE track_id NOT IN (SELECT track_id FROM edge)),
  seg AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us) AS seg_idx FROM part),
  held AS (SELECT s.track_id, seg_idx, start_us, end_us, midi, role, round(avg(confidence), 9) AS confidence, min(t_us) AS first_us FROM seg s JOIN nt n ON n.track_id = s.track_id AND t_us >= start_us AND t_us < end_us GROUP BY ALL),
  single AS MATERIALIZED (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY track_id, seg_idx, midi ORDER BY list_position(['melody', 'chord', 'bass'], role)) = 1),
  stop AS (SELECT track_id, midi, seg_idx, end_us FROM single x WHERE NOT EXISTS (SELECT 1 FROM single y WHERE y.track_id = x.track_id AND y.midi = x.midi AND y.seg_idx = x.seg_idx + 1)),
  look AS (SELECT o.*, before.end_us AS before_us, p.seg_idx IS NULL OR o.first_us - o.start_us < (o.end_us - o.start_us) * 0.1::DOUBLE AS is_new,
      (SELECT min(s.end_us) FROM stop s WHERE s.track_id = o.track_id AND s.midi = o.midi AND s.seg_idx >= o.seg_idx) - o.start_us AS len
    FROM single o LEFT JOIN single p ON p.track_id = o.track_id AND p.midi = o.midi AND p.seg_idx = o.seg_idx - 1 LEFT JOIN seg before ON before.track_id = o.track_id AND before.seg_idx = o.seg_idx - 1),
  beat AS (SELECT *, round_even(start_us / {BEAT} / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS place, list_sort([{{'far': abs(v - len / {BEAT}), 'v': v}} FOR v IN [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]::DOUBLE[]])[1].v AS beats FROM look),
  row AS MATERIALIZED (SELECT *, round_even(place * {BEAT}, 0)::BIGINT AS at_us, round_even(beats * {BEAT}, 0)::BIGINT AS dur_us, row_number() OVER (PARTITION BY track_id, midi ORDER BY seg_idx) AS n FROM beat),
  fold AS (SELECT DISTINCT track_id, midi, 0::BIGINT AS n, NULL::BIGINT AS last_us, false AS begins FROM row
    UNION ALL SELECT r.track_id, r.midi, r.n, CASE WHEN ok THEN at_us + dur_us ELSE last_us END, ok
    FROM (SELECT r.*, f.last_us, confidence >= 0.3::DOUBLE AND (is_new OR last_us IS NULL OR last_us <= before_us) AS ok FROM fold f JOIN row r ON r.track_id = f.track_id AND r.midi = f.midi AND r.n = f.n + 1) r),
  fused AS MATERIALIZED (SELECT (4096 - midi) * 4294967296 + seg_idx AS event_id, track_id, midi, role, least(1, confidence) AS velocity, at_us AS start_us, dur_us, beats, floor(place / 4)::INT + 1 AS bar, fmod(place, 4.0::DOUBLE) + 1 AS beat, NOT is_new AS is_tied
    FROM row JOIN fold USING (track_id, midi, n) WHERE begins)"""
EVENT = "event_id, track_id, midi, role, round(velocity, 6) AS velocity, start_us, dur_us, beats, bar, beat, is_tied"


def hands(source: str, order: str) -> str:
    """Tables of events of ``source`` in each hand."""
    return f"""
  low AS (SELECT *, midi < 60 OR role = 'bass' AS is_low, max(CASE WHEN midi < 60 OR role = 'bass' THEN midi END) OVER (PARTITION BY track_id, start_us) AS top FROM {source}),
  hand AS (SELECT *, NOT is_low AND top IS NOT NULL AND midi - top <= 12 AND midi < 72 AS moved, CASE WHEN is_low OR top IS NOT NULL AND midi - top <= 12 AND midi < 72 THEN 'left' ELSE 'right' END AS hand FROM low),
  keys AS (SELECT track_id, start_us, hand, list_sort(list_distinct(list(midi))) AS notes FROM hand GROUP BY ALL),
  reach AS (SELECT *, unnest([{{'s': s, 'w': [v FOR v IN notes IF v >= s AND v <= s + 10]}} FOR s IN notes], recursive := true) FROM keys),
  cut AS (SELECT *, CASE WHEN len(w) <= 5 THEN w WHEN hand = 'left' THEN w[1:5] ELSE list_sort([w[1], w[-1]] || [w[j + 2] FOR j IN range(len(w) - 2) IF j % greatest(1, (len(w) - 2) // 4) = 0][1:3]) END AS few FROM reach),
  play AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY track_id, start_us, hand ORDER BY len(few) * 100 + CASE WHEN hand = 'left' THEN -list_sum(few) / len(few)::DOUBLE ELSE 50 * list_contains(few, notes[1])::INT + 30 * list_contains(few, notes[-1])::INT END DESC, s) = 1),
  handed AS MATERIALIZED (SELECT h.* FROM hand h JOIN play USING (track_id, start_us, hand) WHERE list_contains(CASE WHEN len(notes) <= 1 OR notes[-1] - notes[1] <= 10 AND len(notes) <= 5 THEN notes ELSE few END, midi)
    QUALIFY row_number() OVER (PARTITION BY track_id, start_us, hand, midi ORDER BY moved, {order}) = 1)"""


ROOTS = ", ".join(f"({k}, '{q}', {sorted({p % 12 for p in pcs})})" for k, (q, pcs) in enumerate(harmony.ROOT_TEMPLATES.items()))


def smoothed(source: str) -> str:
    """Tables of what harmony leaves of the events of ``source``."""
    return f"""
  grouped AS MATERIALIZED (SELECT *, floor(beat - 1)::INT AS quarter FROM {source}),
  told AS (SELECT track_id, bar, quarter, list_distinct(list(midi % 12)) AS pcs FROM grouped WHERE role IN ('chord', 'bass') GROUP BY ALL HAVING count(*) >= 3),
  tried AS (SELECT track_id, bar, quarter, r, ord, quality, tp, 10 * len([p FOR p IN pcs IF list_contains(tp, (p - r + 12) % 12)]) - 3 * len([p FOR p IN pcs IF NOT list_contains(tp, (p - r + 12) % 12)]) + 5 * list_contains(pcs, r)::INT + 2 * (ord < 2)::INT AS fit
    FROM told, (SELECT unnest(range(12)) AS r), (VALUES {ROOTS}) t(ord, quality, tp)),
  root AS (SELECT * FROM tried WHERE fit > 0 QUALIFY row_number() OVER (PARTITION BY track_id, bar, quarter ORDER BY fit DESC, r, ord) = 1),
  fit AS (SELECT g.* FROM grouped g LEFT JOIN root USING (track_id, bar, quarter) WHERE role = 'chord' AND beats >= 0.25 AND (r IS NULL OR (midi - r) % 12 IN (2, 5, 9) OR len([p FOR p IN tp IF least((midi - r - p + 24) % 12, (p - midi + r + 120) % 12) <= 2]) > 0)),
  queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id, bar, quarter ORDER BY start_us, event_id) AS n FROM fit),
  chosen AS (SELECT DISTINCT track_id, bar, quarter, 0::BIGINT AS n, []::INT[] AS kept, 0 AS clash, NULL::BIGINT AS event_id FROM queue
    UNION ALL SELECT track_id, bar, quarter, n, CASE WHEN calm THEN list_append(kept, midi) ELSE kept END, CASE WHEN calm THEN more ELSE clash END, CASE WHEN calm THEN event_id END
    FROM (SELECT *, CASE WHEN len(kept) = 0 THEN true ELSE more::DOUBLE / (len(kept) * (len(kept) + 1) / 2)::DOUBLE < 0.5::DOUBLE END AS calm FROM
      (SELECT q.*, c.kept, c.clash, c.clash + len([k FOR k IN c.kept IF abs(k - q.midi) % 12 IN (1, 2, 6, 10, 11)]) AS more FROM chosen c JOIN queue q ON q.track_id = c.track_id AND q.bar = c.bar AND q.quarter = c.quarter AND q.n = c.n + 1))),
  stays AS (SELECT g.* FROM grouped g WHERE role = 'melody' AND beats >= 0.25 UNION ALL SELECT g.* FROM grouped g SEMI JOIN (SELECT track_id, event_id FROM chosen WHERE event_id IS NOT NULL) USING (track_id, event_id)
    UNION ALL (SELECT * FROM grouped WHERE role = 'bass' QUALIFY row_number() OVER (PARTITION BY track_id, bar, quarter ORDER BY midi, velocity DESC, start_us, event_id) <= 2)),
  smooth AS MATERIALIZED (SELECT * FROM stays QUALIFY count(*) OVER (PARTITION BY track_id, midi) > 1 OR beats >= 0.5 OR role = 'melody')"""


VOTED = f"""
  there AS (SELECT DISTINCT track_id, slice_idx FROM nt), vote AS (SELECT e.track_id, e.event_id, count(s.slice_idx) AS total, count(s.slice_idx) FILTER (EXISTS (SELECT 1 FROM nt x WHERE x.track_id = s.track_id AND x.slice_idx = s.slice_idx AND x.midi = e.midi AND x.role = e.role)) AS present
    FROM fused e LEFT JOIN there s ON s.track_id = e.track_id AND s.slice_idx * 100000 >= start_us AND s.slice_idx * 100000 < start_us + dur_us GROUP BY ALL),
  voted AS (SELECT f.* FROM fused f JOIN vote USING (track_id, event_id) WHERE total = 0 OR present / total >= 0.4::DOUBLE AND present >= 2 OR role = 'melody' AND present / total >= 0.2::DOUBLE OR dur_us / {BEAT} <= 0.5 AND present >= 1),
  even AS (SELECT * FROM voted QUALIFY row_number() OVER (PARTITION BY track_id, start_us, role ORDER BY CASE role WHEN 'bass' THEN midi::DOUBLE WHEN 'chord' THEN -velocity ELSE -midi END, event_id) <= CASE role WHEN 'chord' THEN 4 ELSE 2 END)"""
THIN = """
  thin AS (SELECT *, row_number() OVER (PARTITION BY track_id, start_us, role ORDER BY CASE WHEN role = 'bass' THEN midi::DOUBLE ELSE -velocity END, event_id) AS place,
    count(*) FILTER (role = 'melody') OVER (PARTITION BY track_id, start_us) + (count(*) FILTER (role = 'bass') OVER (PARTITION BY track_id, start_us) > 0)::INT AS before FROM smooth)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    det = adapters.detections(spark, sf_dir)
    notes = det.where("role in ('melody', 'chord', 'bass')").withColumn("t_us", F.col("slice_idx") * adapters.SLICE_US)
    return notes, det.where("role = 'onset'").select("track_id", "t_us")


def _shown(events: DataFrame) -> DataFrame:
    return events.select("event_id", "track_id", "midi", "role", F.round("velocity", 6).alias("velocity"), "start_us", "dur_us", "beats", "bar", "beat", "is_tied")


@query(f"{FUSED} SELECT {EVENT} FROM fused")
def fused_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note events from the notes of slices between onsets."""
    return _shown(fusion.fused(*_inputs(spark, sf_dir), SPAN_US, BEAT_US))


@query(f"{FUSED}, {hands('fused', 'event_id')} SELECT track_id, event_id, hand FROM handed")
def two_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two hands can play of these events."""
    return fusion.two_hands(fusion.fused(*_inputs(spark, sf_dir), SPAN_US, BEAT_US)).select("track_id", "event_id", "hand")


@query(f"{FUSED}, {smoothed('fused')} SELECT {EVENT} FROM smooth")
def harmonised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What agrees with the harmony of its beat."""
    return _shown(fusion.smoothed_by_harmony(fusion.fused(*_inputs(spark, sf_dir), SPAN_US, BEAT_US)))


@query(f"""{FUSED}, {VOTED}, {hands('even', "list_position(['bass', 'chord', 'melody'], role), event_id")}, {smoothed('handed')}, {THIN}
  SELECT {EVENT} FROM thin WHERE role = 'melody' OR role = 'bass' AND place = 1 OR role = 'chord' AND place <= least(4, 8 - before)""")
def fused_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job from slices and onsets to what is played."""
    return _shown(fusion.score(*_inputs(spark, sf_dir), SPAN_US, adapters.SLICE_US, BEAT_US))


def _songs(events: DataFrame) -> DataFrame:
    track = F.concat(F.lit("track "), F.col("track_id").cast("string")).alias("source_file")
    return events.select("track_id").distinct().select("track_id", track, F.lit(SPAN_US).alias("duration_us"), F.lit(BPM).alias("bpm"), F.lit("4/4").alias("time_signature"), F.lit(0).cast("long").alias("first_us"))


@query(f"""{FUSED}, t AS (SELECT track_id, max(bar) AS num_bars, count(*) AS num_notes FROM fused GROUP BY ALL)
SELECT f.track_id, 'track ' || f.track_id AS source_file, 300.0::DOUBLE AS duration_seconds, 67.0::DOUBLE AS bpm, num_bars, num_notes, (row_number() OVER (PARTITION BY f.track_id ORDER BY start_us, midi DESC, event_id) - 1)::INT AS place, midi, bar, beat, beats AS duration_beats,
  (v // 10000000 + (v % 10000000 > 5000000 OR v % 10000000 = 5000000 AND v // 10000000 % 2 = 1)::INT) / 100 AS velocity, role, is_tied, (round_even(start_us / 1e6, 4) * 1e6)::BIGINT AS start_us, (round_even(dur_us / 1e6, 4) * 1e6)::BIGINT AS dur_us FROM (SELECT *, round(velocity * 1e9)::BIGINT AS v FROM fused) f JOIN t USING (track_id)""")
def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused events of each track as a JSON document, read back with all their fields."""
    events = fusion.fused(*_inputs(spark, sf_dir), SPAN_US, BEAT_US)
    rows = scores.note_rows(scores.read_documents(scores.documents(events, _songs(events))))
    return rows.select("track_id", "source_file", "duration_seconds", "bpm", "num_bars", "num_notes", "place", "midi", "bar", "beat", "duration_beats", "velocity", "role", "is_tied", "start_us", "dur_us")


@query(f"""{FUSED}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, midi DESC, event_id) AS place, max(bar) OVER (PARTITION BY track_id) AS bars, count(*) OVER (PARTITION BY track_id) AS n FROM fused),
  l AS (SELECT *, bar <> lag(bar) OVER (PARTITION BY track_id ORDER BY place) AS apart, printf('%-6d %-8.2f %-6.2f %-8s %-8s %.2f', bar, floor(beat * 100 + 0.5) / 100, floor(beats * 100 + 0.5) / 100, {NAMES}[midi % 12 + 1] || (midi // 12 - 1)::VARCHAR, role, floor(velocity * 100 + 0.5) / 100) || CASE WHEN is_tied THEN ' (tie)' ELSE '' END AS line FROM o),
  h AS (SELECT DISTINCT track_id, ['# Fused Transcription: track ' || track_id, '# Duration: 300.00s', '# BPM: 67', '# Time Signature: 4/4', '# Total Bars: ' || bars, '# Total Notes: ' || n, '', 'Bar    Beat     Dur    Note     Role     Vel', repeat('-', 50)] AS head FROM o)
SELECT track_id, 0::BIGINT AS place, unnest(range(9))::INT AS part, unnest(head) AS line FROM h UNION ALL SELECT track_id, place, 0, CASE WHEN apart THEN '' ELSE line END FROM l UNION ALL SELECT track_id, place, 1, line FROM l WHERE apart""")
def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused events of each track as text with its header, bars apart."""
    events = fusion.fused(*_inputs(spark, sf_dir), SPAN_US, BEAT_US)
    return scores.text_lines(events, _songs(events))
