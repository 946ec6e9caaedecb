"""Queries on note events, beat grids, names and spectra, each with the SQL that gives the same rows.

The SQL says a rule in its own way (pairs, windows, sums of sines), not as the operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import names, scalars
from tessitura.operators import events as ev
from tessitura.operators import grid, harmony, relational, spectra
from tessitura.plans.queries import BPM, DET, NAMES, PITCH, SEGMENTS, SPAN_US
from tessitura.sources import adapters, documents

QUERIES, ORACLE_SQL = {}, {}
BEAT_US = 60e6 / BPM
BEAT = "(60e6::DOUBLE / 67)"
EVENTS = f"""{DET},
  ev AS (SELECT event_id, track_id, midi, role, confidence AS velocity, t_us AS start_us, 100000 * (1 + k % 20) AS dur_us, slice_idx, amp
    FROM det WHERE role <> 'onset')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = adapters.detections(spark, sf_dir).where("role <> 'onset'")
    return det.select("event_id", "track_id", "midi", "role", F.col("confidence").alias("velocity"), F.col("t_us").alias("start_us"), (F.lit(100_000) * (1 + F.pmod("k", F.lit(20)))).cast("long").alias("dur_us"), "slice_idx", "amp")


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.detections(spark, sf_dir).where("role = 'onset'").select("event_id", "track_id", "t_us")


@query(f"""
WITH n AS (SELECT p_partkey AS id, ['C','D','E','F','G','A','B','H','c'][p_partkey % 9 + 1] || ['','#','b','##'][p_partkey // 9 % 4 + 1]
    || (p_partkey // 36 % 11 - 1)::VARCHAR AS name FROM part),
  x AS (SELECT *, regexp_extract(name, '^[A-Za-z#]+') AS note, regexp_extract(name, '-?[0-9]+$')::INT AS octave FROM n),
  y AS (SELECT *, coalesce(list_position({NAMES}, upper(note)), CASE WHEN note[2] = '#' THEN list_position({NAMES}, upper(note[1])) % 12 + 1 END) AS place,
    regexp_full_match(note, '[A-G][#b]?') AS strict,
    MAP {{'C': 0, 'D': 2, 'E': 4, 'F': 5, 'G': 7, 'A': 9, 'B': 11}}[note[1]] + CASE note[2] WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END AS step FROM x)
SELECT id, name, coalesce((octave + 1) * 12 + place - 1, 0)::INT AS sharp_midi, CASE WHEN strict THEN replace(note, 'b', '-') END AS pitch,
  CASE WHEN strict THEN (octave + 1) * 12 + step ELSE 0 END::INT AS midi,
  CASE WHEN strict THEN round(440.0::DOUBLE * pow(2.0, ((octave + 1) * 12 + CASE WHEN note IN ('E#','B#','Cb','Fb') THEN 0 ELSE step END - 69) / 12.0::DOUBLE), 4) ELSE 0 END AS freq
FROM y""")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of notes, good and bad, by each of the readers."""
    p = F.col("p_partkey")
    letter = F.element_at(F.array(*map(F.lit, ["C", "D", "E", "F", "G", "A", "B", "H", "c"])), (p % 9 + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, ["", "#", "b", "##"])), (F.floor(p / 9) % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("id"), F.concat(letter, sign, (F.floor(p / 36) % 11 - 1).cast("string")).alias("name"))
    name = F.col("name")
    return rows.select("id", "name", names.midi_of_sharp_name(name).alias("sharp_midi"), names.pitch_and_octave(name)["pitch"].alias("pitch"), names.midi_of_name(name).alias("midi"), F.round(names.freq_of_name(name), 4).alias("freq"))


@query(f"""WITH {PITCH}, i AS (SELECT p.set_id, (p.midi - m.low_note) % 12 AS step, m.low_note FROM p JOIN (SELECT set_id, min(midi) AS low_note FROM p GROUP BY ALL) m USING (set_id))
SELECT set_id, low_note AS bass, array_to_string(list_sort(list_distinct(list(step))), ' ') AS intervals FROM i GROUP BY ALL""")
def bass_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pitch_sets(spark, sf_dir)
    return rows.select("set_id", F.array_min("midis").alias("bass"), F.array_join(harmony.intervals(F.col("midis")).cast("array<string>"), " ").alias("intervals"))


@query(f"WITH {EVENTS} SELECT event_id, row_number() OVER (PARTITION BY track_id ORDER BY start_us, midi DESC, event_id) AS place, count(*) OVER (PARTITION BY track_id, midi) AS same_pitch FROM ev")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each event in its track, and how often its pitch is there."""
    rows = ev.ordered(_events(spark, sf_dir))
    return rows.select("event_id", "place", F.count("*").over(W.partitionBy("track_id", "midi")).alias("same_pitch"))


@query(f"""WITH {EVENTS}, h AS (SELECT track_id, slice_idx // 10 AS s, 440.0::DOUBLE * pow(2.0, (midi - 69) / 12.0::DOUBLE) AS freq, amp, unnest([2, 3, 4, 5]) AS num FROM ev WHERE role IN ('chord', 'bass')),
  m AS (SELECT *, slice_idx // 10 AS s, 440.0::DOUBLE * pow(2.0, (midi - 69) / 12.0::DOUBLE) AS freq FROM ev WHERE role = 'melody'),
  c AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.track_id = m.track_id AND h.s = m.s AND abs(1200 * log2(m.freq / (h.freq * num))) < 50 AND h.amp / num > m.amp * 1.5::DOUBLE * (1 + num * 0.15::DOUBLE))),
  d AS (SELECT *, row_number() OVER (PARTITION BY track_id, s, round_even(freq / 5, 0) ORDER BY velocity DESC, event_id) AS k FROM c),
  t AS (SELECT *, row_number() OVER (PARTITION BY track_id, s ORDER BY midi DESC, event_id) AS top FROM d WHERE k = 1 AND velocity >= 0.3::DOUBLE)
SELECT event_id FROM t WHERE top <= 2""")
def clean_melody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Melody notes of a second that no harmonic of chord or bass outshines, one for each few Hz, at most the two highest."""
    rows = _events(spark, sf_dir).withColumns({"slice_idx": F.expr("slice_idx div 10"), "freq": scalars.midi_to_freq(F.col("midi")), "confidence": F.col("velocity")})
    harmonics = F.transform(F.array(*map(F.lit, [2, 3, 4, 5])), lambda n: F.struct((F.col("freq") * n).alias("freq"), (F.col("amp") / n).alias("amp"), n.alias("num")))
    others = rows.where("role in ('chord', 'bass')").withColumn("harmonics", harmonics)
    return ev.skyline(ev.artefacts_removed(rows.where("role = 'melody'"), others)).select("event_id")


@query(f"""WITH {EVENTS}, sl AS (SELECT DISTINCT track_id, slice_idx FROM ev), n AS (SELECT e.event_id, count(s.slice_idx) AS total,
    count(s.slice_idx) FILTER (EXISTS (SELECT 1 FROM ev x WHERE x.track_id = s.track_id AND x.slice_idx = s.slice_idx AND x.midi = e.midi AND x.role = e.role)) AS present
  FROM ev e LEFT JOIN sl s ON s.track_id = e.track_id AND s.slice_idx * 100000 >= e.start_us AND s.slice_idx * 100000 < e.start_us + e.dur_us GROUP BY ALL)
SELECT event_id, total, present FROM n JOIN ev USING (event_id) WHERE total = 0 OR (present / total >= 0.4::DOUBLE AND present >= 2)
  OR (role = 'melody' AND present / total >= 0.2::DOUBLE) OR (dur_us / {BEAT} <= 0.5 AND present >= 1)""")
def majority_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that enough of the slices they last over hold."""
    rows = _events(spark, sf_dir)
    return ev.by_majority(ev.present(rows, rows, 100_000), BEAT_US).select("event_id", "total", "present")


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN start_us - lag(start_us + dur_us) OVER w < 0.125::DOUBLE * {BEAT} THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY track_id, midi ORDER BY start_us, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY track_id, midi ORDER BY start_us, event_id) AS run FROM g)
SELECT track_id, midi, arg_min(event_id, start_us * 1000000 + event_id) AS event_id, arg_min(role, start_us * 1000000 + event_id) AS role, min(start_us) AS start_us,
  arg_max(start_us + dur_us, start_us * 1000000 + event_id) - min(start_us) AS dur_us, round(sum(dur_us / {BEAT}), 4) AS beats, max(velocity) AS velocity, count(*) AS parts FROM r GROUP BY track_id, midi, run""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a pitch with hardly a gap between them as one."""
    return ev.merged(_events(spark, sf_dir), BEAT_US).withColumn("beats", F.round("beats", 4))


@query(f"""WITH {EVENTS}, {SEGMENTS}, n AS (SELECT track_id, start_us, end_us, row_number() OVER (PARTITION BY track_id ORDER BY start_us) AS seg_idx FROM seg),
  x AS (SELECT n.track_id, seg_idx, n.start_us, end_us, midi, min(t_us) AS first_us FROM n JOIN det d ON d.track_id = n.track_id AND t_us >= n.start_us AND t_us < end_us WHERE role <> 'onset' GROUP BY ALL)
SELECT track_id, seg_idx, midi, first_us,
  CASE WHEN EXISTS (SELECT 1 FROM x b WHERE b.track_id = x.track_id AND b.midi = x.midi AND b.seg_idx = x.seg_idx - 1) AND first_us - start_us >= (end_us - start_us) * 0.1::DOUBLE THEN 'tied' ELSE 'new' END AS kind,
  (SELECT max(l.end_us) FROM x l WHERE l.track_id = x.track_id AND l.midi = x.midi AND l.seg_idx >= x.seg_idx AND l.seg_idx - x.seg_idx + 1 =
     (SELECT count(*) FROM x c WHERE c.track_id = x.track_id AND c.midi = x.midi AND c.seg_idx BETWEEN x.seg_idx AND l.seg_idx)) AS until_us FROM x""")
def segment_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pitch is struck anew in a segment, and until when it lasts."""
    det = adapters.detections(spark, sf_dir)
    segments = relational.onset_segments(det.where("role = 'onset'"), SPAN_US, 100_000, 150_000)
    return ev.attacks(relational.in_segment(det.where("role <> 'onset'"), segments), segments)


LINES = f"""WITH {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, midi DESC, event_id) AS place, start_us / {BEAT} AS pos FROM ev),
  b AS (SELECT *, floor(pos / 4)::INT + 1 AS bar, fmod(pos, 4.0::DOUBLE) + 1 AS beat, lag(floor(pos / 4)::INT + 1) OVER (PARTITION BY track_id ORDER BY place) AS last FROM o),"""


@query(f"""{LINES} l AS (SELECT track_id, place, bar <> last AND last > 0 AS gap, printf('%-6d %-8.2f %-6.2f %-8s %-8s %.2f', bar, floor(beat * 100 + 0.5) / 100, floor(dur_us / {BEAT} * 100 + 0.5) / 100, {NAMES}[midi % 12 + 1] || (midi // 12 - 1)::VARCHAR, role, floor(velocity * 100 + 0.5) / 100) AS line FROM b)
SELECT track_id, place::INT AS place, 0 AS part, CASE WHEN gap THEN '' ELSE line END AS line FROM l UNION ALL SELECT track_id, place, 1, line FROM l WHERE gap""")
def fused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of text, bars apart."""
    rows = ev.ordered(_events(spark, sf_dir))
    at = F.col("start_us") / F.lit(BEAT_US)
    rows = rows.withColumns({"bar": scalars.bar_of(at), "beat": scalars.beat_in_bar(at), "beats": F.col("dur_us") / F.lit(BEAT_US)})
    return ev.bar_lines(rows, scalars.note_name(F.col("midi")))


@query(f"""WITH {DET}, o AS (SELECT track_id, t_us FROM det WHERE role = 'onset'), g AS (SELECT unnest([53, 61, 67, 79, 101, 113, 131, 151])::DOUBLE AS bpm), f AS (SELECT unnest([0, 250000, 500000])::BIGINT AS first_us),
  x AS (SELECT *, (t_us - first_us) / (60e6::DOUBLE / bpm) AS beat FROM o, g, f), y AS (SELECT *, abs(beat - round_even(beat / 4, 0) * 4) AS far, greatest(1, floor(300 / (240 / bpm)))::INT AS bars FROM x),
  a AS (SELECT track_id, bpm, first_us, bars, avg(CASE WHEN far < 0.3 THEN 1 WHEN far < 0.6 THEN 0.7::DOUBLE WHEN abs(far - 2) < 0.3 THEN 0.5 ELSE 0 END::DOUBLE) AS bar_alignment,
    greatest(0, 1 - 2 * avg(abs(beat - round_even(beat * 2, 0) / 2))) AS beat_alignment FROM y GROUP BY ALL),
  c AS (SELECT track_id, bpm, first_us, count(*) AS covered FROM a, LATERAL (SELECT unnest(range(bars)) AS bar) r WHERE EXISTS (SELECT 1 FROM x WHERE x.track_id = a.track_id AND x.bpm = a.bpm AND x.first_us = a.first_us AND abs(beat - bar * 4) < 0.6) GROUP BY ALL),
  s AS (SELECT track_id, bpm, first_us, bar_alignment, coalesce(covered, 0) / bars AS bar_coverage, beat_alignment,
    greatest(0, 1 - 3 * CASE WHEN bpm < 70 THEN (70 - bpm) / 70 WHEN bpm > 130 THEN (bpm - 130) / 130 ELSE 0 END)::DOUBLE AS bpm_preference FROM a LEFT JOIN c USING (track_id, bpm, first_us)),
  t AS (SELECT *, 0.3::DOUBLE * bar_alignment + 0.2::DOUBLE * bar_coverage + 0.15::DOUBLE * beat_alignment + 0.35::DOUBLE * bpm_preference AS total FROM s)
SELECT track_id, bpm, first_us, round(bar_alignment, 11) AS bar_alignment, round(bar_coverage, 11) AS bar_coverage, round(beat_alignment, 6) AS beat_alignment, round(bpm_preference, 11) AS bpm_preference, round(total, 6) AS total,
  row_number() OVER (PARTITION BY track_id ORDER BY round(total, 9) DESC, bpm, first_us) = 1 AS best FROM t""")
def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 24 beat grids for each track, and which is the best."""
    onsets = _onsets(spark, sf_dir)
    bpm = F.explode(F.array(*[F.lit(float(x)) for x in (53, 61, 67, 79, 101, 113, 131, 151)])).alias("bpm")
    grids = onsets.select("track_id").distinct().select("track_id", bpm).select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 250_000, 500_000)])).alias("first_us"))
    scored = grid.scores(onsets, grids, SPAN_US)
    top = grid.best(scored).select("track_id", "bpm", "first_us", F.lit(True).alias("best"))
    out = scored.join(top, ["track_id", "bpm", "first_us"], "left")
    return out.select("track_id", "bpm", "first_us", *[F.round(c, 6 if c in ("beat_alignment", "total") else 11).alias(c) for c in (*grid.WEIGHTS, "total")], F.coalesce("best", F.lit(False)).alias("best"))


GAPS = f"{DET}, g AS (SELECT * FROM (SELECT track_id, lead(t_us) OVER (PARTITION BY track_id ORDER BY t_us) - t_us AS gap FROM det WHERE role = 'onset') WHERE gap IS NOT NULL)"


@query(f"WITH {GAPS} SELECT track_id, count(*) AS n, round(avg(gap), 3) AS mean, median(gap) AS median, round(stddev_pop(gap), 3) AS deviation FROM g GROUP BY track_id")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gap_us")
    return grid.gaps(_onsets(spark, sf_dir)).groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.avg(g), 3).alias("mean"), F.median(g).alias("median"), F.round(F.stddev_pop(g), 3).alias("deviation"))


HISTOGRAM = f"""WITH {GAPS}, v AS (SELECT * FROM g WHERE gap BETWEEN 300000 AND 1500000), e AS (SELECT track_id, min(gap)::DOUBLE AS a, max(gap)::DOUBLE AS z, count(*) AS valid, median(gap) AS mid FROM v GROUP BY ALL),
  w AS (SELECT track_id, CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi, valid, mid FROM e),
  b AS (SELECT w.track_id, bin, lo, hi, (SELECT count(*) FROM v WHERE v.track_id = w.track_id AND least(floor((gap - lo) * BINS / (hi - lo)), BINS - 1) = bin) AS n FROM w, (SELECT unnest(range(BINS)) AS bin))"""


@query(HISTOGRAM.replace("BINS", "20") + " SELECT track_id, bin::INT AS bin, round(lo + bin * ((hi - lo) / 20), 3) AS low, n FROM b")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = grid.gaps(_onsets(spark, sf_dir)).where("gap_us between 300000 and 1500000")
    return grid.histogram(valid, "gap_us", 20).select("track_id", "bin", F.round("low", 3).alias("low"), "n")


@query(f"WITH {DET} SELECT event_id, round(t_us / {BEAT}, 4) AS beat, round(abs(t_us / {BEAT} - round_even(t_us / {BEAT} / 4, 0) * 4), 4) AS from_bar, round(floor(t_us / {BEAT} / 4) * 4 * {BEAT}, 2) AS bar_us FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_us, event_id) AS place FROM det WHERE role = 'onset') WHERE place % 3 = 1")
def third_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third onset of a track, with its distance from a bar and the start of its own."""
    rows = grid.every(_onsets(spark, sf_dir), 3, ["t_us", "event_id"])
    beat = F.col("t_us") / F.lit(BEAT_US)
    start = grid.bar_start_us(scalars.bar_of(beat), F.lit(BPM), F.lit(0))
    return rows.select("event_id", F.round(beat, 4).alias("beat"), F.round(grid.bar_distance(beat), 4).alias("from_bar"), F.round(start, 2).alias("bar_us"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = 64), f AS (SELECT vec_id, unnest(range(3)) AS frame_idx, x FROM e),
  y AS (SELECT vec_id, frame_idx, unnest(range(32)) AS i, unnest(x[frame_idx * 16 + 1 : frame_idx * 16 + 32]) AS v FROM f), w AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS z FROM y),
  m AS (SELECT vec_id, frame_idx, k, sqrt(pow(sum(z * cos(2 * pi() * k * i / 64)), 2) + pow(sum(z * sin(2 * pi() * k * i / 64)), 2)) AS mag FROM w, (SELECT unnest(range(33)) AS k) GROUP BY ALL)
SELECT vec_id, frame_idx::INT AS frame_idx, round(sum(mag), 3) AS total, round(max(mag), 3) AS most, round(sum(mag * (k + 1)), 3) AS hfc FROM m GROUP BY ALL""")
def windowed_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping frames of each signal under a Hann window, with zeros to twice their length."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) = 64").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = spectra.spectrum(spectra.framed(e, "x", 32, 16).select("vec_id", "frame_idx", "frame"), "frame", "mags", "hann", 2)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    hfc = add(F.transform("mags", lambda m, k: m * (k + 1)))
    return rows.select("vec_id", "frame_idx", F.round(add(F.col("mags")), 3).alias("total"), F.round(F.array_max("mags"), 3).alias("most"), F.round(hfc, 3).alias("hfc"))


@query(f"WITH {EVENTS} SELECT event_id, track_id, midi, role, round_even(velocity, 3) AS velocity, round_even(start_us / 1e6, 3) AS start, round_even(dur_us / 1e6, 3) AS duration, '4/4' AS time_signature FROM ev")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each track as a JSON document, read back."""
    docs = documents.event_documents(_events(spark, sf_dir), BPM)
    return documents.events_of_documents(docs).select("event_id", "track_id", "midi", "role", "velocity", "start", "duration", "time_signature")
