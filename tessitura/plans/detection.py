"""Queries on onsets, peaks and notes of frames, each with the SQL that gives the same rows.

The SQL sums sines, looks for the next higher value by search, and goes through peaks and candidates by recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import detection, spectra, timeline
from tessitura.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def magnitudes(window: str, size: int) -> str:
    """Table mg (vec_id, k, mag) of frames of 64 samples under a window, transformed with zeros up to ``size``."""
    return f"""x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64), w AS (SELECT vec_id, i, v * ({window}) AS v FROM x),
  mg AS MATERIALIZED (SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / {size})), 2) + pow(sum(v * sin(2 * pi() * k * i / {size})), 2)) AS mag FROM w, (SELECT unnest(range({size // 2 + 1})) AS k) GROUP BY ALL)"""


def peaks(curve: str, key: str, height: str, distance: int, prominence: float) -> str:
    """Table peak (key, k, x) of a table (key, k, x)."""
    return f"""
  beside AS (SELECT *, lag(x) OVER (PARTITION BY {key} ORDER BY k) AS before, lead(x) OVER (PARTITION BY {key} ORDER BY k) AS after FROM {curve}),
  top AS MATERIALIZED (SELECT {key}, k, x, row_number() OVER (PARTITION BY {key} ORDER BY x DESC, k DESC) AS n FROM beside WHERE x > before AND x > after AND x >= {height}),
  apart AS (SELECT DISTINCT {key}, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS stays FROM top
    UNION ALL SELECT a.{key}, t.n, CASE WHEN len([q FOR q IN kept IF abs(q - t.k) < {distance}]) = 0 THEN list_append(kept, t.k) ELSE kept END, len([q FOR q IN kept IF abs(q - t.k) < {distance}]) = 0 FROM apart a JOIN top t ON t.{key} = a.{key} AND t.n = a.n + 1),
  stay AS (SELECT t.* FROM top t JOIN apart USING ({key}, n) WHERE stays),
  reach AS (SELECT s.*, (SELECT max(k) FROM {curve} c WHERE c.{key} = s.{key} AND c.k < s.k AND c.x > s.x) AS lo, (SELECT min(k) FROM {curve} c WHERE c.{key} = s.{key} AND c.k > s.k AND c.x > s.x) AS hi FROM stay s),
  peak AS MATERIALIZED (SELECT {key}, k, x FROM reach r WHERE x - greatest((SELECT min(x) FROM {curve} c WHERE c.{key} = r.{key} AND c.k < r.k AND c.k > coalesce(lo, -1)), (SELECT min(x) FROM {curve} c WHERE c.{key} = r.{key} AND c.k > r.k AND c.k < coalesce(hi, 1e15))) >= {prominence}::DOUBLE)"""


def in_band(low: int, high: int) -> str:
    """Table band (vec_id, k, x): magnitudes over the band's greatest."""
    return f"band AS MATERIALIZED (SELECT vec_id, k, mag / max(mag) OVER (PARTITION BY vec_id) AS x FROM mg WHERE k >= {low} AND k < {high} QUALIFY max(mag) OVER (PARTITION BY vec_id) > 0)"


@query(f"""WITH RECURSIVE {magnitudes('1', 64)}, {in_band(1, 32)}, {peaks('band', 'vec_id', '0.02::DOUBLE', 3, 0.01)},
  best AS (SELECT * FROM peak QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) <= 20)
SELECT label AS track_id, vec_id AS frame_idx, array_to_string(coalesce((SELECT list(k ORDER BY x DESC, k) FROM best b WHERE b.vec_id = e.vec_id), []), ' ') AS peaks FROM embeddings e WHERE len(embedding) = 64""")
def frame_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of the strongest peaks of each signal's spectrum."""
    rows = spectra.spectrum(adapters.frames(spark, sf_dir), "samples", "mags")
    found = spectra.spectral_peaks(rows, "mags", 1, 32)
    return found.select("track_id", "frame_idx", F.array_join(F.transform("peaks", lambda p: p.cast("int").cast("string")), " ").alias("peaks"))


@query(f"""WITH RECURSIVE {magnitudes('0.5 - 0.5 * cos(2 * pi() * i / 64)', 128)}, {in_band(2, 48)}, {peaks('band', 'vec_id', '0.02::DOUBLE', 3, 0.01)},
  tone AS MATERIALIZED (SELECT p.vec_id, k * 62.5::DOUBLE AS hz, mag AS amp FROM peak p JOIN mg USING (vec_id, k) QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY x DESC, k) <= 20),
  tried AS (SELECT DISTINCT vec_id, hz / d AS f FROM tone, (SELECT unnest([1, 2, 3, 4, 5]::DOUBLE[]) AS d) WHERE d = 1 OR hz / d >= 100),
  met AS MATERIALIZED (SELECT t.vec_id, f, hz, amp, round_even(hz / f, 0)::INT AS n FROM tried t JOIN tone USING (vec_id) WHERE round_even(hz / f, 0) BETWEEN 1 AND 8 AND abs(hz / f - round_even(hz / f, 0)) / round_even(hz / f, 0) < 0.03::DOUBLE),
  sieve AS (SELECT vec_id, f, list(hz) AS of, list_distinct(list(n)) AS ns, sum(amp) AS energy, sum(amp / n) * CASE WHEN min(n) = 1 THEN 1.2::DOUBLE ELSE 1 END AS base, count(*) FILTER (n > 1) AS harmonics, arg_max(hz, amp) FILTER (n = 1) AS own, max(amp) FILTER (n = 1) AS own_amp FROM met GROUP BY ALL),
  rated AS (SELECT *, round(base * (1 + 0.1::DOUBLE * len([n FOR n IN ns IF list_contains(ns, n + 1)])), 9) AS score FROM sieve),
  queue AS MATERIALIZED (SELECT *, score / max(score) OVER (PARTITION BY vec_id) AS sure, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, f) AS place FROM rated),
  claim AS (SELECT DISTINCT vec_id, 0::BIGINT AS place, []::DOUBLE[] AS used, 0 AS taken, false AS stays FROM queue
    UNION ALL SELECT vec_id, place, CASE WHEN ok THEN list_concat(used, of) ELSE used END, taken + ok::INT, ok FROM
      (SELECT q.*, used, taken, taken < 6 AND sure >= 0.2::DOUBLE AND len([h FOR h IN of IF list_contains(used, h)]) <= len(of) * 0.5::DOUBLE AS ok FROM claim c JOIN queue q ON q.vec_id = c.vec_id AND q.place = c.place + 1))
SELECT vec_id, round_even(69 + 12 * log2(f / 440::DOUBLE), 0)::INT AS midi, round(coalesce(own, f), 6) AS freq, round(coalesce(own_amp, energy / 3), 6) AS amp, round(energy, 6) AS energy, round(sure, 6) AS confidence, harmonics::INT AS harmonics FROM claim JOIN queue USING (vec_id, place) WHERE stays""")
def detected_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each signal, as if of 8 kHz, by a sieve of harmonics."""
    rows = spectra.spectrum(adapters.frames(spark, sf_dir), "samples", "mags", "hann", 2).select(F.col("frame_idx").alias("vec_id"), "mags")
    notes = detection.note_rows(detection.detected_notes(rows, "mags", 8000.0, 100.0, 3000.0), "chord")
    return notes.select("vec_id", "midi", *[F.round(c, 6).alias(c) for c in ("freq", "amp", "energy", "confidence")], F.size("harmonics").alias("harmonics"))


CURVE = f"""{magnitudes('0.5 - 0.5 * cos(2 * pi() * i / 63)', 64)},
  place AS (SELECT vec_id, label AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE len(embedding) = 64),
  e AS (SELECT vec_id, sum(x.v * x.v) AS energy, sum(w.v * w.v) AS windowed FROM x JOIN w USING (vec_id, i) GROUP BY ALL), h AS (SELECT vec_id, sum(mag * (k + 1)) AS hfc FROM mg GROUP BY ALL),
  f AS MATERIALIZED (SELECT * FROM place JOIN e USING (vec_id) JOIN h USING (vec_id)),
  gain AS (SELECT n.track_id, n.k, sum(greatest(a.mag - b.mag, 0)) AS flux FROM place n JOIN place o ON o.track_id = n.track_id AND o.k = n.k - 1 JOIN mg a ON a.vec_id = n.vec_id JOIN mg b ON b.vec_id = o.vec_id AND b.k = a.k GROUP BY ALL),
  rise AS MATERIALIZED (SELECT n.track_id, n.k, coalesce(flux, 0) AS flux, greatest(coalesce(n.energy - o.energy, 0), 0) AS energy, greatest(coalesce(n.windowed - o.windowed, 0), 0) AS windowed, greatest(coalesce(n.hfc - o.hfc, 0), 0) AS hfc
    FROM f n LEFT JOIN f o ON o.track_id = n.track_id AND o.k = n.k - 1 LEFT JOIN gain g ON g.track_id = n.track_id AND g.k = n.k),
  share AS (SELECT track_id, k, flux / max(flux) OVER t AS flux, energy / max(energy) OVER t AS energy, windowed / max(windowed) OVER t AS windowed, hfc / max(hfc) OVER t AS hfc FROM rise WINDOW t AS (PARTITION BY track_id)),
  curve AS MATERIALIZED (SELECT track_id, k, 0.4::DOUBLE * flux + 0.3::DOUBLE * energy + 0.3::DOUBLE * hfc AS x FROM share)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 64 samples as the frames of a track for each label, counted from 1."""
    rows = adapters.frames(spark, sf_dir).withColumnRenamed("frame_idx", "vec_id")
    return timeline.numbered(rows, ["vec_id"], "frame_idx", 10_000)


@query(f"WITH {CURVE} SELECT track_id, k AS frame_idx, round(0.6::DOUBLE * flux + 0.4::DOUBLE * windowed, 6) AS strength FROM share")
def onset_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which tempo is told."""
    return detection.onset_envelope(_numbered(spark, sf_dir), "samples").select("track_id", "frame_idx", F.round("strength", 6).alias("strength"))


@query(f"""WITH RECURSIVE {CURVE}, high AS (SELECT track_id, avg(x) + 0.1::DOUBLE * stddev_pop(x) AS high, max(x) AS most FROM curve GROUP BY ALL), tall AS MATERIALIZED (SELECT * FROM curve JOIN high USING (track_id)),
  {peaks('tall', 'track_id', 'high', 3, 0.01)} SELECT track_id, k AS frame_idx, round_even(k * 4000, 0)::BIGINT AS t_us, round(x / most, 6) AS strength FROM peak JOIN high USING (track_id)""")
def detected_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where something begins, of frames 32 samples apart at 8 kHz."""
    found = detection.onsets(_numbered(spark, sf_dir), "samples", 8000.0, 32, gap_ms=12.0)
    return found.select("track_id", "frame_idx", "t_us", F.round("strength", 6).alias("strength"))


TONES = f"""WITH RECURSIVE {magnitudes('0.5 - 0.5 * cos(2 * pi() * i / 64)', 128)}, band AS MATERIALIZED (SELECT vec_id, k, x FROM (SELECT vec_id, k, mag / max(mag) OVER (PARTITION BY vec_id) AS x FROM mg) WHERE k >= 2 AND k < 48), {peaks('band', 'vec_id', '0.02::DOUBLE', 3, 0.01)},
  low AS MATERIALIZED (SELECT p.vec_id, k, k * 62.5::DOUBLE AS hz, mag AS amp, row_number() OVER (PARTITION BY p.vec_id ORDER BY k) AS n FROM peak p JOIN mg USING (vec_id, k)),
  claim AS (SELECT DISTINCT vec_id, 0::BIGINT AS n, []::DOUBLE[] AS roots, 0::DOUBLE AS root FROM low
    UNION ALL SELECT vec_id, n, CASE WHEN root = 0 AND len(roots) < 4 THEN list_append(roots, hz) ELSE roots END, CASE WHEN root = 0 AND len(roots) < 4 THEN hz WHEN root = 0 THEN -1 ELSE root END FROM
      (SELECT l.vec_id, l.n, hz, roots, coalesce([f FOR f IN roots IF round_even(hz / f, 0) >= 2 AND abs(hz / f - round_even(hz / f, 0)) / round_even(hz / f, 0) < 0.03::DOUBLE][1], 0) AS root FROM claim c JOIN low l ON l.vec_id = c.vec_id AND l.n = c.n + 1)),
  tone AS (SELECT vec_id, root AS freq, max(amp) FILTER (hz = root) AS amp, count(*) - 1 AS harmonics FROM claim JOIN low USING (vec_id, n) WHERE root > 0 GROUP BY ALL)"""


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra.spectrum(adapters.frames(spark, sf_dir), "samples", "mags", "hann", 2).select(F.col("frame_idx").alias("vec_id"), "mags")
    return detection.tones(rows, "mags", 8000.0, 100.0, 3000.0, most=4)


@query(f"{TONES} SELECT vec_id, freq, round(amp, 6) AS amp, round_even(69 + 12 * log2(freq / 440::DOUBLE), 0)::INT AS midi, harmonics::INT AS harmonics FROM tone")
def claimed_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones of each signal, from the lowest on, and how many harmonics they claim."""
    rows = _tones(spark, sf_dir).select("vec_id", F.explode("tones").alias("t"))
    return rows.select("vec_id", "t.freq", F.round("t.amp", 6).alias("amp"), "t.midi", F.size("t.harmonics").alias("harmonics"))


@query(f"""{TONES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY harmonics * 2 + amp DESC, freq) - 1 AS place FROM tone)
SELECT vec_id, place::INT AS place, coalesce(freq, 0) AS freq, round(coalesce(amp, 0), 6) AS amp FROM (SELECT vec_id, unnest(range(4)) AS place FROM embeddings WHERE len(embedding) = 64) LEFT JOIN r USING (vec_id, place)""")
def dominant_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tones of each signal, filled with zeros."""
    rows = _tones(spark, sf_dir).select("vec_id", F.posexplode(detection.dominant(F.col("tones"), 4)).alias("place", "t"))
    return rows.select("vec_id", "place", "t.freq", F.round("t.amp", 6).alias("amp"))
