"""Queries on tempo and the search for a beat grid, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import alignment, detection, fusion, grid, tempo
from tessitura.plans.detection import CURVE, _numbered, peaks
from tessitura.plans.fusion import BEAT_US, FUSED, _inputs
from tessitura.plans.music import HISTOGRAM
from tessitura.plans.queries import DET, SPAN_US
from tessitura.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


TEMPI = HISTOGRAM.replace("WITH ", "WITH RECURSIVE ", 1).replace("BINS", "100").replace("a - 0.5", "a - 500000").replace("z + 0.5", "z + 500000") + """,
  pk AS (SELECT * FROM (SELECT *, lag(n) OVER (PARTITION BY track_id ORDER BY bin) AS before, lead(n) OVER (PARTITION BY track_id ORDER BY bin) AS after FROM b) WHERE n > before AND n > after AND n > 2),
  q AS (SELECT track_id, 60e6 / (lo + bin * ((hi - lo) / 100) + (hi - lo) / 100 / 2) AS bpm, n FROM pk), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, bpm DESC) AS k FROM q QUALIFY k <= 5),
  c AS (SELECT track_id, count(*) AS onsets FROM det WHERE role = 'onset' GROUP BY ALL),
  likely AS (SELECT track_id, coalesce(bpm, 60e6 / mid) AS bpm, coalesce(n, 1) AS n, coalesce(k, 1) AS k FROM w LEFT JOIN r USING (track_id) WHERE valid >= 3),
  u AS (SELECT track_id, bpm, n, k, 0 AS j FROM likely UNION ALL SELECT track_id, bpm / 2, n, k, 1 FROM likely WHERE bpm / 2 >= 40 UNION ALL SELECT track_id, bpm * 2, n, k, 2 FROM likely WHERE bpm * 2 <= 200
    UNION ALL SELECT track_id, unnest(CASE WHEN onsets < 3 THEN [120.0::DOUBLE] ELSE [120.0::DOUBLE, 90, 100] END), 0, 1, unnest(range(CASE WHEN onsets < 3 THEN 1 ELSE 3 END)) FROM c LEFT JOIN w USING (track_id) WHERE coalesce(valid, 0) < 3),
  once AS (SELECT track_id, bpm, max(n) AS n, min(k * 10 + j) AS spot FROM u GROUP BY ALL), tempi AS (SELECT track_id, bpm, n, row_number() OVER (PARTITION BY track_id ORDER BY spot) AS place FROM once)"""


@query(f"{TEMPI} SELECT track_id, round(bpm, 4) AS bpm, n::BIGINT AS n, place::INT AS place FROM tempi")
def interval_tempi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest tempi by the intervals between onsets."""
    onsets = adapters.detections(spark, sf_dir).where("role = 'onset'")
    return grid.interval_tempi(onsets).select("track_id", F.round("bpm", 4).alias("bpm"), "n", "place")


def scored(grids: str, onsets: str, into: str) -> str:
    """Table ``into`` of the best grid of each track."""
    return f"""
  {into}_x AS (SELECT *, abs(beat - round_even(beat / 4, 0) * 4) AS far, round_even(beat / 4, 0) AS bar, greatest(1, floor({SPAN_US} / (240e6::DOUBLE / bpm))) AS bars FROM (SELECT g.*, (t_us - first_us) / (60e6::DOUBLE / bpm) AS beat FROM {grids} g JOIN {onsets} o USING (track_id))),
  {into}_s AS (SELECT track_id, bpm, first_us, avg(CASE WHEN far < 0.3 THEN 1 WHEN far < 0.6 THEN 0.7::DOUBLE WHEN abs(far - 2) < 0.3 THEN 0.5 ELSE 0 END::DOUBLE) AS bar_alignment,
    count(DISTINCT CASE WHEN far < 0.6 AND bar BETWEEN 0 AND bars - 1 THEN bar END) / any_value(bars) AS bar_coverage, greatest(0, 1 - 2 * avg(abs(beat - round_even(beat * 2, 0) / 2))) AS beat_alignment,
    greatest(0, 1 - 3 * CASE WHEN bpm < 70 THEN (70 - bpm) / 70 WHEN bpm > 130 THEN (bpm - 130) / 130 ELSE 0 END)::DOUBLE AS bpm_preference FROM {into}_x GROUP BY ALL),
  {into} AS MATERIALIZED (SELECT *, 0.3::DOUBLE * bar_alignment + 0.2::DOUBLE * bar_coverage + 0.15::DOUBLE * beat_alignment + 0.35::DOUBLE * bpm_preference AS total FROM {into}_s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(total, 9) DESC, bpm, first_us) = 1)"""


MARKS = "mark AS MATERIALIZED (SELECT track_id, t_us, row_number() OVER (PARTITION BY track_id ORDER BY t_us) AS n, count(*) OVER (PARTITION BY track_id) AS many FROM det WHERE role = 'onset'), third AS (SELECT * FROM mark WHERE many <= 50 OR n % 3 = 1)"


def searched(initial: str, into: str) -> str:
    """Table ``into`` of the best of all grids of the tracks of a table (track_id, bpm)."""
    return f"""
  {into}_t AS (SELECT DISTINCT track_id, t::DOUBLE AS bpm FROM (SELECT track_id, unnest([round_even(bpm, 0), round_even(bpm / 2, 0), round_even(bpm * 2, 0)] || range(70, 131, 5)::DOUBLE[]) AS t FROM {initial}) WHERE t BETWEEN 40 AND 200),
  {into}_p AS (SELECT track_id, bpm, t_us - k * (60e6::DOUBLE / bpm) AS spot FROM mark JOIN {into}_t USING (track_id), (SELECT unnest(range(4)) AS k) WHERE n <= 30),
  {into}_g AS MATERIALIZED (SELECT DISTINCT track_id, bpm, (round_even(spot / 1000, 0) * 1000)::BIGINT AS first_us FROM (SELECT * FROM {into}_p WHERE spot >= 0 AND spot <= 240e6::DOUBLE / bpm UNION ALL SELECT track_id, bpm, unnest(range(20)) * (60e6::DOUBLE / bpm) / 4 FROM {into}_t)),
  {scored(f'{into}_g', 'third', into)}"""


PARTS = "bar_alignment bar_coverage beat_alignment bpm_preference total".split()


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("track_id", F.round("bpm", 6).alias("bpm"), "first_us", *[F.round(c, 6).alias(c) for c in PARTS])


SEARCH = f"""{MARKS}, start AS (SELECT track_id, CASE WHEN bpm > 130 AND bpm / 2 >= 70 THEN bpm / 2 WHEN bpm < 70 AND bpm * 2 <= 130 THEN bpm * 2 ELSE bpm END AS bpm FROM tempi WHERE place = 1), {searched('start', 'one')},
  half AS (SELECT track_id, bpm / 2 AS bpm FROM one WHERE bar_alignment < 0.3), {searched('half', 'two')},
  pick AS (SELECT * FROM one WHERE track_id NOT IN (SELECT t.track_id FROM two t JOIN one o USING (track_id) WHERE t.bar_alignment > o.bar_alignment) UNION ALL SELECT t.* FROM two t JOIN one o USING (track_id) WHERE t.bar_alignment > o.bar_alignment)"""


@query(f"""{TEMPI}, {SEARCH}
SELECT track_id, round(bpm, 6) AS bpm, first_us, {', '.join(f'round({c}, 6) AS {c}' for c in PARTS)} FROM pick""")
def found_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo and first beat of each track, by search."""
    onsets = adapters.detections(spark, sf_dir).where("role = 'onset'")
    return _shown(grid.found_grid(onsets, SPAN_US))


@query(f"""WITH {DET}, {MARKS}, tempi AS (SELECT DISTINCT track_id, 60.0::DOUBLE + 5 * track_id AS bpm FROM det), bar AS (SELECT *, 240e6::DOUBLE / bpm AS bar_us FROM tempi),
  p AS (SELECT track_id, bpm, unnest(range(100)) * (bar_us * 2 / 99) AS spot FROM bar UNION ALL SELECT track_id, bpm, t_us - k * bar_us FROM mark JOIN bar USING (track_id), (SELECT unnest(range(4)) AS k) WHERE n <= 30 AND (k = 0 OR t_us - k * bar_us BETWEEN 0 AND bar_us * 2)),
  g AS MATERIALIZED (SELECT DISTINCT track_id, bpm, (round_even(spot / 1000, 0) * 1000)::BIGINT AS first_us FROM p), {scored('g', 'mark', 'pick')}
SELECT track_id, bpm, first_us, {', '.join(f'round({c}, 6) AS {c}' for c in PARTS)} FROM pick""")
def best_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first beat of each track at a given tempo."""
    det = adapters.detections(spark, sf_dir)
    tempi = det.select("track_id", (F.lit(60.0) + 5 * F.col("track_id")).alias("bpm")).distinct()
    return _shown(grid.best_phase(det.where("role = 'onset'"), tempi, SPAN_US))


WINDOWS = f"""WITH {CURVE}, n AS (SELECT track_id, count(*) AS n FROM curve GROUP BY ALL), win AS (SELECT track_id, unnest(range(0, n - 16, 8)) AS s FROM n),
  held AS MATERIALIZED (SELECT win.track_id, s, k - 1 - s AS i, x FROM win JOIN curve c ON c.track_id = win.track_id AND k - 1 >= s AND k - 1 < s + 16), power AS (SELECT track_id, s, sum(x * x) AS power FROM held GROUP BY ALL),
  lag AS (SELECT bpm, floor(240 / bpm)::INT AS lag FROM (SELECT unnest(range(60, 161)) AS bpm)),
  met AS (SELECT a.track_id, a.s, b.i - a.i AS lag, sum(a.x * b.x) AS met FROM held a JOIN held b ON b.track_id = a.track_id AND b.s = a.s AND b.i > a.i AND b.i - a.i <= 4 GROUP BY ALL),
  told AS (SELECT track_id, s, bpm, round(met / power, 12) AS strength FROM met JOIN lag USING (lag) JOIN power USING (track_id, s) WHERE met > 0 QUALIFY row_number() OVER (PARTITION BY track_id, s ORDER BY round(met / power, 12) DESC, bpm) = 1),
  gram AS (SELECT track_id, s / 4 AS start, coalesce(bpm, 120)::DOUBLE AS bpm, coalesce(strength, 0) AS strength FROM win LEFT JOIN told USING (track_id, s))"""


@query(f"{WINDOWS} SELECT track_id, start::DOUBLE AS start, bpm, round(strength, 6) AS strength FROM gram")
def tempograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo in windows of four seconds, of frames four a second."""
    return _gram(spark, sf_dir)[1].select("track_id", "start", "bpm", F.round("strength", 6).alias("strength"))


def _gram(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    curve = detection.combined(detection.strengths(_numbered(spark, sf_dir), "samples"), detection.ONSET)
    return curve, tempo.tempogram(curve, "strength", 4.0, window=4.0, hop=2.0)


@query(f"""{WINDOWS}, sure AS (SELECT track_id, median(bpm) AS bpm, greatest(0, 1 - stddev_pop(bpm) / 30) AS confidence FROM gram WHERE strength > 0.2 GROUP BY ALL)
SELECT track_id, coalesce(bpm, 120)::DOUBLE AS bpm, round(coalesce(confidence, 0), 6) AS confidence FROM n LEFT JOIN sure USING (track_id)""")
def steady_tempi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tempo of each track by the windows that are sure."""
    return tempo.steady_tempo(*_gram(spark, sf_dir)).select("track_id", "bpm", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH RECURSIVE {CURVE}, n AS (SELECT track_id, count(*) AS n, sum(x * x) AS power FROM curve GROUP BY ALL),
  met AS (SELECT a.track_id, b.k - a.k AS lag, sum(a.x * b.x) AS met FROM curve a JOIN curve b ON b.track_id = a.track_id AND b.k > a.k AND b.k - a.k < 24 GROUP BY ALL),
  r AS MATERIALIZED (SELECT track_id, lag AS k, met / power AS x FROM met JOIN n USING (track_id) WHERE lag >= 9 AND lag < n - 1), {peaks('r', 'track_id', '0.1::DOUBLE', 5, -1)}
SELECT track_id, round(1440::DOUBLE / k, 6) AS bpm, round(x, 6) AS strength FROM peak QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY x DESC, k) <= 10""")
def correlated_tempi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempi at which a track's strength agrees with itself, of frames 24 a second."""
    curve = detection.combined(detection.strengths(_numbered(spark, sf_dir), "samples"), detection.ONSET)
    found = tempo.correlated_tempi(curve, "strength", 24.0, 60.0, 160.0)
    return found.select("track_id", F.round("bpm", 6).alias("bpm"), F.round("strength", 6).alias("strength"))


#: Events on the grids found for their tracks.
ALIGNED = f"""{FUSED}, {TEMPI.split('det AS', 1)[1].split('FROM events),', 1)[1]}, {SEARCH},
  placed AS (SELECT f.*, bpm, first_us, (start_us - first_us) / (60e6::DOUBLE / bpm) AS spot FROM fused f JOIN pick USING (track_id)),
  near AS (SELECT *, round_even(spot / 0.5, 0) * 0.5 AS step FROM placed), moved AS (SELECT *, abs(spot - step) AS distance, CASE WHEN abs(spot - step) <= 0.3::DOUBLE THEN step ELSE spot END AS final FROM near),
  fit AS (SELECT *, list_sort([{{'far': abs(v - beats), 'v': v}} FOR v IN [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0]::DOUBLE[]])[1] AS n FROM moved),
  ended AS MATERIALIZED (SELECT *, CASE WHEN beats > 6 THEN 6 WHEN beats < 0.25 THEN 0.25 WHEN n.far / beats < 0.3::DOUBLE THEN n.v ELSE beats END AS written FROM fit)"""


@query(f"""{ALIGNED} SELECT track_id, event_id, CASE WHEN distance <= 0.3::DOUBLE THEN round_even(first_us + step * (60e6::DOUBLE / bpm), 0)::BIGINT ELSE start_us END AS start_us, round_even(written * (60e6::DOUBLE / bpm), 0)::BIGINT AS dur_us, written AS beats,
  CASE WHEN final < 0 THEN 0 ELSE floor(final / 4)::INT + 1 END AS bar, round(CASE WHEN final < 0 THEN 1 ELSE fmod(final, 4.0::DOUBLE) + 1 END, 6) AS beat, distance <= 0.3::DOUBLE AS on_grid FROM ended""")
def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events brought onto the grid that is found for their track."""
    rows = alignment.aligned(*_aligned(spark, sf_dir))
    return rows.select("track_id", "event_id", "start_us", "dur_us", "beats", "bar", F.round("beat", 6).alias("beat"), "on_grid")


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes, onsets = _inputs(spark, sf_dir)
    events = fusion.fused(notes, onsets, SPAN_US, BEAT_US)
    initial = notes.select("track_id", F.lit(60e6 / BEAT_US).alias("bpm"), F.lit(0).alias("first_us")).distinct()
    return events, alignment.grids_for(events, onsets, SPAN_US, initial)


@query(f"""{ALIGNED}, full_score AS (SELECT * FROM pick), {scored('(SELECT track_id, bpm, first_us FROM full_score)', 'mark', 'final_score')},
  told AS (SELECT track_id, count(*) FILTER (distance <= 0.3::DOUBLE) AS on_grid, count(*) FILTER (distance > 0.3::DOUBLE) AS off_grid, avg(distance) AS mean_distance, count(*) FILTER (CASE WHEN final < 0 THEN true ELSE fmod(final, 4.0::DOUBLE) < 0.1::DOUBLE END) AS on_first_beat FROM ended GROUP BY ALL)
SELECT track_id, round(s.bpm, 6) AS bpm, s.first_us, {', '.join(f'round(s.{c}, 6) AS {c}' for c in PARTS)}, on_grid, off_grid, round(mean_distance, 6) AS mean_distance, on_first_beat FROM final_score s JOIN told USING (track_id)""")
def alignment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's grid, its score, and how its events keep it."""
    events, grids = _aligned(spark, sf_dir)
    rows = alignment.statistics(alignment.aligned(events, grids), grids)
    return rows.select("track_id", F.round("bpm", 6).alias("bpm"), "first_us", *[F.round(c, 6).alias(c) for c in (*PARTS, "mean_distance")], "on_grid", "off_grid", "on_first_beat")
